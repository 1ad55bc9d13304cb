"""Operators of a training-data pipeline and their registered queries.

Nothing else in the library imports this folder; ``__spark_entry__`` adds its queries when
it is there.
"""
