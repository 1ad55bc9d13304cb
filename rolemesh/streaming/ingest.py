"""Incremental jobs: the batch rules applied to micro-batches, with keyed state in RocksDB.

What a key has seen lives in Spark's state store, so no batch reads what earlier batches
stored. Output is written as one partition per batch id: a replayed batch replaces its own
partition and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import ids
from ..operators.enrich import taxonomy_hash
from ..operators.vocabulary import Skill
from ..schemas import ENRICHMENT
from ..session import cut_lineage
from ..sinks.tables import latest_version, read_versions, write_version

BATCH = "batch"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the store that keeps more than fits in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _run(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _field(name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind)])


class FirstPerKey(StatefulProcessor):
    """Hands on the first row of every key, once; of the rows of one batch the least by ``order``."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", _field("at", T.LongType()))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        if self.known.exists():
            return
        first = min(rows, key=lambda r: r[self.order])
        self.known.update((int(first[self.order]),))
        yield first


def first_per_key_ever(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of every key over all batches of a stream; ``order`` is a whole number."""
    _state_in_rocksdb(stream.sparkSession)
    return stream.groupBy(*keys).transformWithState(FirstPerKey(order), stream.schema, "Append", "None")


def stream_raw_ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """First posting per source key wins, across all batches; stored as one partition per batch.

    A key that has been stored is a value in the state store: a batch costs what it brings,
    however many postings there are. Read the table with ``read_versions``.
    """
    keyed = stream.withColumn(
        "source_key",
        ids.source_key(F.col("source_type"), F.col("company_name"), F.col("external_job_id"), F.col("source_url")),
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, path, batch_id, BATCH)

    return _run(first_per_key_ever(keyed, ["source_key"], "raw_id"), handle, checkpoint)


# --- last-wins state -------------------------------------------------------


def fold(
    df: DataFrame, keys: Sequence[str], order: str, overwrite: Sequence[str], keep_non_null: Sequence[str]
) -> DataFrame:
    """Rows -> per key one state row whose parts remember when they were set.

    Folding folded rows again gives the same result in any grouping and order, so late rows
    land where they belong.
    """
    at = F.col(order)
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(at.alias("at"), *overwrite), at).alias("_last"),
        *[
            F.max_by(F.struct(at.alias("at"), F.col(c).alias("v")), F.when(F.col(c).isNotNull(), at)).alias("_keep_" + c)
            for c in keep_non_null
        ],
    )


def refold(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = [c for c in states.columns if c not in (*keys, "batch")]
    return states.groupBy(*keys).agg(*[F.max_by(c, F.col(c)["at"]).alias(c) for c in parts])


def unfold(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State rows -> plain columns."""
    last = states.schema["_last"].dataType.fieldNames()[1:]
    kept = [c for c in states.columns if c.startswith("_keep_")]
    return states.select(
        *keys,
        *[F.col("_last")[c].alias(c) for c in last],
        *[F.col(c)["v"].alias(c.removeprefix("_keep_")) for c in kept],
    )


class LastWins(StatefulProcessor):
    """Folds a key's rows into its state and hands the state on when a batch has changed it.

    ``parts`` names the state's columns; each is (at, fields...) and the later one stays.
    """

    def __init__(self, parts: Sequence[str], schema: T.StructType):
        self.parts, self.schema = parts, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        # State values are flat: every field of every part, in order.
        self.fields = {p: self.schema[p].dataType.fields for p in self.parts}
        flat = [T.StructField(f"{p}_{f.name}", f.dataType) for p in self.parts for f in self.fields[p]]
        self.state = handle.getValueState("state", T.StructType(flat))

    def _read(self) -> dict:
        values = iter(self.state.get()) if self.state.exists() else None
        if values is None:
            return dict.fromkeys(self.parts)
        found = {p: tuple(next(values) for _ in self.fields[p]) for p in self.parts}
        return {p: v if v[0] is not None else None for p, v in found.items()}

    def _part(self, name: str, value) -> tuple | None:
        """A part of a row as a tuple, its ``at`` first."""
        if value is None:
            return None
        got = tuple(value[f.name] for f in self.fields[name])
        return None if got[0] is None else got

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        changed, now = not self.state.exists(), self._read()
        for row in rows:
            for part in self.parts:
                new = self._part(part, row[part])
                if new is not None and (now[part] is None or new[0] >= now[part][0]):
                    changed |= now[part] != new
                    now[part] = new
        if changed:
            self.state.update(tuple(v for p in self.parts for v in (now[p] or (None,) * len(self.fields[p]))))
            whole = dict(zip([f.name for f in self.schema if f.name not in self.parts], key))
            for p in self.parts:
                whole[p] = None if now[p] is None else Row(*(f.name for f in self.fields[p]))(*now[p])
            yield Row(**{f.name: whole[f.name] for f in self.schema})


def _as_states(
    df: DataFrame, keys: Sequence[str], order: str, overwrite: Sequence[str], keep_non_null: Sequence[str]
) -> DataFrame:
    """Rows in the form of :func:`fold`, one state per row."""
    at = F.col(order)
    kept = [
        F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))).alias("_keep_" + c) for c in keep_non_null
    ]
    return df.select(*keys, F.struct(at.alias("at"), *overwrite).alias("_last"), *kept)


def stream_upsert(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: str,
    overwrite: Sequence[str],
    keep_non_null: Sequence[str] = (),
) -> StreamingQuery:
    """Last wins per key. A batch stores the new state of the keys that it has changed, no other.

    :func:`current_state` takes each key's newest state, :func:`compact` puts them together.
    """
    _state_in_rocksdb(stream.sparkSession)
    states = _as_states(stream, keys, order, overwrite, keep_non_null)
    parts = [c for c in states.columns if c not in keys]
    changes = states.groupBy(*keys).transformWithState(LastWins(parts, states.schema), states.schema, "Update", "None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_version(batch, f"{path}/changes", batch_id, BATCH)

    return _run(changes, handle, checkpoint, "update")


def _newest(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = [c for c in states.columns if c not in (*keys, BATCH)]
    newest = states.groupBy(*keys).agg(F.max_by(F.struct(*parts), BATCH).alias("s"))
    return newest.select(*keys, *(F.col("s")[c].alias(c) for c in parts))


def state_files(spark: SparkSession, path: str) -> DataFrame | None:
    """States still in force: the newest base, whose version is the last batch in it, and the later changes.

    Earlier changes and bases are retired: partition filters keep them from being read.
    """
    base, changes = latest_version(spark, f"{path}/base", BATCH), read_versions(spark, f"{path}/changes")
    if changes is None:
        return None
    if base is None:
        return changes
    folded = read_versions(spark, f"{path}/base").where(F.col(BATCH) == base)
    return folded.unionByName(changes.where(F.col(BATCH) > base))


def current_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The state table as plain columns."""
    states = state_files(spark, path)
    return None if states is None else unfold(_newest(states, keys), keys)


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int | None:
    """Put all states up to the last batch into a new base and return that batch.

    A batch replayed after this stays retired: what it stores again is in the base.
    """
    last = latest_version(spark, f"{path}/changes", BATCH)
    base = latest_version(spark, f"{path}/base", BATCH)
    if last is None or last == base:
        return base
    write_version(_newest(state_files(spark, path), keys), f"{path}/base", last, BATCH)
    return last


# --- enrichment ------------------------------------------------------------


class FirstOfText(StatefulProcessor):
    """Marks each job with the first job of its text: itself, or one that came before."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", _field("id", T.StringType()))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        rows = sorted(rows, key=lambda r: r["id"])
        if not self.first.exists():
            self.first.update((rows[0]["id"],))
        first = self.first.get()[0]
        for row in rows:
            yield Row(**{f.name: first if f.name == "first_id" else row[f.name] for f in self.schema})


def stream_enrich(
    stream: DataFrame, path: str, checkpoint: str, taxonomy: list[Skill], provider=None, order: str = "ord"
) -> StreamingQuery:
    """Every job is enriched once, and every text once, ever.

    Two states decide that: the first row of a job id (by ``order``, a whole number), and the
    first job of a text. A job that is not the first of its text only stores whose result it
    shares. Jobs without a text hash are texts of their own. Read with :func:`enriched`.
    """
    from ..operators.providers import HeuristicProvider, provider_signature

    provider = provider or HeuristicProvider()
    signature, digest = provider_signature(provider), taxonomy_hash(taxonomy)
    fresh = first_per_key_ever(stream, ["id"], order)
    has_hash = F.coalesce("description_hash", F.lit("")) != ""
    own = F.concat(F.lit("job "), F.col("id"))
    keyed = fresh.withColumn(
        "cache_key", F.when(has_hash, ids.cache_key(F.col("description_hash"), signature, digest)).otherwise(own)
    )
    schema = T.StructType([*keyed.schema.fields, T.StructField("first_id", T.StringType())])
    marked = keyed.groupBy("cache_key").transformWithState(FirstOfText(schema), schema, "Append", "None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)  # read twice below
        columns = [c for c in stream.columns if c != order]
        computed = provider.enrich(batch.where("id = first_id").select(*columns), taxonomy)
        write_version(computed.select(*ENRICHMENT.fieldNames()), f"{path}/results", batch_id, BATCH)
        write_version(batch.select(F.col("id").alias("job_id"), "first_id", "cache_key"), f"{path}/jobs", batch_id, BATCH)

    return _run(marked, handle, checkpoint)


def enriched(spark: SparkSession, path: str) -> DataFrame | None:
    """One enrichment row per job; jobs of equal texts share one result."""
    jobs, results = read_versions(spark, f"{path}/jobs"), read_versions(spark, f"{path}/results")
    if jobs is None or results is None:
        return None
    shared = results.drop(BATCH).withColumnRenamed("job_id", "first_id")
    return jobs.select("job_id", "first_id").join(shared, "first_id").select(*ENRICHMENT.fieldNames())
