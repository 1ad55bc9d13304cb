"""Raw postings from JSON and JSONL files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import RAW_COLUMNS, RAW_JOB
from ..session import cut_lineage

# Report files that lie next to the data.
REPORT_FILES = r"(^|/)(source-registry-report\.json|[^/]*\.report\.json)$"

CORRUPT = "_corrupt_record"


def _pieces(spark: SparkSession, path: str, pattern: str, separator: str | None) -> DataFrame:
    """Lines (or what stands between separators) of the matching files, with their place."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if separator is not None:
        reader = reader.option("lineSep", separator)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"),
        "value",
        # Grows inside one read task, which sees the lines of its block in order.
        F.monotonically_increasing_id().alias("line"),
    ).where(~F.col("file_path").rlike(REPORT_FILES))


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return _pieces(spark, path, pattern, None).where(F.trim("value") != "").drop("bytes").withColumn("part", F.lit(0))


def _braces(value: Column) -> Column:
    """Opening less closing brackets of text that is free of strings."""
    count = lambda signs: F.length(value) - F.length(F.translate(value, signs, ""))
    return count("{[") - count("}]")


def _records(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The objects of JSON files, each a single object or an array of objects of any length.

    Files are read in pieces that end in ``}``, so a file is split among tasks like a file of
    lines. A piece alone does not tell whether it begins inside a string, or how deep. Each one
    is measured for both cases; running sums over the pieces of a block, and over the blocks of
    a file, then tell which case holds, and a record ends where a piece closes an object that
    lies directly in the file or its array. Only one block's pieces meet in a task. What stands
    between the objects of an array becomes part of the next record, which is unreadable then.
    """
    value = F.col("value")
    pieces = _pieces(spark, path, pattern, "}")
    # Escaped signs do not matter; a piece cannot end between a backslash and its sign.
    plain = F.regexp_replace(value, r"\\.", "")
    quotes = F.length(plain) - F.length(F.translate(plain, '"', ""))
    outside = F.regexp_replace(plain, '"[^"]*("|$)', "")  # if the piece begins outside a string
    inside = F.regexp_replace(F.regexp_replace(plain, '^[^"]*("|$)', ""), '"[^"]*("|$)', "")
    measured = cut_lineage(
        pieces.select(
            "file_path", "block", "line", "value", "bytes", (quotes % 2).alias("odd"),
            _braces(outside).alias("deep0"), _braces(inside).alias("deep1"),
        )
    )
    at = Window.partitionBy("file_path", "block").orderBy("line")
    earlier = at.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    # The brace that ended the piece closes a level if it stands outside a string. The last
    # piece of a file has one only if the pieces and their braces make up the whole file.
    last = measured.groupBy("file_path").agg(
        F.max(F.struct("block", "line")).alias("end"),
        (F.sum(F.octet_length("value") + 1) == F.max("bytes")).alias("full"),
    )
    closed = (F.struct("block", "line") != F.col("end")) | F.col("full")
    known = measured.join(last, "file_path").withColumn("closed", closed).drop("end", "full", "bytes")
    for start in (0, 1):
        begins = (so_far("odd") + start) % 2
        ends = (begins + F.col("odd")) % 2
        step = F.when(begins == 0, F.col("deep0")).otherwise(F.col("deep1")) - F.when((ends == 0) & F.col("closed"), 1).otherwise(0)
        known = known.withColumn(f"ends{start}", ends).withColumn(f"step{start}", step)
    blocks = known.groupBy("file_path", "block").agg(
        F.sum("odd").alias("odd"), *(F.sum(f"step{s}").alias(f"step{s}") for s in (0, 1)),
        F.min_by("value", F.when(F.trim("value") != "", F.col("line"))).alias("head"),
    )
    # One row per block of a file.
    over = Window.partitionBy("file_path").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    own = F.when(F.col("start") == 0, F.col("step0")).otherwise(F.col("step1"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum(own).over(before), F.lit(0)))
    listed = F.first("head", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.withColumn("floor", F.when(F.regexp_like(listed, F.lit(r"^\s*\[")), 1).otherwise(0))
    placed = known.join(blocks.select("file_path", "block", "start", "base", "floor"), ["file_path", "block"])
    step = F.when(F.col("start") == 0, F.col("step0")).otherwise(F.col("step1"))
    ends = F.when(F.col("start") == 0, F.col("ends0")).otherwise(F.col("ends1"))
    placed = placed.withColumn("step", step).withColumn("quiet", ends == 0)
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    depth = F.col("base") + F.sum("step").over(upto)
    placed = placed.withColumn("final", F.col("closed") & F.col("quiet") & (depth == F.col("floor")))
    placed = cut_lineage(placed.select("file_path", "block", "line", "value", "closed", "floor", "final"))
    # A record is named by the block and the number of ends before it; it may begin in an earlier block.
    counts = placed.groupBy("file_path", "block").agg(F.count_if("final").alias("n"))
    counts = counts.withColumn("ended", F.coalesce(F.sum("n").over(before), F.lit(0)))
    number = F.col("ended") + F.coalesce(F.sum(F.col("final").cast("int")).over(earlier), F.lit(0))
    numbered = placed.join(counts.select("file_path", "block", "ended"), ["file_path", "block"]).withColumn("part", number)
    piece = F.concat("value", F.when(F.col("closed"), "}").otherwise(""))
    whole = numbered.groupBy("file_path", "part").agg(
        F.min("floor").alias("floor"),
        F.array_sort(F.collect_list(F.struct("block", "line", piece.alias("text")))).alias("pieces"),
    )
    text = F.array_join("pieces.text", "")
    # Between records stand commas, at the ends of a list its brackets.
    record = F.when(F.col("floor") == 1, F.regexp_replace(text, r"^\s*(?:\[|,)?\s*", "")).otherwise(F.trim(text))
    rest = F.when(F.col("floor") == 1, r"^\s*\]?\s*$").otherwise(r"^\s*$")
    return whole.select(
        "file_path", F.lit(0).cast("long").alias("block"), F.col("part").alias("line"), F.lit(0).alias("part"), record.alias("value"),
    ).where(~F.regexp_like("value", rest))


def read_raw_jobs(
    spark: SparkSession, path: str, lines: str = "*.jsonl", documents: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """All postings below ``path`` with their place, and the unreadable records.

    ``lines`` and ``documents`` name the files with an object a line, and those with a single
    object or an array; both are split among tasks, whatever their size.

    ``place`` orders postings as they arrived (file, block, line, entry). Stamp ``raw_id``
    from it once with :func:`stamp_raw_ids` and store it; later steps use the stored id.
    """
    schema = RAW_JOB.add(CORRUPT, "string", True) if CORRUPT not in RAW_JOB.fieldNames() else RAW_JOB
    everything = _lines(spark, path, lines).unionByName(_records(spark, path, documents))
    parsed = everything.withColumn(
        "r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    )
    place = F.struct("file_path", "block", "line", "part").alias("place")
    good = parsed.where(F.col(f"r.{CORRUPT}").isNull()).select(place, *[f"r.{c}" for c in RAW_COLUMNS])
    bad = parsed.where(F.col(f"r.{CORRUPT}").isNotNull()).select(place, F.col("value").alias("record"))
    return good, bad


def stamp_raw_ids(placed: DataFrame, start: int = 0) -> DataFrame:
    """Ids that follow ``place``: a range sort, then ids that grow over the sorted parts."""
    return (
        placed.orderBy("place")
        .withColumn("raw_id", F.monotonically_increasing_id() + F.lit(start))
        .drop("place")
    )
