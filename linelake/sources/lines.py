"""Scans of line-delimited JSON: lines with their numbers and offsets, rows, tables as logs, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linelake.functions.json import once, paired, trimmed, unpaired
from linelake.session import json_settings

#: Bytes of the mark at a file's start that the text reader skips.
BOM = 3


def scan(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, size, block, rid, line) of plain and gzipped files; a folder's ``*.jsonl`` and ``*.jsonl.gz``. rid grows along a file."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("rid"), F.col("value").alias("line"),
    )


def _missing(read: Column, size: Column, file: Column) -> Column:
    """Bytes of a plain file that its lines, with an end each, leave out: 0; -1 if the last line has no end; BOM, or one less, if there was a mark."""
    return F.when(F.regexp_like(file, F.lit(r"\.(gz|gzip)$")), 0).otherwise(size - read)


def numbered(lines: DataFrame) -> DataFrame:
    """(file, line_no, offset, body): non-blank lines, trimmed, with their number among a file's non-blank lines and their byte offset.

    Two passes: totals of each file's splits give where a split begins; inside a split, numbers and offsets are running sums. So a large
    file is numbered by as many tasks as it was read by. A byte order mark shows in the totals: the lines are shorter than the file.
    """
    full = F.length(trimmed(F.col("line"))) > 0
    sized = lines.withColumns({"full": full.cast("long"), "bytes": F.octet_length("line").cast("long") + 1})
    split = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    part = F.shiftright("rid", 33)
    totals = sized.groupBy("file", "block", part.alias("part")).agg(F.sum("full").alias("n"), F.sum("bytes").alias("b"), F.max("size").alias("size"))
    missing = _missing(F.sum("b").over(Window.partitionBy("file")), F.col("size"), F.col("file"))
    marked = F.when(missing.isin(BOM, BOM - 1), BOM).otherwise(0)
    begins = totals.select("file", "block", "part", F.coalesce(F.sum("n").over(split), F.lit(0)).alias("n0"), (F.coalesce(F.sum("b").over(split), F.lit(0)) + marked).alias("b0"))
    inside = Window.partitionBy("file", "block", "part").orderBy("rid")
    run = sized.withColumn("part", part).withColumns({
        "n": F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "b": F.coalesce(F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    return run.where("full = 1").join(begins, ["file", "block", "part"]).select(
        "file", (F.col("n0") + F.col("n")).alias("line_no"), (F.col("b0") + F.col("b")).alias("offset"), trimmed(F.col("line")).alias("body")
    )


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` (body, ...) with ``valid`` and ``v``, the VARIANT value of a valid body."""
    with json_settings(rows.sparkSession):
        pair = once(rows, _pair=paired(F.col("body")))
        valid, value = unpaired(F.col("_pair"))
        out = once(pair, valid=valid, v=value).drop("_pair")
        out.schema  # noqa: B018  the settings are read when the plan is analysed
    return out


def decoded(rows: DataFrame) -> DataFrame:
    """Valid rows that are objects or arrays: what a reader yields."""
    return rows.where("valid").where(F.regexp_like(F.schema_of_variant("v"), F.lit("^(OBJECT|ARRAY)")))


def log_of(df: DataFrame, *columns: str, keep_nulls: bool = True, **others: Column) -> DataFrame:
    """A table as a log: ``body`` is each row as JSON, of all columns or of those named; ``others`` are carried along."""
    names = list(columns) or df.columns
    body = F.to_json(F.struct(*names), {"ignoreNullFields": str(not keep_nulls).lower()})
    return df.select(body.alias("body"), *(c.alias(n) for n, c in others.items()))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt out over all of them: parsing its rows costs far more than moving them. Larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def counts_by_file(lines: DataFrame) -> DataFrame:
    """(file, ends, rows, bytes) of ``scan``: line ends, non-blank lines, and bytes with a line end each. A plain file's last line without an end is no line end."""
    full = F.length(trimmed(F.col("line"))) > 0
    sums = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(full).alias("rows"), F.sum(F.octet_length("line").cast("long") + 1).alias("bytes"), F.max("size").alias("size")
    )
    open_end = _missing(F.col("bytes"), F.col("size"), F.col("file")).isin(-1, BOM - 1)
    return sums.select("file", (F.col("lines") - open_end.cast("long")).alias("ends"), "rows", "bytes")
