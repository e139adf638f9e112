"""Field statistics: from a log's nodes to one row for each path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linelake.functions import hints
from linelake.functions.json import SHORT, atom_key, atom_text, once

from .nodes import DEPTH, elements, nesting, nodes

TOP = 20
FIELDS = 2000
TYPES = ("integer", "real", "true", "false", "text", "null", "array")


def value_counts(found: DataFrame) -> DataFrame:
    """A row for each path and value: (path, key, n, n_<type>, rank, num, big, length). Arrays and nulls are counted under the key null. Long texts are
    counted by digest. All that is aggregated has a fixed size, so rows combine by hash before the shuffle; counts of parts of a log add up."""
    a = F.col("atom")
    rows = once(found, key=atom_key(a), rank=a["rank"], num=a["num"], big=a["big"], length=F.length(a["txt"])).select("path", "json_type", "key", "rank", "num", "big", "length")
    return rows.groupBy("path", "key").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("json_type") == t).alias(f"n_{t}") for t in TYPES),
        F.min("rank").alias("rank"), F.min("num").alias("num"), F.min("big").alias("big"), F.min("length").alias("length"),
    )


def folded(counts: DataFrame) -> DataFrame:
    """One row for each path of ``value_counts``: counts by type, present, non_null, is_array, distinct_n, text lengths."""
    n, size = F.col("n"), F.col("length")
    total = F.sum(F.when(size.isNotNull(), n))
    return counts.groupBy("path").agg(
        *(F.sum(f"n_{t}").alias(f"n_{t}") for t in TYPES), F.sum(n).alias("present"), F.sum(n - F.col("n_null")).alias("non_null"),
        F.max((F.col("n_array") > 0).cast("int")).alias("is_array"), F.count("key").alias("distinct_n"),
        F.min(size).cast("long").alias("len_min"), F.max(size).cast("long").alias("len_max"), F.round(F.sum(size * n) / total, 2).alias("len_avg"),
    )


def extremes(found: DataFrame) -> DataFrame:
    """(path, min_v, max_v): each path's least and greatest value: numbers, then texts."""
    a = F.col("atom")
    order = F.struct(a["rank"].alias("rank"), a["num"].alias("num"), a["big"].alias("big"), a["txt"].alias("txt"))
    value = F.struct(order.alias("order"), atom_text(a).alias("text"))
    return found.where(a.isNotNull()).groupBy("path").agg(F.min(value)["text"].alias("min_v"), F.max(value)["text"].alias("max_v"))


def summary(found: DataFrame) -> DataFrame:
    """``folded`` with ``extremes``, for each path."""
    return folded(value_counts(found)).join(extremes(found), "path", "left")


def _value(key: Column) -> Column:
    return F.when(~F.startswith(key, F.lit("h:")), F.substring(key, 3, 1 << 30))


def distinct_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("path").agg(F.count("key").alias("distinct_n")).where("distinct_n > 0")


def top_values(counts: DataFrame, found: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """(path, rank, value, n) of each path's ``top`` most frequent values; ties in value order: numbers, then texts.

    Long texts are looked up by their digests in ``found``, the nodes counted, once it is known that there are such among the most frequent.
    """
    order = Window.partitionBy("path").orderBy(F.col("n").desc(), F.col("rank"), F.col("num"), F.col("big"), "key")
    best = counts.where("key is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    best = best.select("path", F.col("place").alias("rank"), _value(F.col("key")).alias("value"), "n", "key")
    if found is not None:
        best = best.persist()  # top rows of each path
        wanted = best.where("value is null").select("path", "key")
        if not wanted.isEmpty():
            a = F.col("atom")
            long = found.where(F.length(a["txt"]) > SHORT).select("path", atom_key(a).alias("key"), a["txt"].alias("long"))
            texts = long.join(wanted, ["path", "key"], "left_semi").groupBy("path", "key").agg(F.min("long").alias("long"))
            best = best.join(texts, ["path", "key"], "left").withColumn("value", F.coalesce("value", "long"))
    return best.select("path", "rank", "value", "n")


def element_stats(rows: DataFrame, path: str, top: int = TOP) -> DataFrame:
    """One row for the array at ``path``: arrays, elements, distinct scalars, elements for each array, and the most frequent scalars and null."""
    found = elements(rows, path).withColumn("path", F.lit(path))
    name = F.lit(path).alias("path")
    n_arrays = rows.where(F.startswith(F.schema_of_variant(F.try_variant_get("v", "$." + path, "variant")), F.lit("ARRAY"))).groupBy(name).agg(F.count(F.lit(1)).alias("arrays"))
    totals = value_counts(found).groupBy("path").agg(F.sum("n").alias("count"), F.count("key").alias("distinct"))
    best = element_top(rows, path, top).groupBy(name).agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    average = F.when(F.col("arrays") > 0, F.round(F.col("count") / F.col("arrays"), 2)).otherwise(0.0)
    return n_arrays.join(totals, "path", "left").join(best, "path", "left").select(
        "path", "arrays", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("distinct", F.lit(0)).alias("distinct"), F.coalesce(average, F.lit(0.0)).alias("avg_per_row"), "top"
    )


def element_top(rows: DataFrame, path: str, top: int = TOP) -> DataFrame:
    """(rank, value, n): scalar elements by frequency; null counts as a value, and comes first among equals."""
    found = elements(rows, path).where("json_type not in ('array', 'object')")
    a = F.col("atom")
    counts = found.groupBy(F.coalesce(atom_key(a), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(a).alias("a"))
    best = counts.orderBy(F.col("n").desc(), F.col("a").asc_nulls_first()).limit(top)
    order = Window.orderBy(F.col("n").desc(), F.col("a").asc_nulls_first())  # of at most ``top`` rows
    return best.select(F.row_number().over(order).alias("rank"), F.when(F.col("key") != "", atom_text(F.col("a"))).alias("value"), "n")


def field_hints(top: DataFrame) -> DataFrame:
    """(path, url_like, image_like, natural_language_like) from each path's most frequent values."""
    s = F.trim("value")
    full = top.where(F.length(s) > 0)
    n = F.count(F.lit(1))
    return full.groupBy("path").agg(
        hints.ratio_like(F.count_if(hints.is_url(s)), n, 0.6).alias("url_like"), hints.ratio_like(F.count_if(hints.is_image_url(s)), n, 0.5).alias("image_like"),
        hints.ratio_like(F.count_if(hints.is_sentence(s)), n, 0.5).alias("natural_language_like"),
    )


@dataclass(frozen=True)
class Profile:
    rows: int
    invalid: int
    truncated: int
    fields: DataFrame


def field_stats(rows: DataFrame, top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """``summary`` with distinct_n, top_values, json_types and hints, for each path of ``rows`` (v)."""
    found = nodes(rows, depth)
    counts = value_counts(found).persist()
    best = top_values(counts, found, top)
    packed = best.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top_values"))
    types = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.array(*(F.col(f"n_{t}") for t in TYPES))), lambda _, n: n > 0)
    out = folded(counts).join(extremes(found), "path", "left").join(packed, "path", "left").join(field_hints(best), "path", "left")
    none = F.array().cast("array<struct<value:string,count:bigint>>")
    return out.select(
        "path", types.alias("json_types"), "present", "non_null", "distinct_n", "min_v", "max_v", "len_min", "len_max", "len_avg",
        F.coalesce("top_values", none).alias("top_values"), "is_array",
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("url_like", "image_like", "natural_language_like")),
    )


def profile(rows: DataFrame, top: int = TOP, depth: int = DEPTH, most: int = FIELDS) -> Profile:
    """Statistics of the ``most`` most present paths of ``rows`` (body, valid, v)."""
    seen = rows.agg(F.count_if("valid").alias("rows"), F.count_if(~F.col("valid")).alias("invalid")).first()
    good = rows.where("valid")
    stats = field_stats(good, top, nesting(good, depth)).persist()
    n = stats.count()
    return Profile(seen["rows"], seen["invalid"], max(0, n - most), stats.orderBy(F.col("present").desc(), "path").limit(most))
