"""A log's key index: the last row of each key, with facet attributes; lookups and facet counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelake.functions.json import checked_name, extracted, once
from linelake.session import json_settings


def keyed(rows: DataFrame, pk: Sequence[str] = ("id",), facets: Sequence[str] = (), order: Sequence[str] = ("line_no",), several: bool = False) -> DataFrame:
    """(pk, attrs, and the ``order`` columns and offset if present) of valid ``rows`` (body, v, line_no).

    Several key fields are joined by colons; if one is missing or null, the key is ``#`` and the line number; with the file's name before the
    number where rows come from ``several`` files, as numbers begin anew in each. attrs is null without facets.
    """
    names = list(dict.fromkeys([*pk, *facets]))
    with json_settings(rows.sparkSession):
        kept = list(dict.fromkeys([*order, *(c for c in ("file", "offset", "line_no") if c in rows.columns)]))
        good = rows.where("valid").select("body", "v", *kept)
        good = once(good, **{f"_v{i}": F.try_variant_get("v", "$." + checked_name(n), "variant") for i, n in enumerate(names)})
        good = once(good, **{f"_k{i}": F.schema_of_variant(f"_v{i}") for i in range(len(names))})
        good = once(good, **{f"_f{i}": extracted(F.col("body"), F.col(f"_v{i}"), F.col(f"_k{i}"), n) for i, n in enumerate(names)})
        field = {n: F.col(f"_f{i}") for i, n in enumerate(names)}
        parts: list[Column] = []
        for name in pk:
            parts += [F.lit(":"), field[name]] if parts else [field[name]]
        attrs = F.map_from_arrays(F.array(*map(F.lit, facets)), F.array(*(field[f] for f in facets))) if facets else F.lit(None).cast("map<string,string>")
        # line numbers begin anew in each file, so a row without a key is named by file and line where there are several files
        many = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":")) if "file" in rows.columns and several else F.lit("")
        own = F.concat(F.lit("#"), many, F.col("line_no").cast("string"))
        out = good.select(F.coalesce(F.concat(*parts), own).alias("pk"), attrs.alias("attrs"), *kept)
        out.schema  # noqa: B018
    return out


def last_of_each(entries: DataFrame, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """The entry of the greatest ``order`` for each pk. Combines before the shuffle, so a hot key is no hot task; merging an old index with
    new entries is the same operation on their union."""
    rest = [c for c in entries.columns if c != "pk"]
    return entries.groupBy("pk").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select("pk", *(F.col("x")[c].alias(c) for c in rest))


def facet_counts(index: DataFrame, *facets: str) -> DataFrame:
    """(facet, value, n): keys by value; a missing value is null. Keys without attributes aren't counted."""
    for f in facets:
        checked_name(f)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col("attrs")[f].alias("value")) for f in facets)))
    return index.where("attrs is not null").select(each.alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def fetch(index: DataFrame, rows: DataFrame, condition: Column, on: Sequence[str] = ("line_no",)) -> DataFrame:
    """(pk, and ``rows``) of the keys whose attributes or pk satisfy ``condition``."""
    # sorted on both sides: dropping the parsed value makes Spark take a log for a small table, and any number of keys may satisfy the condition
    return rows.hint("merge").join(index.where(condition).select("pk", *on), list(on))


def browse(rows: DataFrame, fields: dict[str, str] | Sequence[str]) -> DataFrame:
    """line_no and a column for each path, as text or of the type given: the flat view of a log's scalar fields."""
    kinds = fields if isinstance(fields, dict) else dict.fromkeys(fields, "string")
    with json_settings(rows.sparkSession):
        columns = [F.try_variant_get("v", "$." + path, kind).alias(path) for path, kind in kinds.items()]
        out = rows.where("valid").select(*(c for c in ("line_no",) if c in rows.columns), *columns)
        out.schema  # noqa: B018
    return out


def first_by_token(rows: DataFrame, order: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """The first row of each ``token``, in ``order``, of those not in ``seen`` (token); without an order, the first as ``rows`` stand. Rows without a
    token are all kept."""
    columns = rows.columns
    if not order:
        rows, order = rows.withColumn("_at", F.monotonically_increasing_id()), ["_at"]
    named = rows.where("token is not null")
    if seen is not None:
        named = named.join(seen.select("token"), "token", "left_anti")
    first = named.groupBy("token").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "token")), F.struct(*order)).alias("x"))
    return first.select("token", "x.*").select(*columns).unionByName(rows.where("token is null").select(*columns))
