"""Flattening: every JSON value of a log's rows with its path."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelake.functions.json import atom, json_type, once, path_step
from linelake.session import json_settings

DEPTH = 6


def _typed(values: DataFrame) -> DataFrame:
    """``values`` (value, ...) with kind, the JSON type, read once."""
    return once(once(values, schema=F.schema_of_variant("value")), kind=json_type(F.col("schema"))).drop("schema")


def _read(values: DataFrame, *keys: str) -> DataFrame:
    """json_type and atom of ``values`` (value, kind)."""
    logic = F.try_variant_get("value", "$", "boolean").cast("string")
    name = F.when(F.col("kind") == "boolean", logic).otherwise(F.col("kind"))
    return once(values, json_type=name, atom=atom(F.col("value"), F.col("kind"))).select(*keys, "json_type", "atom")


def nodes(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(path, depth, json_type, atom) of all values of ``rows`` (v) but objects, roots, and what is inside arrays.

    One explode for each level of nesting; a level is only fed the objects of the level above. A dot counts as a level, also one in a
    quoted key. Keys with ``[`` are left out.
    """
    spark = rows.sparkSession
    with json_settings(spark):
        level = rows.select(F.col("v").alias("value"), F.lit("").alias("path"), F.lit(0).alias("depth")).where("value is not null")
        out = None
        for n in range(depth):
            inner = level.select(F.col("value").alias("parent"), F.col("path").alias("above"), F.col("depth").alias("up"))
            each = inner.lateralJoin(spark.tvf.variant_explode(F.col("parent").outer())).where("key is not null").where(~F.contains("key", F.lit("[")))
            dots = F.length("key") - F.length(F.replace("key", F.lit("."), F.lit("")))
            step = path_step(F.col("key"))
            level = _typed(each.select(
                F.col("value"), F.when(F.col("above") == "", step).otherwise(F.concat("above", F.lit("."), step)).alias("path"), (F.col("up") + 1 + dots).cast("int").alias("depth"),
            )).where(F.col("depth") <= depth)
            found = _read(level.where("kind != 'object'"), "path", "depth")
            out = found if out is None else out.unionByName(found)
            level = level.where("kind = 'object'").select("value", "path", "depth")
        out.schema  # noqa: B018
    return out


def nesting(rows: DataFrame, most: int = DEPTH) -> int:
    """How many levels of objects ``rows`` (v) have, at most ``most``: from one merged schema. Where fields are objects here and scalars
    there the schema doesn't say, and the answer is ``most``."""
    with json_settings(rows.sparkSession):
        schema = rows.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"] or ""
    deepest, open_kinds = 1, []
    for kind in re.findall(r"\w*<|>|\bVARIANT\b", re.sub("`[^`]*`", "", schema)):
        if kind == ">":
            open_kinds.pop()
        elif "ARRAY<" not in open_kinds and kind == "VARIANT":
            return most
        elif kind != "VARIANT":
            open_kinds.append(kind)
            if "ARRAY<" not in open_kinds:
                deepest = max(deepest, len(open_kinds))
    return min(deepest, most)


def elements(rows: DataFrame, path: str) -> DataFrame:
    """(json_type, atom) of the elements of the array at ``path``, of rows where it is one."""
    spark = rows.sparkSession
    with json_settings(spark):
        values = rows.select(F.try_variant_get("v", "$." + path, "variant").alias("a"))
        each = values.lateralJoin(spark.tvf.variant_explode(F.col("a").outer())).where("key is null")
        out = _read(_typed(each.select("value")))
        out.schema  # noqa: B018
    return out


def held(rows: DataFrame) -> DataFrame:
    """(path, pos, json_type, atom) of what the top-level arrays and objects of ``rows`` (v) hold; an empty one gives one row without pos."""
    spark = rows.sparkSession
    with json_settings(spark):
        fields = rows.select(F.col("v").alias("row")).lateralJoin(spark.tvf.variant_explode(F.col("row").outer())).where("key is not null")
        typed = once(fields.select(path_step(F.col("key")).alias("path"), F.col("value").alias("field")), within=json_type(F.schema_of_variant("field")))
        holding = typed.where("within in ('array', 'object')").select("path", "field")
        each = holding.lateralJoin(spark.tvf.variant_explode_outer(F.col("field").outer()))
        out = _read(_typed(each.select("path", "pos", "value")), "path", "pos")
        out.schema  # noqa: B018
    return out
