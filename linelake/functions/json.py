"""Column functions over JSON text and VARIANT values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the host language's trim strips.
BLANKS = " \t\n\r\0\x0b"
_END = "linelake:end-of-row"
_LONG = 1 << 63
#: Texts up to so many characters stand for themselves when values are compared and counted; longer ones by a 256-bit digest.
SHORT = 128


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once for a row, however often it is used: the optimizer doesn't copy expressions out of a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def paired(body: Column) -> Column:
    """The text as the first of two elements of an array, parsed: Spark's parsers accept what follows a first value, but here anything else
    after it moves or hides the second."""
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit(f',"{_END}"]')))


def unpaired(pair: Column) -> tuple[Column, Column]:
    """(valid, value) of ``paired``: whether all of the text is one JSON value, and that value."""
    ends = (F.try_variant_get(pair, "$[1]", "string") == _END) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    valid = F.coalesce(ends, F.lit(False))
    return valid, F.when(valid, F.try_variant_get(pair, "$[0]", "variant"))


def strict(body: Column) -> tuple[Column, Column]:
    """(valid, value): whether all of ``body`` is one JSON value, and that value. Over tables, ``parsed`` parses once for both."""
    return unpaired(paired(body))


def json_type(schema: Column) -> Column:
    """The JSON type's name from ``schema_of_variant``; booleans are ``boolean`` here, as their histogram names need the value."""
    whole = (F.regexp_extract(schema, r"^DECIMAL\((\d+),0\)$", 1) != "") & (F.regexp_extract(schema, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int") >= 19)
    return (
        F.when(schema == "BIGINT", "integer").when(schema == "STRING", "text").when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean")
        .when(F.startswith(schema, F.lit("ARRAY")), "array").when(F.startswith(schema, F.lit("OBJECT")), "object").when(whole, "integer").otherwise("real")
    )


def number_text(num: Column, big: Column) -> Column:
    """Equal numbers have equal texts: whole ones as integers, others as doubles."""
    return F.coalesce(big.cast("string"), num.cast("string"))


def atom(value: Column, kind: Column) -> Column:
    """struct(rank, num, big, txt) of a scalar: numbers, with booleans as 1 and 0, come before texts; null for containers and null."""
    logic = F.try_variant_get(value, "$", "boolean").cast("int")
    num = F.when(kind.isin("integer", "real"), F.try_variant_get(value, "$", "double")).when(kind == "boolean", logic.cast("double"))
    exact = F.when(kind == "integer", F.try_variant_get(value, "$", "bigint"))
    big = F.coalesce(exact, F.when((num == F.floor(num)) & (F.abs(num) < float(_LONG)), num.try_cast("bigint")))
    text = F.when(kind == "text", F.try_variant_get(value, "$", "string"))
    scalar = kind.isin("integer", "real", "boolean", "text")
    return F.when(scalar, F.struct(F.when(kind == "text", 1).otherwise(0).alias("rank"), num.alias("num"), big.alias("big"), text.alias("txt")))


def atom_key(a: Column) -> Column:
    """A text that is the same for equal atoms: ``n:`` and a number, ``t:`` and a short text, or ``h:`` and a long text's digest."""
    long = F.concat(F.lit("h:"), F.sha2(a["txt"], 256))
    text = F.when(F.length(a["txt"]) > SHORT, long).otherwise(F.concat(F.lit("t:"), a["txt"]))
    return F.when(a["rank"] == 0, F.concat(F.lit("n:"), number_text(a["num"], a["big"]))).when(a["rank"] == 1, text)


def atom_text(a: Column) -> Column:
    return F.coalesce(a["txt"], number_text(a["num"], a["big"]))


def path_step(key: Column) -> Column:
    """A key as it stands in a path: bare if it is a plain word, else quoted."""
    return F.when(F.regexp_like(key, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*$")), key).otherwise(F.concat(F.lit('"'), key, F.lit('"')))


def checked_name(name: str) -> str:
    """A key or facet name: letters, digits, underscores, and dots between the steps of a path."""
    if not re.fullmatch(r"[A-Za-z0-9_.]+", name):
        raise ValueError(f"not a field name: {name!r}")
    return name


def extracted(body: Column, value: Column, kind: Column, name: str) -> Column:
    """A field as text: numbers as written, booleans as 1 and 0, containers as JSON; null where missing or null. value: the field's; kind: its
    ``schema_of_variant``. The text is only looked at again for what must stand as written."""
    get = lambda t: F.try_variant_get(value, "$", t)
    return (
        F.when(kind == "STRING", get("string")).when(kind == "BIGINT", get("bigint").cast("string")).when(kind == "BOOLEAN", get("boolean").cast("int").cast("string"))
        .when(value.isNotNull() & (kind != "VOID"), F.get_json_object(body, "$." + checked_name(name)))
    )
