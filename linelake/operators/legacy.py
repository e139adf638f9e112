"""The older profiles: top-level fields only, values compared as texts; and the documents made from statistics."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linelake.functions import hints
from linelake.functions.json import atom_text, once
from linelake.operators.nodes import held

# fixed values
TYPE_NAMES = {"integer": "int", "real": "float", "true": "bool", "false": "bool", "text": "string", "array": "array", "object": "object"}
ELEMENT_TYPES = {"integer": "int", "real": "float", "true": "bool", "false": "bool", "text": "string", "array": "array", "object": "array", "null": "other"}
DISTINCT_CAP, PUSHED_CAP = 100_000, 500
SAMPLES = 256


def text_stats(found: DataFrame, pushed: bool = False) -> DataFrame:
    """(path, total, nulls, distinct, distinct_capped, len_min, len_max): values are equal if their texts are, so 1, "1", 1.0 and true are one
    and false is the empty text.

    pushed: as values pushed one by one were counted: empty texts are nulls, nulls aren't in the total, lengths in characters (else bytes).
    """
    text = F.when(F.col("json_type") == "false", "").otherwise(atom_text(F.col("atom")))
    empty = (F.col("json_type") == "null") | (F.lit(pushed) & (F.col("json_type") == "text") & (text == ""))
    length = F.length("atom.txt") if pushed else F.octet_length("atom.txt")
    rows = found.select("path", empty.alias("empty"), text.alias("text"), F.when(~empty, length).alias("length"))
    total = F.count_if(~F.col("empty")) if pushed else F.count(F.lit(1))
    sums = rows.groupBy("path").agg(total.alias("total"), F.count_if("empty").alias("nulls"), F.min("length").alias("len_min"), F.max("length").alias("len_max"))
    n = rows.where("not empty and text is not null").select("path", F.sha2("text", 256).alias("key")).distinct().groupBy("path").agg(F.count(F.lit(1)).alias("distinct"))
    cap = PUSHED_CAP if pushed else DISTINCT_CAP
    out = sums.join(n, "path", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    return out.withColumn("distinct_capped", F.col("distinct") > cap).withColumn("unique", F.when(~F.col("distinct_capped"), F.col("distinct") == F.col("total")))


def array_stats(rows: DataFrame) -> DataFrame:
    """(path, arrays, elements, elem_types, elem_len_min, elem_len_max, elem_len_avg, elem_distinct, elem_capped) of the top-level fields of ``rows`` (v)
    that hold arrays or objects somewhere; an object counts as the array of its values.

    Lengths are bytes of texts, null without texts. Scalars are equal if their texts are, as in ``text_stats``, and null and false are the empty text;
    elem_distinct goes up to DISTINCT_CAP. Elements are counted by value first, so a frequent one costs a task no more than others.
    """
    found = held(rows)
    kind, there = F.col("json_type"), F.col("pos").isNotNull()
    text = F.when(kind.isin("null", "false"), "").otherwise(atom_text(F.col("atom")))
    size = F.when(there & (kind == "text"), F.octet_length("atom.txt").cast("long"))
    each = found.select(
        "path", F.when(there, F.sha2(text, 256)).alias("key"), F.when(there, kind).alias("kind"), (F.coalesce("pos", F.lit(0)) == 0).alias("first"), there.alias("there"), size.alias("size"))
    counted = each.groupBy("path", "key", "kind").agg(
        F.count_if("first").alias("arrays"), F.count_if("there").alias("elements"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("bytes"), F.count("size").alias("texts"))
    of_key = counted.groupBy("path", "key").agg(
        *(F.sum(c).alias(c) for c in ("arrays", "elements", "bytes", "texts")), F.min("least").alias("least"), F.max("most").alias("most"), *(F.max(F.col("kind") == t).alias(f"is_{t}") for t in ELEMENT_TYPES))
    names = F.array(*(F.when(F.max(f"is_{t}"), F.lit(n)) for t, n in ELEMENT_TYPES.items()))
    return of_key.groupBy("path").agg(
        F.sum("arrays").alias("arrays"), F.sum("elements").alias("elements"), F.array_distinct(F.array_compact(names)).alias("elem_types"), F.min("least").alias("elem_len_min"), F.max("most").alias("elem_len_max"),
        F.try_divide(F.sum("bytes"), F.sum("texts")).alias("elem_len_avg"), F.least(F.count("key"), F.lit(DISTINCT_CAP)).alias("elem_distinct"), (F.count("key") > DISTINCT_CAP).alias("elem_capped"),
    )


def boolean_fields(found: DataFrame) -> DataFrame:
    """(path, boolean_like) of nodes: only true and false besides null, or some texts among at most six values that are all blank or words for yes and no.
    Paths with nothing but nulls have no row."""
    text = F.when(F.col("json_type") == "false", "").otherwise(atom_text(F.col("atom")))
    word = F.lower(F.trim("text"))
    values = found.where("json_type != 'null'").select("path", "json_type", text.alias("text"))
    known = F.coalesce((word == "") | word.isin(*hints.BOOLEAN_WORDS), F.lit(True))
    by = values.groupBy("path", F.sha2("text", 256).alias("key")).agg(
        F.bool_and(F.col("json_type").isin("true", "false")).alias("logic"), F.bool_or(F.col("json_type") == "text").alias("texts"), F.bool_and(known).alias("known"))
    few = F.bool_or("texts") & (F.count("key") <= 6) & F.bool_and("known")
    return by.groupBy("path").agg((F.bool_and("logic") | few).alias("boolean_like"))


def distribution(counts: DataFrame, most: int = 100, longest: int = 64) -> DataFrame:
    """(path, value, n) of fields with at most ``most`` values, for values of at most ``longest`` characters."""
    few = counts.groupBy("path").agg(F.count("key").alias("d")).where(F.col("d") <= most).select("path")
    value = F.expr("substring(key, 3)")
    return counts.where("not startswith(key, 'h:')").join(few, "path", "left_semi").select("path", value.alias("value"), "n").where(F.length("value") <= longest)


def sampled_hints(values: DataFrame, locale: str | None = None) -> DataFrame:
    """natural-language and locale hints of ``values`` (path, at, s): of each path's first SAMPLES texts by ``at``.

    Code, texts without a space and those of under three words count as looked at, not as language.
    """
    order = Window.partitionBy("path").orderBy("at", "s")  # limited before the shuffle, so no path gathers
    first = values.select("path", "at", "s").withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLES).select("path", "s")
    first = once(first, words=F.filter(hints.words(F.trim("s")), lambda w: w != ""))
    s = F.trim("s")
    words = F.size("words")
    spoken = ~hints.is_code(s) & F.contains(s, F.lit(" ")) & (words >= 3)
    few_digits = F.regexp_count(s, F.lit(r"\d")) <= F.greatest(F.lit(2), F.floor(F.octet_length(s) / 25))
    hit = spoken & few_digits & ~hints.is_url(s)
    sums = {n: F.coalesce(F.sum(F.when(spoken, hints.stopword_hits(F.col("words"), n))), F.lit(0)).alias(n) for n in hints.STOPWORDS}
    g = first.where(F.length(s) > 0).groupBy("path").agg(F.count(F.lit(1)).alias("checked"), F.count_if(hit).alias("hits"), *sums.values())
    ratio = F.col("hits") / F.col("checked")
    guess = F.lit(locale) if locale else hints.locale_of({n: F.col(n) for n in sums})
    return g.select("path", "checked", "hits", F.round(ratio, 4).alias("ratio"), (ratio >= 0.35).alias("natural_language_like"), F.when(ratio >= 0.35, guess).alias("locale"))


def split_scores(values: DataFrame, preferred: str | None = None) -> DataFrame:
    """(path, delimiter, checked, hits, ratio, parts_avg, score, enabled, confidence) for the delimiters that split some of ``values`` (path, s).

    Looked at are texts of one line that aren't blank, urls or JSON.
    """
    s = F.col("s")
    one_line = (F.trim(s) != "") & ~F.regexp_like(s, F.lit(r"[\r\n]")) & ~hints.is_url(s) & ~F.regexp_like(s, F.lit(r"^\s*[{\[]"))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("delimiter"), hints.parts(s, d).alias("parts")) for d in hints.DELIMITERS)))
    one = values.where(one_line).select("path", each.alias("x")).select("path", "x.*")
    cut, lengths = F.col("parts").isNotNull(), F.transform("parts", F.length)
    g = one.groupBy("path", "delimiter").agg(
        F.count(F.lit(1)).alias("checked"), F.count("parts").alias("hits"), F.sum(F.when(cut, F.size("parts"))).alias("n"),
        F.sum(F.when(cut, F.aggregate(lengths, F.lit(0), lambda a, b: a + b))).alias("chars"), F.max(F.when(cut, F.array_max(lengths))).alias("longest"),
    )
    ratio, average, token = F.col("hits") / F.col("checked"), F.col("n") / F.col("hits"), F.col("chars") / F.col("n")
    on = hints.split_enabled(ratio, average, F.col("longest"))
    return g.where("hits > 0").select(
        "path", "delimiter", "checked", "hits", F.round(ratio, 4).alias("ratio"), F.round(average, 3).alias("parts_avg"),
        F.round(hints.split_score(F.col("delimiter"), ratio, average, token, F.col("longest"), preferred), 4).alias("score"), on.alias("enabled"), F.round(hints.split_confidence(ratio, average, on), 4).alias("confidence"),
    )


def split_candidates(values: DataFrame, preferred: str | None = None, disabled: Collection[str] = ()) -> DataFrame:
    """The best delimiter of each path; of equals the first of the fixed list. Paths in ``disabled`` aren't looked at: theirs is a row that only says so."""
    if disabled:
        off = F.col("path").isin(*disabled)
        none = values.where(off).select("path", F.lit(False).alias("enabled")).distinct()
        return split_candidates(values.where(~off), preferred).unionByName(none, allowMissingColumns=True)
    order = F.array_position(F.array(*map(F.lit, hints.DELIMITERS)), F.col("delimiter"))
    scores = split_scores(values, preferred)
    rest = [c for c in scores.columns if c != "path"]
    return scores.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("score", -order)).alias("x")).select("path", "x.*")


def overridden(stats: DataFrame, overrides: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """``stats`` with what a caller knows of fields: ``{path: {column: value}}`` replaces values of existing columns, or adds ``storage_hint``."""
    out = stats if "storage_hint" in stats.columns else stats.withColumn("storage_hint", F.lit(None).cast("string"))
    for path, known in overrides.items():
        for column, value in known.items():
            if column not in out.columns:
                raise ValueError(f"no such column: {column}")
            out = out.withColumn(column, F.when(F.col("path") == path, F.lit(value)).otherwise(F.col(column)))
    return out


def legacy_field(row: Mapping[str, Any]) -> dict[str, Any]:
    """A row of field statistics under the older names; elements: those of ``element_stats``, for an array."""
    kinds = list(dict.fromkeys(TYPE_NAMES[t] for t in row["json_types"] if t != "null"))
    top = [(v["value"], v["count"]) for v in row["top_values"]]
    values = [v for v, _ in top]
    words = {str(v).strip().lower() for v in values} - {""}
    boolean = bool(words) and len(words) <= 4 and words <= set(hints.BOOLEAN_WORDS_MODEL) if values else kinds == ["bool"]
    container = bool({"array", "object"} & set(kinds))
    storage = "json" if container else {"bool": "bool", "int": "int", "float": "float"}.get(kinds[0], "string") if len(kinds) == 1 else "string"
    inside = row.get("elements") if row["is_array"] else None
    arrays = {"arrayStats": {"elements": inside["count"], "elemDistinct": inside["distinct"], "avgPerRow": inside["avg_per_row"]}} if inside else {}
    return {
        "total": row["present"], "nulls": max(0, row["present"] - row["non_null"]), "types": kinds, "distinct": row["distinct_n"], "distinctCapReached": False,
        "min": row["min_v"], "max": row["max_v"], "stringLengths": {"min": row["len_min"], "max": row["len_max"], "avg": row["len_avg"]}, "topValues": dict(top),
        "distinctValues": sorted(map(str, values)) if row["distinct_n"] <= len(values) else None, "isArray": bool(row["is_array"]), "urlLike": row["url_like"], "imageLike": row["image_like"],
        "naturalLanguageLike": row["natural_language_like"], "jsonLike": False, "booleanLike": boolean,
        "facetCandidate": 1 <= row["distinct_n"] <= 64 and (row["len_max"] or 0) <= 128 and not container, "storageHint": storage, **arrays,
    }


def document(name: str, records: int, rows: list[Mapping[str, Any]], output: str | None = None, tags: tuple[str, ...] = ()) -> dict[str, Any]:
    """The profile as one document."""
    return {"input": name, "output": output, "recordCount": records, "tags": list(tags), "fields": {r["path"]: legacy_field(r) for r in rows}}


def short(text: str, most: int = 40) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def labels(field: Mapping[str, Any]) -> dict[str, str]:
    """What a table of fields shows."""
    lengths = field["stringLengths"]
    top = next(iter(field["topValues"]), None)
    return {
        "types": "|".join(field["types"]), "distinct": f"{field['distinct']}{' (capped)' if field['distinctCapReached'] else ''}",
        "range": f"{lengths['min']}–{lengths['max']} chars" if lengths["max"] is not None else "", "top": short(str(top)) if top is not None else "",
        "hints": " ".join(n for n in ("urlLike", "imageLike", "naturalLanguageLike", "booleanLike", "facetCandidate") if field[n]),
    }
