"""Substring dedup over sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, release_memory, staged, table, text_key

#: A span has so many sentences and words at least: a notice or a line that many documents share is shorter, a passage longer.
SENTENCES = 2
WORDS = 20
PLACE = ["doc_id", "key", "at", "n"]
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")


def sentences(text: str | None) -> list[str]:
    """The text cut after each stop, exclamation or question mark and line end; the parts joined are the text."""
    return _SENTENCE.findall(text or "")


def spans(parts: list[str], least: int = SENTENCES, words: int = WORDS) -> Iterator[tuple[int, int, int]]:
    """(hash of 96 bits, first sentence, number of sentences) of the shortest runs that have ``least`` sentences and ``words`` words.

    That is for each sentence the shortest such run that starts with it and the shortest that ends with it. In any longer run each sentence
    starts a run within it or lies in the one that ends with it, so these cover all that longer runs would. A text too short for a run has none.
    """
    norm = [" ".join(p.lower().split()) for p in parts]
    count = [n.count(" ") + 1 if n else 0 for n in norm]
    total = np.concatenate([[0], np.cumsum(count)])
    n = len(parts)
    ends = np.maximum(np.searchsorted(total, total[:-1] + words), np.arange(n) + least)
    starts = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, np.arange(1, n + 1) - least)
    forth = np.flatnonzero(ends <= n)
    back = np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate([forth * (n + 1) + ends[forth], starts[back] * (n + 1) + back + 1]))
    for x in both.tolist():
        i, e = divmod(x, n + 1)
        yield xxhash.xxh3_128_intdigest("\n".join(norm[i:e]).encode("utf-8", "replace")) >> 32, i, e - i


def _placed(found: Iterator[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The places (first sentence, number of sentences) of each of a text's spans: the first as it is, the later ones joined where they touch.

    Later ones go in any case if the span is repeated, so only the sentences that they cover together count. A line that fills a text is two
    places then, however often it stands there.
    """
    places: dict[int, list[tuple[int, int]]] = {}
    for h, i, m in found:
        own = places.setdefault(h, [])
        if len(own) > 1 and i <= sum(own[-1]):
            own[-1] = (own[-1][0], i + m - own[-1][0])
        else:
            own.append((i, m))
    return places


def _spans(least: int, words: int):
    """The spans of some rows at a time: one row for equal ones, with the place of the first, and the places of the others in ``more``."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 250):
                some = rows.iloc[at : at + 250]
                places: dict[int, list[tuple[int, int, int, int]]] = {}
                for d, k, t in zip(some["doc_id"].tolist(), some["key"].tolist(), some["text"]):
                    for h, own in _placed(spans(sentences(t), least, words)).items():
                        places.setdefault(h, []).extend((d, k, i, m) for i, m in own)
                found = []
                for h, own in places.items():
                    own = sorted(set(own)) if len(own) > 1 else own
                    more = [dict(zip(PLACE, x)) for x in own[1:]] or None
                    found.append(((h >> 32) - (1 << 63), (h & 0xFFFFFFFF) - (1 << 31), *own[0], more))
                yield pd.DataFrame(found, columns=["h", "check", *PLACE, "more"]).astype({"doc_id": some["doc_id"].dtype})
        release_memory()

    return of


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]))
def _cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for t, found in zip(text, runs):
        if found is None or t is None:
            out.append((None, 0))
            continue
        parts = sentences(t)
        gone = np.zeros(len(parts) + 1, np.int32)
        for r in found:
            gone[r["at"]] += 1
            gone[r["at"] + r["n"]] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append(("".join(p for p, g in zip(parts, gone) if not g), int(gone.sum())))
    return pd.DataFrame(out, columns=["text", "n_removed"])


def remove_repeats(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with the text less all sentences that a repeated span covers, and n_removed, the number of these sentences.

    A span is a run of at least ``least`` sentences and ``words`` words; each sentence of a longer run that repeats is covered by spans within it.
    Spans are equal if their sentences' words are, in any case. The first of equal spans, by doc_id (null last), then by a hash of the
    text, then by place, keeps its sentences; all others lose theirs, in other documents and further on in the same one. Rows with equal
    id and text count as one document and end alike. Null texts stay null and empty ones empty. Texts may be of any length that a row can
    hold. Other columns are carried along, whatever their names (an n_removed of the input is replaced). An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").where(F.length("text") > 0)
    schema = "h long, check int, doc_id long, key long, at int, n int, more array<struct<doc_id: long, key: long, at: int, n: int>>"
    known = keyed.where("doc_id is not null").mapInPandas(_spans(least, words), schema)
    unknown = keyed.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "key", "text").mapInPandas(_spans(least, words), schema)
    found = staged(known.unionByName(unknown.withColumn("doc_id", F.lit(None).cast("long"))), "spans")
    null = F.col("doc_id").isNull()
    place_of = lambda x: F.struct(null.alias("a"), F.when(null, F.lit(0)).otherwise(x("doc_id")).alias("b"), x("key").alias("c"), x("at").alias("d"))
    place, farthest = place_of(F.col), F.try_element_at("more", F.lit(-1))
    last = F.coalesce(F.when(farthest.isNotNull(), place_of(lambda name: farthest[name])), place)
    # written, so that both sides of the join are plain exchanges, which Spark can split where one span is very frequent
    repeated = staged(
        found.groupBy("h", "check").agg(F.min(place).alias("first"), F.max(last).alias("last")).where("first != last").select("h", "check", "first"), "repeated"
    )
    # joined as they are, some rows' equal spans in one row, so a span of many documents gives far fewer rows; taken apart after
    every = F.concat(F.array(F.struct(*PLACE)), F.coalesce("more", F.array()))
    each = found.join(repeated, ["h", "check"]).where(last > F.col("first")).select("first", null.alias("null"), F.explode(every).alias("x")).select("first", "null", "x.*")
    each = each.select("first", F.when(~F.col("null"), F.col("doc_id")).alias("doc_id"), "key", "at", "n")
    runs = (
        each.where(place > F.col("first"))
        .groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    )
    columns = docs.columns
    cut = _cut(F.when(F.col("runs").isNotNull(), F.col("text")), F.col("runs"))
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col("d")) & text_key(F.col("text")).eqNullSafe(F.col("k")), "left")
    joined = joined.select(*[docs[c] for c in columns], cut.alias("_cut"))
    others = [c for c in columns if c not in ("text", "n_removed")]
    return joined.select(*others, F.coalesce("_cut.text", "text").alias("text"), F.coalesce("_cut.n_removed", F.lit(0)).alias("n_removed"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")
