"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, staged, table, text_key

WINDOW = 10
#: Words of a shingle, the token that documents and windows are joined on.
SHINGLE = 3
#: So many windows, at most, are broadcast at once; more take more scans. A window has ten words, so that is some 40 MB.
BROADCAST_WINDOWS = 200_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in order; null gives no words."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _GAP), ""), F.array().cast("array<string>"))


def _split(text: Column) -> Column:
    """Words of a text in order after an empty one, which stands at place 0; another empty one may stand at the end. Cheaper than ``words``."""
    return F.split(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit("")))), _GAP)


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, win): each run of ``size`` words, or all words of a shorter item."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return (
        items.select("item_id", words(F.col("text")).alias("w")).where(n > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("win"))
        .distinct()
    )


def _shingle(w: Column, at: Column, n: int) -> Column:
    """A hash of the ``n`` words from place ``at`` (from 0); null where there are fewer."""
    parts = [F.get(w, at + i) for i in range(n)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(n), *parts))


def _shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs`` (w, ...) with a row for each place of ``w`` and each of ``lengths``: at, token. w begins with an empty word, which is no token."""
    at = F.col("at")
    each = docs.select("*", F.posexplode_outer("w").alias("at", "word"))  # outer: else w is made twice, once to see if it is empty
    tokens = [_shingle(F.col("w"), at, n) for n in lengths]
    token = F.when(at > 0, tokens[0])
    if len(tokens) > 1:
        token = F.explode(F.when(at > 0, F.array(*tokens)).otherwise(F.array(F.lit(None).cast("long"))))
    return each.select(*docs.columns, "at", token.alias("token"))


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast where ``n``, the counted rows, is within the bound."""
    return F.broadcast(df) if n <= BROADCAST_WINDOWS else df


def _prefixes(distinct: DataFrame, corpus: DataFrame, lengths: list[int], size: int) -> DataFrame:
    """(win_id, win, token, offset): of the shingles of each window the one that is rarest in ``corpus``, at its first place; ties by the shingle.

    Windows none of whose shingles' rarest occurs are left out: they occur nowhere.
    """
    n = F.least(F.size("win"), F.lit(SHINGLE))
    at = F.explode(F.sequence(F.lit(0), F.size("win") - n)).alias("offset")
    each = distinct.select("win_id", "win", n.alias("n"), at)
    token = F.lit(None).cast("long")
    for k in lengths:
        token = F.when(F.col("n") == k, _shingle(F.col("win"), F.col("offset"), k)).otherwise(token)
    each = staged(each.select("win_id", "offset", token.alias("token")), "shingles")
    wanted = each.select("token").distinct()
    counts = _shingles(corpus, lengths).select("token").where("token is not null").join(_small(wanted, wanted.count()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rare = each.join(counts, "token", "left").groupBy("win_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("rare"))
    return staged(rare.where("rare.df > 0").select("win_id", "rare.token", "rare.offset").join(distinct, "win_id"), "prefix")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(found, owners): ``found`` (doc_id, key, n_words, start, size, win_id) has for each input row one row without a window, and one for each
    place where a window occurs; ``owners`` (win_id, item_id) says whose windows those are.

    Tokens are shingles of three words (of all words of a shorter window), ordered by rarity over the whole corpus. A window is contained in a
    document only if its rarest shingle is: that is its necessary prefix. A document's shingles look up the prefixes, the place must leave room
    for the whole window before and after it, then the window's words are compared. Windows are looked up in blocks that are small enough
    to be broadcast, so no text and no shingle is shuffled, however frequent; more blocks take more scans.
    """
    own = staged(windows(items, size).withColumn("win_id", F.xxhash64("win")), "windows")
    distinct = own.select("win_id", "win").distinct()
    lengths = sorted(r.n for r in distinct.select(F.least(F.size("win"), F.lit(SHINGLE)).alias("n")).distinct().collect()) or [1]
    corpus = docs.select("doc_id", text_key(F.col("text")).alias("key"), _split(F.col("text")).alias("w"))
    prefix = _prefixes(distinct, corpus, lengths, size)
    blocks = max(1, -(-prefix.count() // BROADCAST_WINDOWS))
    start = F.col("at") - F.col("offset") - 1  # w begins with an empty word
    hit = F.col("win").isNotNull() & (start >= 0) & (start + F.size("win") < F.size("w")) & (F.slice("w", start + 2, F.size("win")) == F.col("win"))
    found = None
    for block in range(blocks):
        mine = prefix.where(F.pmod(F.xxhash64("win_id"), F.lit(blocks)) == block) if blocks > 1 else prefix
        part = _shingles(corpus, lengths).join(F.broadcast(mine), "token", "left").where(hit | (F.col("at") == 0) if not block else hit)
        part = part.select(
            "doc_id", "key", (F.size("w") - F.when(F.element_at("w", -1) == "", 2).otherwise(1)).cast("long").alias("n_words"), F.when(hit, start).alias("start"), F.when(hit, F.size("win")).alias("size"), F.when(hit, F.col("win_id")).alias("win_id")
        )
        found = part if found is None else found.unionByName(part)
    return staged(found, "found"), own.select("win_id", "item_id")


def _judged(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """``contamination`` with key, a hash of the text, in order to find the rows again."""
    found, own = occurrences(docs, items, size)
    base, hits = found.where("win_id is null").select("doc_id", "key", "n_words"), found.where("win_id is not null").drop("n_words").distinct()
    covered = (
        hits.select("doc_id", "key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("i"))
        .distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    whose = (
        hits.select("doc_id", "key", "win_id").distinct().join(own, "win_id")
        .groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    one = covered.withColumnRenamed("doc_id", "d1").withColumnRenamed("key", "k1")
    two = whose.withColumnRenamed("doc_id", "d2").withColumnRenamed("key", "k2")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return (
        base.join(one, F.col("doc_id").eqNullSafe(F.col("d1")) & F.col("key").eqNullSafe(F.col("k1")), "left")
        .join(two, F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("key").eqNullSafe(F.col("k2")), "left")
        .select(
            "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated"),
        )
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items (their ids as strings, sorted), contaminated.

    Null or empty texts have no words and no hits. Rows may repeat, and ids may repeat or be null: each row gets its own result, which
    depends on its text alone. An item without words has no window, and one without id is named by none. Texts may be of any length that a
    row can hold. Further columns of either table aren't looked at. Empty tables: no rows, or no hits.
    """
    return _judged(docs, items, size).drop("key")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, max_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words a share of at most ``max_share`` is hit, with all their columns. A row stays or goes by its own text,
    also if others have its id or it has none. Rows with null or empty text stay."""
    bad = (
        _judged(docs.select("doc_id", "text"), items, size)
        .where(F.col("n_hit") > max_share * F.col("n_words")).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    )
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("bad_id")) & text_key(docs["text"]).eqNullSafe(F.col("bad_key")), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT r, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN own USING (r)
"""
