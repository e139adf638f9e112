"""Mixing sources to target weights: a token budget handed down a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table, text_key

LEVELS = ("domain", "lang", "source")
#: A leaf's order of documents is cut into parts of about so many tokens, by its hash's first bits; only the part in which the budget ends is
#: ordered row by row.
PART_TOKENS = 1 << 20
#: The leaves' table is broadcast up to so many rows, and shuffled beyond.
BROADCAST_LEAVES = 100_000

TARGET = {"domain": {"src": 2.0, "src1": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {}}
SHARE = 0.5
EPOCHS = 2
SEED = 17


def water_fill(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Deal ``budget`` to siblings by weight; what one has no room for goes to the others by their weights, until none is left or all are full.

    Whole tokens: what rounding leaves goes to the largest fractions, then to the first siblings.
    """
    weights, room = np.array(weights, float), np.array(room, np.int64)
    given = np.zeros(len(room), np.int64)
    left, budget = (weights > 0) & (room > 0), int(min(budget, room[weights > 0].sum()))
    while budget > 0 and left.any():
        share = np.where(left, budget * (weights / weights[left].sum()), 0)
        full = left & (room <= share)
        if full.any():
            given[full] = room[full]
            budget -= int(room[full].sum())
            left &= ~full
            continue
        whole = np.minimum(np.floor(share).astype(np.int64), room)
        given[left] = whole[left]
        rest = budget - int(whole[left].sum())
        order = [i for i in np.lexsort((np.arange(len(room)), -(share - whole))) if left[i]]
        while rest > 0:
            for i in order:
                if rest > 0 and given[i] < room[i]:
                    given[i] += 1
                    rest -= 1
        break
    return given.tolist()


def tokens(text: Column) -> Column:
    """What stands between white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def by_source(docs: DataFrame) -> Column:
    """The domain of a row of documents: its source's name less the last digit."""
    return F.regexp_replace("source", r"\d$", "")


def _dealt(level: str, weights: dict[str, float]):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(level)
        given = water_fill(int(rows["above"].iloc[0]), [weights.get(x, 1.0) for x in rows[level]], rows["room"].tolist())
        return rows.drop(columns=["above", "room"]).assign(budget=given)

    return of


def allocate(leaves: DataFrame, budget: int, target: Mapping[str, Mapping[str, float]], epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``: tokens that each leaf gives. A name without a weight has weight 1.

    From the root down, each node's budget is dealt to its children by weight, up to what their subtrees hold in ``epochs`` passes. So a
    shortage is made good by siblings first, and goes up to the ancestors' siblings only if a whole subtree is short.
    """
    node = leaves.withColumn("room", F.col("tokens") * epochs)
    above, out = [], None
    for level in LEVELS:
        children = node.groupBy(*above, level).agg(F.sum("room").alias("room"))
        children = children.join(out.withColumnRenamed("budget", "above"), above) if above else children.withColumn("above", F.lit(budget).cast("long"))
        names = [*above, level]
        out = children.groupBy(*(above or [F.lit(0).alias("root")])).applyInPandas(_dealt(level, dict(target.get(level, {}))), ", ".join(f"{c} string" for c in names) + ", budget long")
        above = names
    return out


def selection(docs: DataFrame, target: Mapping[str, Mapping[str, float]] = TARGET, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """doc_id, key (a hash of the text), domain, lang, source, epoch (from 0), n_tokens, n_taken: what a mixture of ``share`` of all tokens takes.

    Each leaf (domain, lang, source) gives the budget that ``allocate`` sets for it: whole passes over its documents, then, of one more
    pass, a prefix of tokens in an order drawn from seed and epoch; the document where the budget ends is taken up to n_taken tokens. A null
    domain, language or source is a leaf named ``(none)``. Texts that are null or without tokens are never taken. Repeated rows are each taken, null
    ids like others. Rows of equal place in the order stand by id, then by the text's hash. An empty table gives no rows. Further columns aren't
    looked at.
    """
    names = [F.coalesce(domain if domain is not None else by_source(docs), F.lit("(none)")).alias("domain"), *(F.coalesce(c, F.lit("(none)")).alias(c) for c in LEVELS[1:])]
    slim = staged(docs.select("doc_id", text_key(F.col("text")).alias("key"), *names, tokens(F.col("text")).alias("n_tokens")).where("n_tokens > 0"), "tokens")
    leaves = staged(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens").alias("n")).first().n or 0
    plan = allocate(leaves, int(total * share), target, epochs).join(leaves, list(LEVELS))
    plan = staged(plan.withColumns({"full": F.expr("budget div tokens").cast("int"), "rest": F.col("budget") % F.col("tokens"), "bits": F.length(F.bin(F.floor(F.col("tokens") / PART_TOKENS)))}).select(*LEVELS, "full", "rest", "bits"), "plan")
    small = plan.count() <= BROADCAST_LEAVES
    order = F.xxhash64(F.lit(seed), "full", "doc_id", "key")
    rows = slim.join(F.broadcast(plan) if small else plan, list(LEVELS)).withColumn("order", order).withColumns({"part": F.expr("shiftrightunsigned(order, 64 - bits)")})
    leaf = Window.partitionBy(*LEVELS)
    so_far = F.sum("n").over(leaf.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    ends = (
        rows.where("rest > 0").groupBy(*LEVELS, "rest", "part").agg(F.sum("n_tokens").alias("n"))
        .withColumn("upto", so_far).where("upto >= rest and upto - n < rest")
        .select(*LEVELS, F.col("part").alias("end"), (F.col("rest") - F.col("upto") + F.col("n")).alias("open"))
    )
    ends = staged(ends, "ends")
    columns = ["doc_id", "key", *LEVELS]
    whole = rows.where("full > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("n_taken"))
    part = rows.where("rest > 0").join(F.broadcast(ends) if small else ends, list(LEVELS))
    before = part.where("part < end").select(*columns, F.col("full").alias("epoch"), "n_tokens", F.col("n_tokens").alias("n_taken"))
    taken = F.coalesce(F.sum("n_tokens").over(leaf.orderBy("order", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (
        part.where("part = end").withColumn("n_taken", F.least("n_tokens", F.col("open") - taken)).where("n_taken > 0")
        .select(*columns, F.col("full").alias("epoch"), "n_tokens", "n_taken")
    )
    return whole.unionByName(before).unionByName(last)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The texts of a mixture: doc_id, domain, lang, source, epoch, n_tokens, n_taken, text; a text taken in part is its first n_taken tokens, joined by spaces."""
    same = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("j"), F.col("doc_id").isNull().alias("nameless"), "key"]
    on = ["j", "nameless", "key"]  # repeated rows go where rows are joined: one shuffle of texts
    taken = selection(docs, **options).select(*same, *LEVELS, "epoch", "n_tokens", "n_taken")
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").select(*same, "doc_id", "text").dropDuplicates(on)
    first = F.array_join(F.slice(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), F.lit(1), F.col("n_taken").cast("int")), " ")
    return texts.join(taken, on).select(
        "doc_id", *LEVELS, "epoch", "n_tokens", "n_taken", F.when(F.col("n_taken") < F.col("n_tokens"), first).otherwise(F.col("text")).alias("text")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(table(spark, sf_dir, "documents")).drop("key")
