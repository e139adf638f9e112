"""Exact top-k search by inner product over vectors in buckets by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

SCALE = 256
TOP = 5
#: Vectors in a bucket, and queries in a block.
BUCKET = 1024
QUERIES = 256
#: Query blocks that one task pairs with the buckets.
SHARE = 64
#: From this cosine on, a bucket is pruned by a query's strongest coordinate as well as by length.
STEEP = 0.8
_SLACK = 1 + 1e-9


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm): whole components floor(scale * x); rows without id, and vectors that are null or hold null or non-finite parts, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform("x", lambda c: F.floor(c * scale).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(sound).select("vec_id", v.alias("v")).withColumn("norm", norm)


def _packed(size: int):
    """Blocks of at most ``size`` vectors of one dimension, in the rows' order."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, own in rows.groupby(rows["v"].map(len), sort=False):
                for at in range(0, len(own), size):
                    some = own.iloc[at : at + size].sort_values(["norm", "vec_id"], ascending=[False, True])
                    yield pd.DataFrame({
                        "dim": [int(dim)], "longest": [float(some["norm"].iloc[0])], "first_id": [int(some["vec_id"].iloc[0])], "n": [len(some)],
                        "ids": [some["vec_id"].to_numpy(np.int64).tobytes()], "data": [np.array(some["v"].tolist(), np.float64).tobytes()],
                    })

    return of


PACKED = "dim int, longest double, first_id long, n int, ids binary, data binary"


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products: by float64 where that is exact, else by integers of any size, cut to what a long holds. Empty vectors: 0."""
    if not (q.size and c.size):
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], object).reshape(c.shape).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _vectors(row, ids: str = "ids", data: str = "data") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[ids], np.int64), np.frombuffer(row[data], np.float64).reshape(len(row[ids]) // 8, row["dim"])


def _thresholds(seeds, k: int):
    """Each query block with a score per query that its k-th best reaches at least, from the bucket of the longest vectors."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                ids, q = _vectors(row)
                least = np.full(len(ids), -np.inf)
                if row["dim"] in seeds.value:
                    s_ids, s = _vectors(seeds.value[row["dim"]])
                    for i, score in enumerate(_products(q, s)):
                        others = score[s_ids != ids[i]]
                        if len(others) >= k:
                            least[i] = np.partition(others, -k)[-k]
                norm = np.sqrt((q**2).sum(axis=1))
                # the length below which no vector reaches the threshold
                need = np.divide(least, norm, out=np.where(least > 0, np.inf, -np.inf), where=norm > 0)
                yield pd.DataFrame([row | {"least": least.tobytes(), "need": float(need.min())}])

    return of


def _searched(k: int):
    """Of each pair of a query block and a bucket: the bucket's k best for each query, where they may be among the k best of all."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                q_ids, q = _vectors(row)
                c_ids, c = _vectors(row, "c_ids", "c_data")
                least = np.frombuffer(row["least"], np.float64)
                q_norm, c_norm = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
                out = []
                whole = np.flatnonzero(least <= 0)  # no bound prunes: all products at once
                product = dict(zip(whole.tolist(), _products(q[whole], c)))
                for i in range(len(q_ids)):
                    if i in product:
                        kept, score = np.arange(len(c_ids)), product[i]
                    else:
                        near = least[i] / _SLACK
                        n = int(np.searchsorted(-c_norm, -near / max(q_norm[i], 1e-300), side="right"))  # c is in order of length
                        kept = np.arange(n)
                        if n and near / (q_norm[i] * c_norm[0]) >= STEEP:
                            f = int(np.abs(q[i]).argmax())
                            qf, cf = q[i, f] / q_norm[i], c[:n, f] / c_norm[:n]
                            bound = qf * cf + np.sqrt(max(0.0, 1 - qf * qf)) * np.sqrt(np.maximum(0, 1 - cf * cf))
                            kept = np.flatnonzero(bound * _SLACK + 1e-9 >= near / (q_norm[i] * c_norm[:n]))
                        score = _products(q[i : i + 1], c[kept])[0]
                    good = (score >= least[i]) & (c_ids[kept] != q_ids[i])
                    kept, score = kept[good], score[good]
                    for j in _best(score, c_ids[kept], k):
                        out.append((q_ids[i], c_ids[kept[j]], score[j]))
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k largest inner products with rows of ``vectors`` (vec_id, embedding), ties to the smaller vec_id.

    Vectors are put in order of length and cut into buckets. The longest bucket gives each query a score that its k-th best reaches at
    least; a bucket whose longest vector is too short for that is not looked at, and inside a bucket lengths and, for high local
    cosines, the query's strongest coordinate prune before the products are made. All are whole numbers, so results are exact.

    Rows with a query's own vec_id aren't its candidates. Queries are distinct ids: of one id's several vectors, the smallest is taken.
    Vectors are compared with those of their own dimension only; products of empty ones are 0. Null ids and unsound vectors take no part (see
    ``scaled``). Repeated rows of ``vectors`` are each a candidate. Without queries or vectors there are no rows. Further columns aren't looked at.
    """
    spark = vectors.sparkSession
    base = staged(scaled(vectors, scale), "vectors")
    parts = max(1, -(-base.count() // (8 * BUCKET)))
    ordered = base.repartitionByRange(parts, F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), F.col("vec_id"))
    buckets = staged(ordered.mapInPandas(_packed(BUCKET), PACKED), "buckets")
    longest = buckets.groupBy("dim").agg(F.max_by(F.struct("dim", "ids", "data"), F.struct("longest", "n")).alias("x"))
    seeds = spark.sparkContext.broadcast({r.dim: {"dim": r.dim, "ids": bytes(r.x.ids), "data": bytes(r.x.data)} for r in longest.collect()})  # a bucket for each dimension
    asked = scaled(queries, scale).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", "x.*")
    blocks = asked.repartitionByRange(max(1, -(-parts * 8 * BUCKET // (50 * QUERIES))), "norm", "vec_id").mapInPandas(_packed(QUERIES), PACKED)
    blocks = staged(blocks.mapInPandas(_thresholds(seeds, k), PACKED + ", least binary, need double").withColumn("block", F.monotonically_increasing_id()), "queries")
    # numbers of blocks and buckets only: a stated query set against all rows, in blocks. Most vectors have one dimension, so blocks are dealt to
    # shares of about SHARE, and the buckets' numbers go to each share
    shares = max(1, -(-blocks.count() // SHARE))
    place = buckets.select("dim", "longest", F.struct("longest", "first_id", "n", F.xxhash64("ids")).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    asks = blocks.select("block", "dim", "need", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"))
    near = (asks["dim"] == place["dim"]) & (asks["share"] == place["share"]) & (place["longest"] * _SLACK >= asks["need"])
    pairs = staged(asks.join(place, near).select("block", "bucket"), "pairs")
    sought = pairs.join(blocks.drop("longest", "first_id", "n", "need"), "block")
    held = buckets.select(F.struct("longest", "first_id", "n", F.xxhash64("ids")).alias("bucket"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    found = sought.join(held, "bucket").select("dim", "ids", "data", "least", "c_ids", "c_data").mapInPandas(_searched(k), "query_id long, vec_id long, score long")
    found = staged(found, "found", 32)  # rows hold a bucket each
    seeds.unpersist()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= {TOP}
"""
