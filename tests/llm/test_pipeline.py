"""The pipeline on a small corpus against brute-force versions of its stages."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from linelake.llm import mixing, quality
from linelake.llm.registry import ORACLES, QUERIES

from .test_operators import brute_components, brute_hits, brute_repeats, prose


def corpus():
    rng = random.Random(11)
    benchmark = [(i, prose(rng, 20)) for i in range(5)]
    passage = prose(rng, 70)
    rows, labels = [], []
    for i in range(140):
        bad = i % 9 == 0
        text = "BUY!! NOW!! WOW!! " * rng.randint(5, 30) if bad else prose(rng, rng.randint(40, 120))
        if i % 10 == 3:
            text = rows[-2][1].replace(" a", " b", 1)
        elif i % 10 == 5:
            text += ". " + passage
        elif i % 10 == 7:
            text += " " + benchmark[i % 5][1]
        rows.append((i, text, rng.choice(["en", "fr"]), rng.choice(["src1", "src2", "src12"]), len(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels, benchmark


def brute_quality(rows, labels):
    """A discriminant by the textbook: densities from the shrunk covariances themselves."""
    marked = dict((i, q) for i, q, _ in labels)
    x = {i: np.array(quality.statistics(t)) for i, t, *_ in rows}
    own = [np.array([x[i] for i in x if marked[i] == c]) for c in (0, 1)]
    spread = sum(np.var(o, axis=0) * len(o) for o in own) / len(x) + 1e-6
    kept = []
    for row in rows:
        density = []
        for o in own:
            cov = 0.9 * np.cov(o.T, bias=True) + 0.1 * np.diag(spread)
            d = x[row[0]] - o.mean(axis=0)
            density.append(np.log(len(o) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d))
        if 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))) >= quality.THRESHOLD:
            kept.append(row)
    return kept


def test_pipeline(spark, tmp_path):
    rows, labels, benchmark = corpus()
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir = f"file://{tmp_path}"

    want = brute_quality(rows, labels)
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns
        got = sorted(tuple(r) for r in docs.collect())
        if name == "near duplicates":
            keep = {i for i, _, c in brute_components([r[:2] for r in want]) if i == c}
            want = [r for r in want if r[0] in keep]
        elif name == "repeated passages":
            cut = {i: (t, n) for i, t, n in brute_repeats([r[:2] for r in want])}
            want = [(r[0], cut[r[0]][0], *r[2:4], len(cut[r[0]][0]) if cut[r[0]][1] else r[4]) for r in want if cut[r[0]][0].strip() or not cut[r[0]][1]]
        elif name == "benchmark":
            want = [r for r in want if not brute_hits(r[1], benchmark)[1]]
        assert got == sorted(want), name
        seen.append(len(got))
        docs = spark.createDataFrame(got, documents.schema)
    assert len(rows) > seen[0] > seen[1] >= seen[2] > seen[3] > 0
    last = corpus_pipeline.run(spark, sf_dir)
    total = sum(len(r[1].split()) for r in want)
    assert 0 < last.agg(F.sum("n_taken")).first()[0] <= total * mixing.SHARE
    assert {r.doc_id for r in last.collect()} <= {r[0] for r in want}


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
