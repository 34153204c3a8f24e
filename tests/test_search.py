"""Searches dealt over blocks, shards and parts, against plain ones."""

from __future__ import annotations

import math
import time
from collections import Counter

import numpy as np

from corvane.operators import dense, lexical


def test_dense_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "SHARD", 16)
    rng = np.random.default_rng(5)
    v, q = np.round(rng.normal(size=(90, 4)), 1), np.round(rng.normal(size=(20, 4)), 1)
    v[10:20] = v[0]  # ties
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_idx long, vec array<double>")
    queries = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(q)] + [(500, None)], "qid long, vec array<double>")
    pairs = [(100 + i, c) for i in range(20) for c in range(90) if (i * c) % 3 == 0 and i != 4] + [(999, 1), (500, 2)]
    allowed = spark.createDataFrame(pairs, "qid long, chunk_idx long")
    for may, given in ((None, None), (set(pairs), allowed)):
        want = set()
        for i in range(20):
            s = np.round(v @ q[i], 12)
            order = [c for c in sorted(range(90), key=lambda c: (-s[c], c)) if s[c] > 0 and (may is None or (100 + i, c) in may)]
            want |= {(100 + i, c, r + 1) for r, c in enumerate(order[:5])}
        got = dense.search(queries, chunks, 5, given).select("qid", "chunk_idx", "rank").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = dense.search(queries.filter("qid < 105"), chunks, 5).select("qid", "chunk_idx", "rank").collect()
    assert {tuple(r) for r in few} == {w for w in _brute(v, q, 5) if w[0] < 105}
    assert dense.search(queries.limit(0), chunks, 5).count() == 0 and dense.search(queries, chunks.limit(0), 5, allowed).count() == 0


def _brute(v, q, limit):
    out = set()
    for i in range(len(q)):
        s = np.round(v @ q[i], 12)
        order = [c for c in sorted(range(len(v)), key=lambda c: (-s[c], c)) if s[c] > 0]
        out |= {(100 + i, c, r + 1) for r, c in enumerate(order[:limit])}
    return out


def test_postings_of_a_frequent_term_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["the"] * (1 + i % 3) + [f"w{i % 7}"]) for i in range(40)] + [(99, [])], "chunk_idx long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["the", "w3"]), (2, ["the"]), (3, ["none"])], "qid long, tokens array<string>")
    rows = lambda: sorted((r.qid, r.chunk_idx, round(r.score, 9)) for r in lexical.scores(queries, lexical.build(docs)).collect())
    whole = rows()
    monkeypatch.setattr(lexical, "SPLIT", 9)
    index = lexical.build(docs)
    assert index.postings.filter("term = 'the'").select("part").distinct().count() == 5
    assert rows() == whole and len(whole) == 80


def test_lsa_weights_count_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(dense, "FIT_CHUNKS", 10)
    monkeypatch.setattr(dense, "FIT_STEP", 3)
    rows = [(i, ["all", f"w{i % 7}", f"v{i % 4}"]) for i in range(40)]
    model = dense.LsaEmbedder(4).fit(spark.createDataFrame(rows, "chunk_idx long, tokens array<string>"))
    df = Counter(g for _, t in rows for g in {*t, *(f"{a} {b}" for a, b in zip(t, t[1:], strict=False))})
    assert model.weights and all(abs(w - np.log(41 / (1 + df[g])) - 1) < 1e-9 and df[g] > 1 for g, (w, _) in model.weights.items())


def test_equal_documents_score_equally_in_any_order(spark):
    """Copies of a document whose terms come in different orders; sums of doubles differ in their last digits, which rounding to 12 digits of large scores shows."""
    words = [f"w{i}" for i in range(60)]
    parts = [(d, 0.1 + (i * 7919 % 61) ** 1.7) for d in range(40) for i in np.random.default_rng(d).permutation(60)]
    rows = spark.createDataFrame([(int(d), float(x)) for d, x in parts], "d long, x double").coalesce(1)
    assert rows.groupBy("d").agg(lexical.exact_sum(rows.x).alias("s")).select("s").distinct().count() == 1
    (total,) = rows.filter("d = 0").agg(lexical.exact_sum(rows.x)).first()
    assert total == math.fsum(x for d, x in parts if d == 0)
    docs = spark.createDataFrame([(d, [words[i] for i in np.random.default_rng(d).permutation(60)] + [f"x{d}"]) for d in range(40)], "chunk_idx long, tokens array<string>")
    got = lexical.scores(spark.createDataFrame([(1, words)], "qid long, tokens array<string>"), lexical.build(docs))
    assert got.select("score").distinct().count() == 1


def test_lsa_is_fitted_to_all_chunks_and_grams(spark, monkeypatch):
    """Against a plain SVD of all chunks; the numbers are such that the model iterates, in many blocks and steps."""
    monkeypatch.setattr(dense, "FIT_CHUNKS", 50)
    monkeypatch.setattr(dense, "FIT_STEP", 50)
    monkeypatch.setattr(dense, "FIT_BLOCK", 300)
    rng = np.random.default_rng(1)
    toks = [[f"t{i % 6}w{x}" if r < 0.7 else f"c{x}" for x, r in zip(rng.integers(0, 12, 30), rng.random(30), strict=True)] for i in range(300)]
    toks[3] = []
    count = [Counter([*t, *(f"{a} {b}" for a, b in zip(t, t[1:], strict=False))]) for t in toks]
    df = Counter(g for c in count for g in c)
    col = {g: i for i, g in enumerate(sorted(g for g in df if df[g] > 1))}
    a = np.zeros((300, len(col)))
    for i, c in enumerate(count):
        for g in c.keys() & col.keys():
            a[i, col[g]] = (1 + np.log(c[g])) * (np.log(301 / (1 + df[g])) + 1)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = unit(unit(a) @ np.linalg.svd(unit(a), full_matrices=False)[2][:6].T)
    chunks = spark.createDataFrame([(i * 7, t) for i, t in enumerate(toks)], "chunk_idx long, tokens array<string>")
    model = dense.LsaEmbedder(6).fit(chunks)
    vec = {r.chunk_idx: r.vec for r in model.embed(chunks).collect()}
    got = np.array([vec[i * 7] for i in range(300)])
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3 and not got[3].any()
    assert set(model.weights) == set(col)


def test_block_products_equal_plain_ones(monkeypatch):
    """Products of a block with matrices, also with a column and a row of more entries than a step takes."""
    monkeypatch.setattr(dense, "FIT_STEP", 16)
    rng = np.random.default_rng(2)
    tf = rng.integers(1, 4, (40, 30)) * (rng.random((40, 30)) < rng.random(30) / 2)
    tf[:, 0], tf[7], tf[3, 1:7] = 2, 1, 0
    df = (tf > 0).sum(axis=0)
    column, row = np.nonzero(tf.T)
    b = dense._Block.made(np.arange(30, dtype=np.uint64), df, row, tf[row, column], 40)
    b = dense._Block(*(np.frombuffer(x, k) for x, k in zip(b.cells(), b.KINDS, strict=True)))
    plain = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log(41 / (1 + df)) + 1)
    q, z, into = rng.normal(size=(40, 5)).astype(np.float32), rng.normal(size=(30, 5)).astype(np.float32), np.ones((40, 5), np.float32)
    assert np.abs(b.columns(q)[np.argsort(b.gram)] - plain.T @ q).max() < 1e-4
    b.add_rows(z[b.gram.astype(int)], into)
    assert np.abs(into - 1 - plain @ z).max() < 1e-4


def test_cost_of_block_products(spark):
    """A block's two products take 5 to 7 times what it takes to gather the rows that they need; with sums by reduceat it was 15 to 20."""
    rng = np.random.default_rng(3)
    words = [[f"w{x}" for x in (rng.pareto(1.0, 80) * 20).astype(int) % 3000] for _ in range(2500)]
    blocks = dense.LsaEmbedder(4)._blocks(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "chunk_idx long, tokens array<string>"), np.arange(2500))
    batch = blocks.toArrow().combine_chunks().to_batches()[0]
    q, ratios = rng.normal(size=(2500, 42)).astype(np.float32), []
    for _ in range(3):
        began = time.process_time()
        for i in range(len(batch)):
            b = dense._Block.of(batch, i)
            b.add_rows(b.columns(q), np.zeros_like(q))
        products, began = time.process_time() - began, time.process_time()
        for i in range(len(batch)):
            row = dense._Block.of(batch, i).row
            for _ in range(2):
                for at in range(0, len(row), 8192):
                    q.take(row[at : at + 8192], axis=0)
        ratios.append(products / (time.process_time() - began))
    assert min(ratios) < 10, ratios
