"""A quality classifier of supervised subword embeddings, trained by numpy stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.wordhash import mix, slices, words
from corvane.sources.workspace import stored

_U = np.uint64
_MULT = [_U(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Settings:
    """rows, bytes: the most labelled rows to train on, and of their texts together; rows come by the MD5 of their doc_id, and one whose text doesn't
    fit any more is left out. Both bound the driver's memory. bits: of the hash buckets that words and n-grams share. marks: whether a word
    that repeats a near one counts as a token of its own. dims: of the vectors. rate falls to 0 over epochs; spread is how strongly a
    document's gradient, shared by all its features, moves each of them."""

    rows: int = 6000
    bytes: int = 64 << 20
    marks: bool = True
    bits: int = 18
    dims: int = 8
    epochs: int = 4
    rate: float = 0.5
    spread: float = 30.0
    seed: int = 1


@dataclass
class Model:
    """The vectors of the buckets and the output layer, and what scoring needs of them: the mean of vectors times the output layer
    is the mean of (vector times layer), so each bucket keeps one number, its vector's part of the log-odds."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def odds(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each word, of a mark for each word that repeats the one 1, 2, 3 or 4 before, and of each 3- and 4-character
    gram within a word and one boundary on either side."""
    _, _, h, first = words(data, offsets)
    shift = _U(64 - s.bits)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield (h >> shift).astype(np.int64), of
    for lag in range(1, 5) if s.marks else ():
        again = of[lag:][(h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])]
        yield np.full(len(again), int(mix(np.array([lag], _U))[0] >> shift), np.int64), again
    x = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(begins[offsets]))
    space = (x == 32) | ((x >= 9) & (x <= 13))
    x = np.where(space, np.uint32(32), x).astype(_U)
    for n in (3, 4):
        k = len(x) - n + 1
        if k <= 0:
            continue
        g = sum((x[i : i + k] * _MULT[i] for i in range(1, n)), x[:k] * _MULT[0] + _U(n))
        ok = text[:k] == text[n - 1 :]
        for i in range(1, n - 1):
            ok &= ~space[i : i + k]
        yield (mix(g[ok]) >> shift).astype(np.int64), text[:k][ok]


def train(texts: pa.Array, labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Averaged bucket vectors into a softmax of two classes, one document a step, in a new order each epoch."""
    rng = np.random.RandomState(s.seed)
    m = Model(rng.uniform(-0.1, 0.1, (1 << s.bits, s.dims)), np.zeros((s.dims, 2)), np.zeros(2))
    m.layer[:] = rng.uniform(-0.1, 0.1, m.layer.shape)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for row, data, offsets in slices(texts):
        found = list(features(data, offsets, s))
        bucket, text = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(text, kind="stable")
        bounds = np.searchsorted(text[order], np.arange(len(offsets)))
        docs += [np.unique(bucket[order[a:b]], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    y = np.eye(2)[labels]
    steps, step = max(1, s.epochs * len(docs)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            bucket, count = docs[i]
            rate, step = s.rate * (1 - step / steps), step + 1
            share = count / max(1, count.sum())
            hidden = share @ m.vectors[bucket]
            z = hidden @ m.layer + m.bias
            p = np.exp(z - z.max())
            error = p / p.sum() - y[i]
            back = m.layer @ error
            m.layer -= rate * np.outer(hidden, error)
            m.bias -= rate * 0.1 * error
            m.vectors[bucket] -= rate * s.spread * share[:, None] * back
    return m


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> pa.Table:
    """At most s.rows whole texts of s.bytes together, with their label, none held out. Ids with differing labels and labels other than 0 and 1 are left out."""
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).filter("label = most")
    ids = rows.select("doc_id", "label", F.md5(F.col("doc_id").cast("string")).alias("m")).orderBy("m").limit(s.rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    texts = stored(texts, "labelled")
    fits, left = [], s.bytes
    for r in texts.select("doc_id", "m", "n").orderBy("m", "n").limit(s.rows).collect():
        if r.n <= left:
            fits.append((r.doc_id, r.n))
            left -= r.n
    chosen = docs.sparkSession.createDataFrame(fits, "doc_id long, n long").distinct()
    found = texts.join(F.broadcast(chosen), ["doc_id", "n"]).orderBy("m", "n").limit(max(len(fits), 1))
    return found.select("text", F.col("label").cast("long").alias("label")).toArrow()


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """One row per document of docs (doc_id, text): doc_id, held_out, score, predicted.

    The classifier is trained on the driver on a bounded sample of labelled rows and goes to the tasks as one number a bucket
    (2 MB). score is the chance of label 1; only the text is used. Null and empty texts have no features and get the score of the
    output layer's bias. If the sample has no label, or one label only, the scores are 0.5, or that label's. Repeated rows get equal scores;
    other columns are ignored.
    """
    found = sample(docs, labels, s)
    y = found["label"].to_numpy()
    if len(np.unique(y)) == 2:
        table, bias = train(found["text"].combine_chunks(), y, s).odds()
    else:
        table, bias = np.zeros(1 << s.bits), 0.0 if not len(y) else 20.0 * (2 * y[0] - 1)
    shared = docs.sparkSession.sparkContext.broadcast((table, float(bias), s))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start, settings = shared.value
        for batch in batches:
            out = []
            for _, data, offsets in slices(batch.column("text")):
                n = len(offsets) - 1
                total, count = np.zeros(n), np.zeros(n)
                for bucket, text in features(data, offsets, settings):
                    total += np.bincount(text, weights[bucket], n)
                    count += np.bincount(text, minlength=n)
                out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + start, -500, 500))))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
