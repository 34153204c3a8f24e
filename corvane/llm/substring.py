"""Substring deduplication with a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import lookup, only
from corvane.llm.wordhash import shingles, slices, words
from corvane.sources.workspace import Scratch, remove, stored

#: Words of a window, and of the grams whose least hash is the window's fingerprint.
WINDOW, GRAM = 50, 12
SPAN = WINDOW - GRAM + 1
#: So many runs of one level are compacted into one.
RUNS = 2
_LOW = np.uint64(0xFFFFFFFF)


def fingerprints(h: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of word hashes: (fingerprint, from, to), the least gram hash of the windows that start at words from..to.

    Of equal least grams (by their upper 32 bits) the leftmost counts, so equal windows have equal fingerprints in any text.
    """
    g = shingles(h, GRAM)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    if len(g) < SPAN:
        return [none] * (len(first) - 1)
    least, n = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64), 1
    while 2 * n <= SPAN:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    if n < SPAN:
        least = np.minimum(least[: n - SPAN], least[SPAN - n :])
    at, out = (least & _LOW).astype(np.int64), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a < WINDOW:
            out.append(none)
            continue
        p = at[a : b - WINDOW + 1]
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        ends = np.concatenate([starts[1:], [len(p)]]) - 1
        out.append((g[p[starts]].view(np.int64), starts.astype(np.int32), ends.astype(np.int32)))
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, found = [], [], []
        for _, data, offsets in slices(batch.column(1)):
            _, _, h, first = words(data, offsets)
            raw, at = data.tobytes(), offsets.tolist()
            n += np.diff(first).tolist()
            sha += [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            found += fingerprints(h, first)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in found]) if found else np.zeros(0, t))) for i, t in enumerate((np.int64, np.int32, np.int32))]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *lists], ["doc_id", "k", "n_words", "sha", "a", "lo", "hi"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the words of all windows of each fingerprint."""
    for batch in batches:
        at, a, lo, hi, digest = [], [], [], [], []
        for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)):
            w = text.as_py().encode().split()
            for s in spans:
                at.append(i)
                a.append(s["a"])
                lo.append(s["lo"])
                hi.append(s["hi"])
                digest.append(hashlib.blake2b(b"%d " % s["a"] + b" ".join(w[s["lo"] : s["hi"] + WINDOW]), digest_size=16).digest())
        rows = pa.array(at, pa.int64())
        yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("k").take(rows), pa.array(a, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "k", "a", "lo", "hi", "c"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the words of each window."""
    for batch in batches:
        for n, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)):
            w = text.as_py().encode().split()
            at = [i for s in spans for i in range(s["lo"], s["hi"] + 1)]
            digest = [hashlib.blake2b(b" ".join(w[i : i + WINDOW]), digest_size=16).digest() for i in at]
            rows = pa.array([n] * len(at), pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("k").take(rows), pa.array(at, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "k", "lo", "c"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, kept = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            w = text.as_py().encode().split()
            gone = np.zeros(len(w) + 1, np.int32)
            for s in spans:
                gone[s["lo"]] += 1
                gone[s["hi"] + WINDOW] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            rest = b" ".join([x for x, y in zip(w, stay.tolist(), strict=True) if y])
            n.append(len(w) - int(stay.sum()))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode())
        yield pa.record_batch([batch.column("doc_id"), batch.column("k"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "k", "n_removed", "kept_sha256", "kept_text"])


@dataclass
class Run:
    """One immutable part of the index: (sha, doc_id) of its distinct word sequences and (a, doc_id, k, lo, hi) of their fingerprints, each
    range-sorted by its first columns, so that a hot fingerprint is split too. level: how many times its rows were compacted."""

    docs: DataFrame
    prints: DataFrame
    level: int = 0


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, k; k tells the texts of a repeated doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k"))


def without_repeats(rows: DataFrame, key: list[str]) -> DataFrame:
    """One of the rows of each key; rows (a stored table) are shuffled only where keys repeat, the others stay where they are."""
    twice = stored(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "twice")
    if not (n := twice.count()):
        return rows
    return stored(_all([only(rows, twice, key, "left_anti", n), only(rows, twice, key, n=n).dropDuplicates(key)]), "once")


@dataclass
class FingerprintIndex:
    """Runs of earlier documents, and where their texts are (corpus: doc_id, text). add() removes from a batch what they hold already."""

    spark: SparkSession
    corpus: DataFrame | None = None
    runs: list[Run] = field(default_factory=list)

    def width(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def sorted_run(self, docs: DataFrame, prints: DataFrame, level: int = 0) -> Run:
        return Run(stored(docs, "docs", (self.width(), ["sha", "doc_id"])), stored(prints, "prints", (self.width(), ["a", "doc_id", "lo"])), level)

    def compact(self) -> None:
        """While RUNS runs share a level, merges them into one of the next level: each row is written again once a level, so as often as the
        logarithm of the number of batches. The old runs are deleted."""
        while len(same := [r for r in self.runs if r.level == self.runs[-1].level]) >= RUNS:
            with Scratch(self.spark) as tables:
                run = self.sorted_run(_all([r.docs for r in same]), _all([r.prints for r in same]), same[0].level + 1)
                tables.keep(run.docs, run.prints)
            self.runs = [*(r for r in self.runs if r not in same), run]
            for r in same:
                remove(self.spark, r.docs.corvane_table)
                remove(self.spark, r.prints.corvane_table)

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """One row per document of batch (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text (null: nothing is removed).

        Each word that lies in a 50-word window whose words also start in a document of smaller doc_id, in the batch or the index, is
        removed; the batch then becomes a run, and full levels are compacted, unless it is the last: then the index stays as it is. Null and empty texts, and those under 50 words, lose nothing. Rows
        that repeat a doc_id lose nothing to each other, and each what smaller ids have of its own text; rows with a null id lose and take
        nothing. Other columns are ignored.

        1. Equal word sequences (by SHA-256) are copies: all but the smallest doc_id lose everything and need no index.
        2. A window's fingerprint is its least 12-gram hash; neighbours share one, so some 5 in 100 windows make a row. The batch's
           fingerprints are merge-joined with each run; those seen in two documents are candidates. 3. Each candidate is verified on the words themselves:
           128-bit digests of all the words under it, and where these differ, of each of its windows. Every step is an aggregate
           or a join by one key; no pairs of documents are formed, whatever number of them shares a passage. What an earlier
           document covers whole stays out of the run, as its windows are found in that document.
        """
        with Scratch(self.spark) as tables:
            result, run = self._added(batch, last)
            tables.keep(result, *([run.docs, run.prints] if run else []))
        if run is None:
            return result
        self.runs.append(run)
        self.compact()
        self.corpus = texts_of(self.corpus, batch.select("doc_id", "text"))
        return result

    def _added(self, batch: DataFrame, last: bool) -> tuple[DataFrame, Run | None]:
        batch = _texts(batch)
        profile = stored(batch.mapInArrow(_profiles, "doc_id long, k long, n_words long, sha string, a array<long>, lo array<int>, hi array<int>"), "profiles")
        new = profile.filter(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
        seen = _all([new.select("sha", "doc_id"), *(r.docs for r in self.runs)])
        classes = stored(seen.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
        marked = stored(lookup(profile.select("doc_id", "k", "n_words", "sha"), classes, "sha", "n").withColumn("copy", F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)) & F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)), "marked")
        copies = stored(marked.filter("copy").select("doc_id", "sha").distinct(), "copies")
        own = only(new, copies, ["doc_id", "sha"], "left_anti")
        prints = own.select("doc_id", "k", F.explode(F.arrays_zip("a", "lo", "hi")).alias("x")).select("x.a", "doc_id", "k", "x.lo", "x.hi")
        before, mine = self.runs, stored(prints, "mine")
        keys = mine.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
        hits = _all([keys.filter("x < y").select("a"), *(keys.select("a").join(r.prints.select("a").hint("merge"), "a", "left_semi") for r in before)])
        hits = stored(hits.distinct() if before else hits, "hits")
        many = hits.count()
        found = stored(_all([only(r.prints, hits, "a", n=many) for r in before] + [only(mine, hits, "a", n=many)]), "candidates")
        texts = batch if self.corpus is None else _all([batch, _texts(self.corpus)])
        ids = stored(found.select("doc_id", "k").distinct(), "ids")
        texts = without_repeats(stored(only(texts, ids, ["doc_id", "k"]), "texts"), ["doc_id", "k"])

        def joined(spans: DataFrame) -> DataFrame:
            lists = spans.groupBy("doc_id", "k").agg(F.collect_list(F.struct(*(c for c in spans.columns if c not in ("doc_id", "k")))).alias("spans"))
            return texts.join(lists, ["doc_id", "k"]).select("doc_id", "k", "text", "spans")

        seen = stored(joined(found).mapInArrow(_contexts, "doc_id long, k long, a long, lo int, hi int, c binary"), "contexts")
        whole = stored(seen.groupBy("c").agg(F.min("doc_id").alias("x"), F.count("*").alias("n"), F.first("a").alias("b")), "wholes")
        apart = stored(whole.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("b").alias("a")), "apart")
        seen = stored(lookup(seen, whole.select("c", "x", "n"), "c", "n"), "compared")
        gone = gone_whole = seen.filter("x < doc_id").select("doc_id", "k", "lo", "hi")
        open_ = stored(only(seen.filter("x = doc_id"), apart, "a").select("doc_id", "k", "lo", "hi"), "open")
        single = stored(joined(open_).mapInArrow(_windows, "doc_id long, k long, lo int, c binary"), "windows")
        least = stored(single.groupBy("c").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n")).filter("x < y").drop("y"), "leasts")
        more = lookup(single, least, "c", "n").filter("x < doc_id").select("doc_id", "k", "lo", F.col("lo").alias("hi"))
        gone = stored(_all([gone, more]), "gone")
        mine_only = only(gone, marked.select("doc_id", "k").distinct(), ["doc_id", "k"]) if before else gone
        cut = stored(joined(mine_only).mapInArrow(_removed, "doc_id long, k long, n_removed long, kept_sha256 string, kept_text string"), "cut")
        run = None
        if not last:
            fresh = mine.join(gone_whole.select("doc_id", "k", "lo").distinct(), ["doc_id", "k", "lo"], "left_anti").distinct().select("a", "doc_id", "k", "lo", "hi")
            run = self.sorted_run(own.select("sha", "doc_id").distinct(), fresh)
        empty = hashlib.sha256(b"").hexdigest()
        out = marked.join(cut, ["doc_id", "k"], "left")
        return stored(out.select(
            "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copy"), empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), F.when(F.col("copy"), "").otherwise(F.col("kept_text")).alias("kept_text"),
        ), "result"), run


def texts_of(corpus: DataFrame | None, batch: DataFrame) -> DataFrame:
    return batch if corpus is None else corpus.unionByName(batch)


def deduplicated(docs: DataFrame, batches: int = 3) -> DataFrame:
    """add() over docs in batches of rising doc_id, each against the runs of those before it. A null id goes with the first batch."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark)
    parts = [(i + 1) / batches for i in range(batches - 1)]
    cuts = sorted(set(docs.select("doc_id").filter("doc_id IS NOT NULL").approxQuantile("doc_id", parts, 0.01))) if parts else []
    bounds = [None, *(int(c) for c in cuts), None]
    results = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = docs
        if a is not None:
            part = part.filter(F.col("doc_id") > a)
        if b is not None:
            part = part.filter((F.col("doc_id") <= b) | (F.col("doc_id").isNull() if a is None else F.lit(False)))
        results.append(index.add(part, last=b is None))
    return _all(results)
