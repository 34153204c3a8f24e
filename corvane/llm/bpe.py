"""Byte-level BPE by recursive DuckDB queries, one database per Python worker."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word of more bytes is merged by a heap, as the query's work grows with the square of a word's length. Words of one query.
LONG, AT_ONCE = 128, 50_000
#: Entries of each of the two generations of a cache; characters of text encoded together; tokens that one query decodes.
CACHED, SLICE, TOKENS = 300_000, 4 << 20, 500_000

#: A word is a list of tokens. In each round its pairs of neighbours become rows by position, these join the merge table, and each word's
#: leftmost pair of least rank becomes one token; words without such a pair are done. Ranks are ids of merged tokens. The lists meet
#: their best pair by a join on the word, as an aggregate that carries them would copy each list for each of its positions.
ENCODE = """
WITH RECURSIVE state(w, ids, done) AS (
    SELECT w, ids, false FROM start
    UNION ALL
    SELECT w, CASE WHEN best IS NULL THEN ids ELSE ids[:(best % 65536)::INT - 1] || [(best // 65536)::INT] || ids[(best % 65536)::INT + 2:] END, best IS NULL
    FROM (SELECT w, ids FROM state WHERE NOT done)
    LEFT JOIN (
        SELECT w, min(merged * 65536 + pos) AS best
        FROM (
            SELECT w, pos, a::BIGINT * 4294967296 + b AS pair
            FROM (SELECT w, generate_subscripts(ids, 1) AS pos, unnest(ids) AS a, unnest(ids[2:]) AS b FROM state WHERE NOT done)
        )
        JOIN merges USING (pair) GROUP BY w
    ) USING (w)
)
SELECT ids, array_to_string(ids, ',') AS txt FROM state WHERE done ORDER BY w"""

#: Ordered aggregation of the bytes of the tokens, each byte as the character of its number.
DECODE = "SELECT string_agg(bytes, '' ORDER BY pos) AS decoded FROM encoded JOIN vocabulary USING (id)"


def plain_split(pattern: str) -> Callable[[str], list[str]] | None:
    """findall of the re module with the matches that regex finds for pattern in texts below U+10000, where classes can be spelled out; it takes
    some 0.6 of the time. None for patterns with other escapes than \\p{L}, \\p{N}, \\s and \\S, flags, sets in sets or possessive quantifiers."""
    import regex

    if re.search(r"\\(?!p\{[LN]\}|[sS])|\(\?(?![!=:])|\[[^]]*[\[&|~-]|(?:[?*+]|\d\})\+", pattern):
        return None
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000)))
    spelled = {k: "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in regex.findall(k + "+", every[:0xD800]) + regex.findall(k + "+", every[0xD800:])) for k in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside = [], False
    for part in re.findall(r"\\p\{.\}|\\.|.", pattern, re.DOTALL):
        inside = part == "[" or (inside and part != "]")
        out.append(part if part not in spelled else spelled[part] if inside else f"[{spelled[part]}]")
    return re.compile("".join(out)).findall


@dataclass(frozen=True)
class Vocabulary:
    """A rank file and the pattern that splits a text before the merges. Its size is fixed by the tokenizer, so tasks may carry it."""

    ranks: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)


class Encoder:
    """The database with the merge table, and a cache of words."""

    def __init__(self, v: Vocabulary) -> None:
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.ranks.splitlines())}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.any_split = regex.compile(v.pattern).findall
        self.plain_split = plain_split(v.pattern) or self.any_split
        self.high = re.compile("[^\0-\uffff]").search
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, merged = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.size = np.zeros(max(self.bytes) + 2, np.int64)  # bytes of each token; the last stands for unknown ids
        self.size[list(self.bytes)] = [len(x) for x in self.bytes.values()]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for name, rows in (("merges", {"pair": pa.array((a << 32) + b), "merged": pa.array(merged)}), ("vocabulary", {"id": pa.array(list(self.bytes), pa.int32()), "bytes": pa.array([b.decode("latin-1") for b in self.bytes.values()], pa.string())})):
            self.db.register("rows", pa.table(rows))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")
        self.words: list[dict] = [{}, {}]

    def missing(self, cache: list[dict], keys: set[str]) -> list[str]:
        """The keys that aren't cached. What the older generation has moves to the younger; a full younger one becomes the older."""
        if len(cache[0]) > CACHED:
            cache[:] = [{}, cache[0]]
        young, old = cache
        lost = [k for k in keys if k not in young]
        young.update((k, old[k]) for k in lost if k in old)
        return sorted(k for k in lost if k not in old)

    def merge_words(self, words: list[str]) -> pa.Table:
        """(ids, txt) of each word, txt being the ids in decimal, joined by commas."""
        raw = [w.encode() for w in words]
        ends = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(raw), np.uint8)]))
        self.db.register("start", pa.table({"w": pa.array(np.arange(len(raw), dtype=np.int32)), "ids": ids}))
        return self.run(ENCODE, "start")

    def run(self, sql: str, rows: str) -> pa.Table:
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister(rows)
        return found

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return self.plain_split(text) if text.isascii() or not self.high(text) else self.any_split(text)

    def decode(self, ids: pa.Array | list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids; an unknown id has none. One query takes at most TOKENS tokens, of many lists or a part of one."""
        lists = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.list_(pa.int32()))
        flat = lists.flatten().fill_null(-1).to_numpy().astype(np.int64)
        decoded = []
        for i in range(0, len(flat), TOKENS):
            part = flat[i : i + TOKENS]
            self.db.register("encoded", pa.table({"pos": pa.array(np.arange(len(part), dtype=np.int32)), "id": pa.array(part)}))
            decoded.append((self.run(DECODE, "encoded")["decoded"][0].as_py() or "").encode("latin-1"))
        raw = b"".join(decoded)
        ends = np.concatenate([[0], np.cumsum(self.size[np.where((flat < 0) | (flat >= len(self.size)), len(self.size) - 1, flat)])])
        at = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])].tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word: pairs in a heap by rank, then position."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank = lambda i, j: self.ranks.get(parts[i] + parts[j]) if i >= 0 and j < len(parts) else None
        heap = [(r, i) for i in range(len(word) - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or rank(i, after[i]) != r:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if (r := rank(x, y)) is not None:
                    heapq.heappush(heap, (r, x))
        return [self.ranks[p] for p in parts if p is not None]

    def learn(self, words: set[str]) -> dict:
        """Caches (ids as decimal text, decoded bytes, ids as int32 bytes) of each word."""
        new = self.missing(self.words, words)
        short = [w for w in new if len(w) <= LONG and len(w.encode()) <= LONG]
        for i in range(0, len(short), AT_ONCE):
            part = short[i : i + AT_ONCE]
            t = self.merge_words(part)
            self.keep(part, t["ids"], t["txt"].to_pylist())
        if len(short) < len(new):
            for w in [w for w in new if len(w) > LONG or len(w.encode()) > LONG]:
                ids = self.merge_long(w.encode())
                self.keep([w], pa.chunked_array([pa.array([ids], pa.list_(pa.int32()))]), [",".join(map(str, ids))])
        return self.words[0]

    def keep(self, words: list[str], ids: pa.ChunkedArray, txt: list[str]) -> None:
        flat = ids.combine_chunks()
        raw = flat.flatten().to_numpy().astype(np.int32).tobytes()
        ends = np.cumsum(flat.value_lengths().to_numpy() * 4).tolist()
        rows = zip(txt, self.decode(flat), [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)
        self.words[0].update(zip(words, rows, strict=True))

    def encode(self, texts: list[str]) -> Iterator[list[tuple]]:
        """For each text, the cached entries of its words in order."""
        cuts = [self.split(t) for t in texts]
        need: set[str] = set()
        for c in cuts:
            need.update(c)
        entry = self.learn(need).__getitem__
        for c in cuts:
            yield list(map(entry, c))


def encoder(v: Vocabulary) -> Encoder:
    """The worker's encoder for v; it stays from task to task."""
    place = sys.modules.setdefault("_corvane_worker", types.ModuleType("_corvane_worker"))
    key = hashlib.sha256(v.ranks + v.pattern.encode()).hexdigest()
    if getattr(place, "key", None) != key:
        place.key, place.encoder = key, Encoder(v)
    return place.encoder


#: Of a cached entry.
_TXT, _DECODED, _RAW = map(itemgetter, (0, 1, 2))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = False) -> DataFrame:
    """The columns of docs but text, with n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array<int>), of each text.

    Every whole text is encoded by the merges of the vocabulary, each match of its pattern separately, and the ids are decoded
    again. Null and empty texts have no tokens. Rows stay rows, so repeated ones give equal results, and columns named like the
    results are replaced. A task works on one slice of its rows at a time; each distinct word of a slice goes through the database once,
    and caches of bounded size keep frequent ones. Nothing is shuffled; the vocabulary (about 1 MB, fixed) goes with the tasks.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kept = [c for c in docs.columns if c.lower() not in ("text", *results)]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(Vocabulary(*shared.value))
        for batch in batches:
            n, ids, decoded, raw = [], [], [], []
            for part in _groups(batch.column("text").to_pylist()):
                for x in e.encode(part):
                    txt = ",".join(map(_TXT, x))
                    n.append(txt.count(",") + 1 if txt else 0)
                    ids.append(hashlib.sha256(txt.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(_DECODED, x))).hexdigest())
                    if with_ids:
                        raw.append(b"".join(map(_RAW, x)))
            out = [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32))))
            yield pa.record_batch(out, [*kept, *results])

    d = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in kept), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])
    return d.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows (ids array<int>, ...) with decoded, the bytes of the ids; null ids decode to no bytes. An unknown id adds none."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern))
    kept = [c for c in rows.columns if c.lower() != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(Vocabulary(*shared.value))
        for batch in batches:
            found = e.decode(batch.column("ids").cast(pa.list_(pa.int32())))
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], [*kept, "decoded"])

    d = rows.select(*(F.col(f"`{c}`") for c in kept))
    return d.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema] + ["decoded binary"]))
