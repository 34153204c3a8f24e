"""Personal data: patterns, and terms that the corpus shows to disclose a protected entity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lookup, scratched
from corvane.llm.wordhash import bounds, hashes, slices
from corvane.sources.workspace import stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The share alpha of the entity's own information that the term must reveal, the least chance of the entity given the term, and the
#: documents at the entity's own rate that are added to those with the term (shrinkage). At 1, a term of one document can just pass.
ALPHA, CHANCE, PRIOR = 0.9, 0.5, 1
#: A term that gives its entity away with this chance or more is removed, others that disclose one are generalised.
REMOVE = 0.9
#: Terms of documents that a task holds before their counts are passed on.
FLUSH = 1_000_000
#: Bits of the filter by which documents are searched for disclosing terms; its hits are verified by a join.
FILTER_BITS = 1 << 26

_AT = re.compile("@")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
#: What is cut off around a word, and what makes it a term.
MARKS = ".,;:!?\"'()[]{}<>|*#%&$-_"
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER[97:123] = _LETTER[128:] = True
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from each @ backwards, so that long runs of letters cost nothing."""
    end = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCALS:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at)):
            end = d.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start; code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> bytes:
    """One name for all spellings of a value."""
    return hashlib.blake2b(f"{kind}:{value.lower() if kind == 0 else _DIGITS.sub('', value) if kind > 1 else value}".encode(), digest_size=16).digest()


def _without_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of words without the punctuation MARKS around them."""
    start, end = start.copy(), end.copy()
    for edge, at, step in ((start, 0, 1), (end, -1, -1)):
        left = np.arange(len(start))
        while len(left):
            left = left[(start[left] < end[left])]
            left = left[_MARK[data[edge[left] + at]]]
            edge[left] += step
    return start, end


@dataclass
class Terms:
    """All terms of a slice of texts: text, the key, and the places of the term and of its whole word in code points."""

    text: np.ndarray
    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    word_a: np.ndarray
    word_b: np.ndarray


def terms_of(column: pa.Array) -> Iterator[Terms]:
    """The terms of a string column, in slices; text numbers its rows.

    A term is a word in lower case without the punctuation around it, of 3 characters or more, with a letter a-z or a character beyond ASCII.
    Its key is a 64-bit hash. Lower case is taken character by character, so places are those of the original.
    """
    for row, data, offsets in slices(pc.utf8_lower(column.fill_null(""))):
        start, end, first = bounds(data, offsets)
        begins = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LETTER[data], out=letters[1:])
        s, e = _without_marks(data, start, end)
        ok = np.flatnonzero((begins[e] - begins[s] >= 3) & (letters[e] > letters[s]))
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[ok]
        zero = begins[offsets[of]]
        place = lambda x: (begins[x[ok]] - zero).astype(np.int32)  # noqa: E731, B023
        yield Terms(of + row, hashes(data, s[ok], e[ok]).view(np.int64), place(s), place(e), place(start), place(end))


def text_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def _outside(spans: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the ranges a..b touch no span."""
    ranges = sorted((x, y) for _, x, y in spans)
    starts, ends = np.array([x for x, _ in ranges]), np.maximum.accumulate(np.array([y for _, y in ranges]))
    at = np.searchsorted(ends, a, "right")
    return (at == len(ends)) | (starts[np.minimum(at, len(ends) - 1)] >= b)


_FOUND = "row binary, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<k: int, a: int, b: int>>, entities array<binary>, terms array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, spans, entities = [], [], []
        for text in batch.column("text"):
            t = text.as_py()
            base = base_spans(t)
            kinds = [k for k, _, _ in base]
            counts.append([kinds.count(i) for i in range(4)])
            spans.append([{"k": k, "a": a, "b": b} for k, a, b in base])
            entities.append(list({entity(k, t[a:b]) for k, a, b in base}))
        terms = [np.zeros(0, np.int64)] * len(batch)
        private = np.flatnonzero([len(x) > 0 for x in spans])
        for t in terms_of(batch.column("text").take(pa.array(private))):
            for i in np.unique(t.text).tolist():
                mine = t.text == i
                base = [(s["k"], s["a"], s["b"]) for s in spans[private[i]]]
                terms[private[i]] = np.unique(t.key[mine][_outside(base, t.word_a[mine], t.word_b[mine])])
        kind = pa.list_(pa.struct([("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
        arrays = [*(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(spans, kind), pa.array(entities, pa.list_(pa.binary())), pa.array(terms, pa.list_(pa.int64()))]
        yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *arrays], ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "terms"])


@dataclass(frozen=True)
class Filter:
    """A bitmap of FILTER_BITS bits over the keys of terms, whose size doesn't grow with them: it lets through all the terms that it was made of and,
    as it fills, others, which a join by key drops."""

    bits: Broadcast

    @classmethod
    def of(cls, terms: DataFrame) -> Filter:
        bit, size = F.pmod(F.col("t"), F.lit(FILTER_BITS)), 32768
        parts = terms.groupBy(F.floor(bit / size).cast("int").alias("i")).agg(F.bitmap_construct_agg(bit % size).alias("bits")).collect()
        made = bytearray(FILTER_BITS // 8)
        for p in parts:
            made[p.i * size // 8 : (p.i + 1) * size // 8] = p.bits
        return cls(terms.sparkSession.sparkContext.broadcast(bytes(made)))

    def test(self, keys: np.ndarray) -> np.ndarray:
        bit = keys & (FILTER_BITS - 1)
        return np.frombuffer(self.bits.value, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0


def frequencies(docs: DataFrame, kept: Filter) -> DataFrame:
    """(t, df): in how many documents each term that kept lets through stands. Tasks count first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def part() -> pa.RecordBatch:
            keys, df = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            return pa.record_batch([pa.array(keys), pa.array(df)], ["t", "df"])

        for batch in batches:
            for t in terms_of(batch.column(0)):
                good = kept.test(t.key)
                text, key = t.text[good], t.key[good]
                order = np.lexsort((text, key))
                text, key = text[order], key[order]
                held.append(key[np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])[: len(key)]])
                n += len(held[-1])
                if n > FLUSH:
                    yield part()
                    held, n = [], 0
        yield part()

    return docs.select("text").mapInArrow(count, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))


def _labelled(remove: float):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, every, gone, general = [], [], [], []
            for base, terms in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                b = [(s["k"], s["a"], s["b"]) for s in base or []]
                given = {(4, s["a"], s["b"]): s["given"] for s in terms or []}
                sha.append(hashlib.sha256(text_spans(b).encode()).hexdigest())
                every.append(text_spans([*b, *sorted(given)]))
                gone.append(sum(g >= remove for g in given.values()))
                general.append(len(given) - gone[-1])
            kept = ["doc_id", "n_email", "n_ip", "n_card", "n_phone"]
            arrays = [pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(gone, pa.int64()), pa.array(general, pa.int64())]
            yield pa.record_batch([*(batch.column(c) for c in kept), *arrays], [*kept, "base_sha256", "spans", "n_removed", "n_generalised"])

    return label


def disclosing_terms(found: DataFrame, docs: DataFrame, n_docs: int) -> DataFrame:
    """(t, df, given) of the terms t that disclose an entity c by the corpus; given is the greatest chance of such a c in a document with t.

    With N documents, the information of c is log2(N / df(c)) bits. t reveals PMI(c; t) = log2(n(c, t) N / (df(c) df(t))) of them,
    n(c, t) being the documents that have both. t discloses c if that is above 0 and ALPHA of c's information or more, and if
    the chance (n(c, t) + PRIOR df(c) / N) / (df(t) + PRIOR) is CHANCE or more. So terms that stand with c alone pass however rare c
    is, and others need the more documents the less they are c's own. Document frequencies cover the whole corpus: each task
    counts its terms, and the counts are summed.

    Two steps save work and change no result. Entities of the same documents have the same n(c, t), so one of them stands for all. And as
    n(c, t) is at most df(c), which is at most N, a term with df(t) > (df(c) + PRIOR) / CHANCE - PRIOR can't reach CHANCE, so its pairs aren't made.
    """
    most = lambda dfc: (dfc + PRIOR) / CHANCE - PRIOR
    private = found.filter(F.size("entities") > 0)
    held = stored(private.select("row", F.explode("entities").alias("c")), "held")
    # A sum of hashes tells which documents an entity has, repeated rows included.
    whose = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(20,0)")).alias(f"h{i}") for i in (0, 1)]
    names = stored(held.groupBy("c").agg(F.count("*").alias("dfc"), *whose), "names")
    first = names.groupBy("dfc", "h0", "h1").agg(F.min("c").alias("c")).select("c", F.lit(True).alias("first"))
    kept = lookup(held, stored(names.select("c", "dfc").join(first, "c", "left"), "classes"), "c", "dfc").filter("first").select("row", "c", "dfc")
    terms = stored(private.select("row", F.explode("terms").alias("t")), "occurring")
    rows = stored(terms.groupBy("t").agg(F.count("*").alias("rows")), "rows")
    df = stored(rows.join(frequencies(docs, Filter.of(rows)), "t"), "df")
    limit = most(names.agg(F.coalesce(F.max("dfc"), F.lit(0)).alias("n")).first()["n"])
    rare = lookup(terms, df, "t", "rows").filter(F.col("df") <= limit)
    pairs = rare.join(kept, "row").filter(F.col("df") <= most(F.col("dfc"))).groupBy("c", "t").agg(F.count("*").alias("n"), F.first("df").alias("df"), F.first("dfc").alias("dfc"))
    given = (F.col("n") + PRIOR * F.col("dfc") / n_docs) / (F.col("df") + PRIOR)
    pmi = F.log2(F.col("n") * n_docs / (F.col("dfc") * F.col("df")))
    shown = (pmi > 0) & (pmi >= ALPHA * F.log2(F.lit(n_docs) / F.col("dfc")))
    return pairs.filter(shown & (given >= CHANCE)).groupBy("t").agg(F.first("df").alias("df"), F.max(given).alias("given"))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, t, a, b) of all places in docs (row, text) of the terms t, and of the few others that the filter lets through."""
    kept = Filter.of(terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in terms_of(batch.column("text")):
                hit = kept.test(t.key)
                arrays = [batch.column("row").take(pa.array(t.text[hit])), pa.array(t.key[hit]), pa.array(t.a[hit]), pa.array(t.b[hit])]
                yield pa.record_batch(arrays, ["row", "t", "a", "b"])

    return docs.select("row", "text").mapInArrow(search, "row binary, t long, a int, b int")


def with_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, text; row is a digest of both, as ids may be null or repeat."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), text))).alias("row"), "doc_id", text.alias("text"))


def private_spans(docs: DataFrame) -> DataFrame:
    """found: one row per row of docs (row, doc_id, text): row, doc_id, counts of the patterns, base spans; and terms: all places of disclosing
    terms outside the base spans, whether the document has the entity or not, with the chance that each gives its entity away."""
    found = stored(docs.mapInArrow(_scan, _FOUND), "found")
    shown = stored(disclosing_terms(found, docs, found.count()), "shown")
    places = stored(occurrences(docs, shown), "places")
    # The count of rows of each term, false hits of the filter too, so that no task gets a hot one.
    table = places.groupBy("t").agg(F.count("*").alias("rows")).join(shown.select("t", "given"), "t", "left")
    marks = lookup(places, stored(table, "table"), "t", "rows").filter("given IS NOT NULL")
    terms = marks.groupBy("row").agg(F.collect_set(F.struct("a", "b", "given")).alias("terms"))
    out = found.drop("entities", "terms").join(stored(terms, "terms"), "row", "left")
    return out.withColumn("terms", F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["a"] < t["b"]) & (t["a"] < s["b"]))))


@scratched
def personal_data(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """One row per document of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_removed, n_generalised.

    The patterns' matches are protected entities. The terms that disclose one of them (see disclosing_terms) are spans too, wherever they
    stand in any document, of kind "term", after the others; n_removed and n_generalised say what sanitised() does with them. Null and
    empty texts have no spans; each row counts as a document, whether its doc_id is null, repeats or not. Other columns are ignored.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_removed long, n_generalised long"
    return private_spans(with_rows(docs)).mapInArrow(_labelled(remove), schema)


def sanitised(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """docs (doc_id, text) with clean_text: entities become their kind in brackets; a disclosing term is removed where it gives its
    entity away with a chance of remove or more, and is otherwise generalised to [NAME] (capitalised) or [TERM]."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(batch.column("text").to_pylist(), batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                change = {(s["a"], s["b"]): f"[{KINDS[s['k']].upper()}]" for s in reversed(base or [])}
                for s in sorted(terms or [], key=lambda s: s["given"]):
                    word = text[s["a"] : s["b"]]
                    change[s["a"], s["b"]] = "" if s["given"] >= remove else "[NAME]" if word[:1].isupper() else "[TERM]"
                parts, end = [], 0
                for (a, b), new in sorted(change.items()):
                    if a >= end:
                        parts += [text[end:a], new]
                        end = b
                out.append("".join([*parts, text[end:]]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "clean_text"])

    texts = with_rows(docs)
    return texts.join(private_spans(texts).select("row", "base", "terms").dropDuplicates(["row"]), "row").mapInArrow(write, "doc_id long, clean_text string")
