"""MinHash near-deduplication with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, free_name, lookup, only, row_key, scratched, sha256
from corvane.llm.wordhash import mix, shingles, slices, words
from corvane.operators.graph import components, roots
from corvane.sources.workspace import stored

WORDS = 5
#: 32 bands of 4 rows: two documents at a similarity of 0.75 share no band with a chance of 5e-6, at 0.8 of 5e-8.
BANDS, ROWS = 32, 4
#: Four bits of each minimum, 16 minima in a number: the signature is compared 2 numbers, then 4, then 8 at a time.
NUMBERS, PER_NUMBER, STEPS = 8, 16, (2, 4, 8)
_U = np.uint64
#: A deep signature: DEEP one-byte minima, compared BYTES at a time. Members of a family are compared in blocks of about BLOCK documents and
#: BLOCK_SHINGLES shingles at most (one longer document is a block of its own).
DEEP, BYTES, BLOCK, BLOCK_SHINGLES = 1024, 128, 256, 250_000
#: Pairs that are verified together, and members of a bucket that are compared with as many others in one task.
PAIRS, BUCKET = 500, 1000
_A = np.random.RandomState(11).randint(1, 2**62, BANDS * ROWS, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_B = np.random.RandomState(13).randint(1, 2**62, BANDS * ROWS, dtype=np.int64).astype(_U)
_C = np.random.RandomState(17).randint(1, 2**62, DEEP, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_D = np.random.RandomState(19).randint(1, 2**62, DEEP, dtype=np.int64).astype(_U)


def sets(h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted shingle sets of texts with word hashes h[first[i]:first[i + 1]]."""
    s = shingles(h, WORDS)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(s[a : b - WORDS + 1])
        elif b > a:
            yield mix(np.array([(sum((i + 2) * int(x) for i, x in enumerate(h[a:b])) + (b - a)) % 2**64], _U))
        else:
            yield np.zeros(0, _U)


def signature(u: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """The minima of hash functions a * u + b over a set, taken in parts so that long texts need no more memory."""
    least = np.full(len(a), np.iinfo(np.uint64).max, _U)
    for i in range(0, len(u), 256):
        least = np.minimum(least, (u[None, i : i + 256] * a[:, None] + b[:, None]).min(1))
    return least


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, size, key, bands, bits = batch.column(0), [], [], [], []
        for _, data, offsets in slices(batch.column(1)):
            _, _, h, first = words(data, offsets, lower=True)
            for u in sets(h, first):
                size.append(len(u))
                key.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                m = mix(signature(u))
                rows = m.reshape(BANDS, ROWS)
                bands.append(mix(sum(rows[:, i] * _A[i] for i in range(ROWS))).view(np.int64))
                nibbles = (m & _U(15)).astype(np.uint8).reshape(-1, 2)
                bits.append((nibbles[:, 0] * 16 + nibbles[:, 1]).view(np.int64))
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
        b = np.array(bits, np.int64).reshape(-1, NUMBERS)
        yield pa.record_batch([ids, pa.array(size, pa.int64()), pa.array(key, pa.binary()), lists, *(pa.array(b[:, i]) for i in range(NUMBERS))], ["doc_id", "n_shingles", "key", "bands", *(f"s{i}" for i in range(NUMBERS))])


def _measured(floor: int):
    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        pivots = dict(zip(right.column("a").to_pylist(), text_sets(right.column("ta").combine_chunks()), strict=True))
        a, b = (left.column(c).to_numpy() for c in "ab")
        both, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for i, y in enumerate(text_sets(left.column("tb").combine_chunks())):
            x = pivots[int(a[i])]
            both[i] = len(np.intersect1d(x, y, assume_unique=True))
            union[i] = len(x) + len(y) - both[i]
        keep = 100 * both >= floor * union
        return pa.table({n: pa.array(c[keep]) for n, c in (("a", a), ("b", b), ("both", both), ("union", union))})

    return measure


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 500):
            part = batch.slice(k, 500)
            yield pa.record_batch([part.column(0), pa.array([u.tobytes() for u in text_sets(part.column(1))], pa.binary())], ["doc_id", "set"])


def _linked(bar: list[int], at_least: int):
    """Links between two blocks of a family, across components; of links that join the same components, one is enough."""

    def compare(t: pa.Table) -> pa.Table:
        ids, comp, left, size = (t.column(c).to_numpy() for c in ("doc_id", "component", "left", "n_shingles"))
        full = [np.frombuffer(b, _U) for b in t.column("set").to_pylist()]
        sig = np.array([(mix(signature(u, _C, _D)) >> _U(56)).astype(np.uint8) for u in full]).reshape(-1, DEEP)
        x = np.flatnonzero(left)
        y = x if left.all() else np.flatnonzero(~left)
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        out = []
        for i in range(0, len(x), 64):
            part = x[i : i + 64]
            ok = (comp[part][:, None] != comp[y][None]) & (100 * np.minimum(size[part][:, None], size[y][None]) >= at_least * np.maximum(size[part][:, None], size[y][None]))
            p, q = np.nonzero(ok)
            p, q = part[p], y[q]
            n = np.zeros(len(p), np.int32)
            for k, least in enumerate(bar):
                cut = slice(k * BYTES, (k + 1) * BYTES)
                n += (sig[p, cut] == sig[q, cut]).sum(1, dtype=np.int32)
                stay = n >= least
                p, q, n = p[stay], q[stay], n[stay]
            order = np.argsort(-n, kind="stable")  # the likeliest first: a link spares the other pairs of its components
            for a, b in zip(p[order].tolist(), q[order].tolist(), strict=True):
                ra, rb = root(int(comp[a])), root(int(comp[b]))
                if ra != rb:
                    both = len(np.intersect1d(full[a], full[b], assume_unique=True))
                    if 100 * both >= at_least * (len(full[a]) + len(full[b]) - both):
                        up[max(ra, rb)] = min(ra, rb)
                        out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return compare


def text_sets(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, data, offsets in slices(texts):
        _, _, h, first = words(data, offsets, lower=True)
        out += sets(h, first)
    return out


def least_matches(threshold: float, miss: float, batch: int, batches: int, chance: float) -> list[int]:
    """For each number of signature values compared, batch at a time: the fewest matches with which a pair stays.

    Values of two documents match with chance p = s + (1 - s) * chance, where chance is that of values of different minima to be equal (1/2 for a
    bit, 1/256 for a byte). With s uniform a priori, the posterior after m matches of n is proportional to p^m (1 - p)^(n - m). A pair is
    pruned when the posterior chance of s >= threshold is below miss.
    """
    s = (np.arange(20000) + 0.5) / 20000
    p, out = s + (1 - s) * chance, []
    for n in range(batch, batch * batches + 1, batch):
        low, high = 0, n  # the posterior chance rises with m
        while low < high:
            m = (low + high) // 2
            w = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(w - w.max())
            low, high = (low, m) if w[s >= threshold].sum() >= miss * w.sum() else (m + 1, high)
        out.append(low)
    return out


def similarities(pairs: DataFrame, docs: DataFrame, floor: int) -> DataFrame:
    """(a, b, both, union) of those of pairs (a, b) whose full shingle sets have a Jaccard similarity of floor / 100 or more.

    Pairs are dealt into groups of about PAIRS; those of an a with more are cut by salt, and its text goes once to each of its groups, not to each pair.
    """
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = stored(only(docs, ids, "doc_id"), "texts")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    groups = max(1, pairs.count() // PAIRS)
    pivots = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PAIRS).cast("int")), "pivots")
    group = F.pmod(F.xxhash64("a", "salt"), F.lit(groups)).alias("g")
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    left = lookup(pairs, pivots, "a", "n").withColumn("salt", salt).select(group, "a", "b").join(side("b"), "b")
    right = pivots.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(group, "a").distinct().join(side("a"), "a")
    found = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_measured(floor), "a long, b long, both long, union long")
    return stored(found, "similarities")


def family_links(members: DataFrame, docs: DataFrame, at_least: int, miss: float) -> DataFrame:
    """Links (a, b) within families, across components: members (family, doc_id, component, n_shingles).

    The largest component of a family is its core; pairs inside the core are linked already. Core and rest are cut into blocks, and each pair of
    blocks (rest and core, rest and rest) is one group of bounded size, whatever the family's. A group compares deep signatures in
    batches of BYTES values, verifies what no batch prunes on the full sets, and gives back links alone, so pairs never become rows.
    """
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    core = sizes.groupBy("family").agg(F.max_by(F.struct("component", "n", "s"), F.struct("n", "component")).alias("c"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("c.n < n")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    core = stored(core.select("family", F.col("c.component").alias("core"), blocks(F.col("c.n"), F.col("c.s")).alias("mb"), blocks(F.col("n") - F.col("c.n"), F.col("s") - F.col("c.s")).alias("ub")), "cores")
    m = stored(members.join(core, "family"), "members")
    texts = only(docs, m.select("doc_id").distinct(), "doc_id")
    m = m.join(stored(texts.mapInArrow(_sets, "doc_id long, set binary"), "sets").dropDuplicates(["doc_id"]), "doc_id")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    key = lambda kind, i, j, left: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inner = F.transform(upto("ub"), lambda j: key("rest", F.least(block("ub"), j), F.greatest(block("ub"), j), block("ub") <= j))
    outer = F.transform(upto("mb"), lambda j: key("core", block("ub"), j, F.lit(True)))
    of_core = F.transform(upto("ub"), lambda i: key("core", i, block("mb"), F.lit(False)))
    m = m.withColumn("k", F.explode(F.when(F.col("component") == F.col("core"), of_core).otherwise(F.concat(inner, outer))))
    bar = least_matches(at_least / 100, miss, BYTES, DEEP // BYTES, 1 / 256)
    m = m.select("family", "k.*", "doc_id", "component", "n_shingles", "set")
    return stored(m.groupBy("family", "kind", "i", "j").applyInArrow(_linked(bar, at_least), "a long, b long"), "inside")


@scratched
def near_groups(docs: DataFrame, at_least: int = 75, miss: float = 1e-7, family: int = 50) -> DataFrame:
    """One row per document of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and split at white space; a document's set is its distinct 5-word shingles (a shorter text is one
    shingle; null and empty texts have none and are linked with nothing). Documents with 100 * |x & y| >= at_least * |x | y| are
    linked; component_id is the smallest doc_id reachable, and that document is kept. Repeated rows and rows with equal sets are
    one class, represented by its smallest id. Rows with null ids and texts that share an id are documents of their own, linked like
    others; a component of null ids alone has a null component_id. Other columns are ignored.

    Classes first, so copies are never compared. Then bands of the representatives' MinHash signatures form buckets, and links are
    sought in steps. (1) Each document with that bucket pivot (the smallest id) that it shares most bands with: one comparison a document, which
    joins most near copies to their group. (2) Pairs of a similarity of family / 100 or more there make families; in each, what isn't
    linked to the core yet is compared with all the rest by family_links(). (3) Across families, pairs that share a bucket are compared in a
    join whose condition takes signature bits batch by batch. Steps 2 and 3 prune a pair once the posterior chance of reaching the threshold
    is below miss, before it becomes a row; survivors are verified on their full texts. So every pair that shares a bucket is compared
    unless its ends are linked already, whatever the size of its bucket.
    """
    docs, names = _one_id_each(docs)
    profiles = stored(docs.mapInArrow(_profiles, "doc_id long, n_shingles long, key binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(NUMBERS))), "profiles")
    full = profiles.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id"])
    reps = stored(reps.drop("key"), "representatives")
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "h")).select("doc_id", F.xxhash64("band", "h").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).filter("pivot < last").select("bucket", "pivot")
    # One row a bucket on the right, so Spark may split a hot bucket's rows on the left (adaptive skew joins), as in the next join by bucket.
    shared = stored(banded.join(stored(pivots, "pivots"), "bucket"), "shared")

    first = shared.filter("doc_id > pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("n"))
    first = first.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("best"))
    near = similarities(stored(first.select((-F.col("best.p")).alias("a"), F.col("doc_id").alias("b")), "first"), docs, min(family, at_least))
    linked = lambda d: d.filter(f"100 * both >= {at_least} * union").select("a", "b")
    labels, families = stored(roots(linked(near)), "labels"), stored(roots(near), "families")  # each b has one a, so both are forests
    placed = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = stored(placed.withColumn("component", F.coalesce("component", "doc_id")), "placed")
    sketch = reps.drop("bands")
    inside = family_links(placed.join(sketch.select("doc_id", "n_shingles"), "doc_id"), docs, at_least, miss)

    m = least_matches(at_least / 100, miss, PER_NUMBER, NUMBERS, 1 / 16)
    marked = shared.select("doc_id", "bucket").join(placed.select("doc_id", "family"), "doc_id", "left")
    marked = stored(marked.withColumn("family", F.coalesce("family", "doc_id")), "marked")
    # A bucket's members are cut into blocks; each pair of blocks is compared under a key of its own, so no task gets a whole hot bucket.
    open_ = marked.groupBy("bucket").agg(F.min("family").alias("x"), F.max("family").alias("y"), F.count("*").alias("n")).filter("x < y")
    open_ = stored(open_.select("bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks")), "open")
    rest = marked.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rest = stored(rest.select("doc_id", "family", "bucket", "blocks", "block").join(sketch, "doc_id"), "rest")
    x = rest.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = rest.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    spread = lambda v: f"bit_count(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & 1229782938247303441)"  # noqa: E731  of 4-bit groups, those that differ
    unlike = lambda n: " + ".join(spread(f"(x.s{i} ^ y.s{i})") for i in range(n))
    fits = F.expr(
        f"x.bucket = y.bucket AND x.i = y.i AND x.j = y.j AND x.doc_id < y.doc_id AND x.family <> y.family AND 100 * least(x.n_shingles, y.n_shingles) >= {at_least} * greatest(x.n_shingles, y.n_shingles) AND "
        + " AND ".join(f"{unlike(n)} <= {n * PER_NUMBER - m[n - 1]}" for n in STEPS)
    )
    pairs = stored(x.join(y, fits).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "pairs")
    more = inside.unionByName(linked(similarities(pairs, docs, at_least))) if pairs.head(1) else inside
    if more.head(1):  # the other links join components
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        joins = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        new = components(joins).withColumnRenamed("component", "to").withColumnRenamed("node", "component")
        old = labels.unionByName(new.select(F.col("component").alias("node"), "component").join(labels.select("node"), "node", "left_anti"))
        labels = stored(old.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "joined")
    found = stored(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "n", F.coalesce("component", "rep").alias("component")), "found")
    out = lookup(profiles.select("doc_id", "n_shingles", "key"), found, "key", "n")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    if names is not None:
        out = _own_ids(out, names)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _one_id_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one text an id; and, if some ids of docs are null or have several texts, what these rows are called instead: (doc_id, own), whose
    doc_id lies above 2^62 and comes from the id and the text."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("own", F.col("doc_id"))
    ids = d.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id", F.lit(True).alias("odd"))
    ids = stored(ids, "odd_ids")
    if not ids.head(1):
        return d.select("doc_id", "text"), None
    again = ids.filter("doc_id IS NOT NULL")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    name = F.lit(1 << 62) + F.pmod(F.xxhash64("own", "text"), F.lit(1 << 61))
    d = d.join(again, "doc_id", "left").withColumn("odd", F.coalesce("odd", F.col("doc_id").isNull()))
    d = d.withColumn("doc_id", F.when(F.col("odd"), name).otherwise(F.col("doc_id")))
    names = stored(d.filter("odd").select("doc_id", "own").distinct(), "names")
    return d.select("doc_id", "text"), names


def _own_ids(out: DataFrame, names: DataFrame) -> DataFrame:
    """out (doc_id, n_shingles, component_id) with the ids of docs; a component is named by the smallest id that its documents have, if any."""
    out = stored(out, "named")
    least = F.min(F.when(F.col("doc_id") < F.lit(1 << 62), F.col("doc_id")).otherwise(F.col("own")))
    place = out.select("doc_id", "component_id").distinct().join(names, "doc_id", "left").groupBy("component_id").agg(least.alias("least"), F.count("*").alias("n"))
    out = lookup(out, stored(place, "places"), "component_id", "n").join(names, "doc_id", "left")
    odd = F.col("doc_id") >= F.lit(1 << 62)
    return out.select(F.when(odd, F.col("own")).otherwise(F.col("doc_id")).alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def drop_near_copies(docs: DataFrame, at_least: int = 75) -> DataFrame:
    """docs with one document of each group of near_groups(), null and repeated ids or not; all columns stay. Of rows equal in id and text, all or
    none stay, so exact copies are for drop_exact_copies()."""
    name = free_name(docs, "row_key")
    # Rows with an id of their own keep it, so groups keep their smallest id; others are named by their keys.
    rows = docs.withColumn(name, row_key(sha256()))
    ids = stored(rows.select("doc_id", name).distinct(), "ids")
    odd = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id")
    odd = stored(odd, "odd_ids")
    if not odd.head(1):
        gone = stored(near_groups(docs, at_least).filter("NOT kept").select("doc_id").distinct(), "near")
        return only(docs, gone, "doc_id", "left_anti")
    odd = odd.select(F.col("doc_id").alias("odd_id"), F.lit(True).alias("odd"))
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd
    ids = ids.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left")
    ids = stored(ids.withColumn("id", F.when(F.col("odd"), F.lit(1 << 62) + F.pmod(F.xxhash64(name), F.lit(1 << 61))).otherwise(F.col("doc_id"))).select(name, "id"), "named")
    texts = rows.select(name, "text").join(ids, name).select(F.col("id").alias("doc_id"), "text")
    gone = near_groups(texts, at_least).filter("NOT kept").select(F.col("doc_id").alias("id")).distinct()
    gone = stored(ids.join(gone, "id", "left_semi").select(name).distinct(), "near")
    return only(rows, gone, name, "left_anti").drop(name)
