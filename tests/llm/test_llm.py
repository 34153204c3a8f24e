"""Each operator against a brute-force version, on the small table and on odd rows."""

import base64
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, classifier, exact_dedup, licenses, mixing, minhash, pii, quality_rules, substring, url_lists
from corvane.llm.queries import multi_50k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(3)
VOCAB = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


BASE = prose(300, 1)
PASSAGE = prose(60, 2)
TEXTS = [
    None, "", " \n\t", "one", "Ünï   x", BASE, BASE, BASE.upper().lower(), BASE.replace(" ", "  ", 3), " ".join(BASE.split()[:290] + ["zzz"]), " ".join(["q"] + BASE.split()[20:]),
    prose(80, 4) + "\n" + PASSAGE + "\n" + prose(40, 5), PASSAGE + " " + prose(90, 6), "a b c d", "a b c d", "x " * 3000, prose(6000, 7), "###*** $$$ " * 30, BASE + " " + PASSAGE,
    "mail joe.x@a-b.example.com or +1 (988) 555-2485, card 4111 1111 1111 1111, ip 10.0.0.1 and 999.1.1.1",
]
SCHEMA = "doc_id long, text string, source string, h string, key string, n long, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, repeated rows, a null source and columns that clash with the operators' own."""
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "h", "k", 1, "en") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, BASE, "s1", "h", "k", 1, "en")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, empty, weak):
    digest = (lambda t: F.lit(b"x")) if weak else exact_dedup.md5_128  # one bucket for all: every group collides
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, "max", digest).collect()}
    pairs = [(i, t or "") for i, t in [*enumerate(TEXTS), (5, BASE), (None, BASE)]]
    want = set()
    for i, t in pairs:
        same = [j for j, u in pairs if u == t]
        keep = max(j for j in same if j is not None)
        want.add((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == want and exact_dedup.exact_groups(empty).count() == 0
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()} >= {0, 3, 5}


def shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in s}
    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(s[i]), comp[i]) for i in s}


def test_near(docs, empty, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs).filter("doc_id IS NOT NULL").collect()}
    assert got == brute_components(dict(enumerate(TEXTS))) and minhash.near_groups(empty).count() == 0
    rng, base, family = random.Random(5), prose(100, 9).split(), {}
    for i in range(150):  # one family, its members changed in 0 to 8 places, so that links are many but not all
        w = list(base)
        for j in rng.sample(range(100), rng.randint(0, 8)):
            w[j] = f"new{i}x{j}"
        family[i] = " ".join(w)
    d = spark.createDataFrame(list(family.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(d).collect()} == brute_components(family)


def cut(rows):
    """What is left of each row (doc_id, text), counted window by window."""
    starts, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 49) if i is not None else ():
            starts[tuple(w[j : j + 50])] = min(i, starts.get(tuple(w[j : j + 50]), i))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 49) if i is not None else ():
            if starts[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def removed(d, batches):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicated(d, batches).collect()), key=str)


def test_substring(docs, empty):
    """Null and repeated ids too; one text of a repeated id is cut by others, not by its namesake."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert removed(docs, 2) == cut(rows)
    assert substring.deduplicated(empty).count() == 0


def test_substring_levels(spark, monkeypatch):
    """Repeated ids with different texts, and more batches than a level holds runs."""
    monkeypatch.setattr(substring, "RUNS", 2)
    a, b = prose(70, 31), prose(65, 32)
    rows = [(i, f"{prose(30 + i, 700 + i)} {a if i % 3 else b} {prose(20, 800 + i)}") for i in range(12)]
    rows += [(3, a + " " + b), (5, prose(60, 5)), (5, b), (2, f"{b} {a}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(d, 4) == cut(rows)


def test_bpe(docs, empty, spark):
    import tiktoken

    v = multi_50k()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.ranks.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(docs.filter("doc_id IS NOT NULL"), v, with_ids=True).collect()
    for r in got:
        t = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode(spark.createDataFrame([(1, [1, 2, 3]), (2, None)], "i int, ids array<int>"), v).orderBy("i").collect()
    assert (bytes(back[0].decoded), bytes(back[1].decoded)) == (enc.decode_bytes([1, 2, 3]), b"")
    assert bpe.encode_decode(empty, v).count() == 0
    e, rng = bpe.Encoder(v), random.Random(1)
    parts = ["a", "b", " ", "\n", "'s", "'", "1", "é", "漢", "\x1c", "\xa0", "!!", "²", "\0", "́", "🙂", " the"]
    odd = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["a" * 5000, " " * 700, "ü" * 900]
    for t, x in zip(odd, e.encode(odd), strict=True):
        assert ",".join(y[0] for y in x) == ",".join(map(str, enc.encode_ordinary(t)))


def test_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    for i, t in enumerate(TEXTS):
        w, r = WORD.findall(t or ""), got[i]
        win = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        many = {k for k in win if win.count(k) > 1} if len(win) < 1000 else {k for k, n in __import__("collections").Counter(win).items() if n > 1}
        rep = len({j + d for j, k in enumerate(win) if k in many for d in range(3)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), rep, len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_verdicts(empty).count() == 0


def test_mix(docs, empty):
    m = mixing.mixture(docs.filter("doc_id IS NOT NULL"))
    rows = m.collect()
    for target in {(r.target, r.source_size) for r in rows}:
        of = [r for r in rows if (r.target, r.source_size) == target]
        assert abs(sum(r.taken for r in of) - target[0]) <= 1
    assert all(r.taken <= 2 * r.size for r in rows) and sorted(map(str, rows)) == sorted(map(str, mixing.mixture(docs.filter("doc_id IS NOT NULL")).collect()))
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_pii(docs, empty, spark):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert (got[19].n_email, got[19].n_ip, got[19].n_card, got[19].n_phone) == (1, 1, 1, 1) and got[5].spans == ""
    assert pii.personal_data(empty).count() == 0 and len(got) == len(TEXTS) + 1
    rows = [(i, f"{prose(12, i)} agent Zorblax joe@x.example.com {prose(12, 99 + i)}") for i in range(6)] + [(50 + i, prose(40, 500 + i)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data(d).collect()}
    assert all("term:" in spans[i] for i in range(6)) and not any(spans[50 + i] for i in range(60))
    clean = {r.doc_id: r.clean_text for r in pii.sanitised(d).collect()}
    assert "Zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[50] == rows[6][1]
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choices("a.b@-1 2.5+()", k=30))
        assert list(pii.emails(t)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]


def test_classifier(spark, docs, empty):
    rows = [(i, prose(40, i) if i % 3 else prose(20, i).replace(" ", "%%% ")) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    held = [r for r in classifier.quality_scores(d, labels).collect() if r.held_out]
    assert len(held) > 30 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    none = labels.limit(0)
    assert all(r.score == 0.5 for r in classifier.quality_scores(docs, none).collect()) and classifier.quality_scores(empty, none).count() == 0


def test_licences(spark, docs, empty):
    mit = licenses.BODIES[0][2]
    d = spark.createDataFrame([(1, "Copyright (c) 2020 X\n\n" + mit.upper().replace(",", " ;")), (2, "foo\nReleased under the MIT Licence."), (3, None), (4, "Copyright 2020")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.license_scan(d).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")}
    assert licenses.license_scan(empty).count() == 0


def test_url_lists(spark):
    events = spark.createDataFrame([("bad.com", "add", 10), ("bad.com", "remove", 20), ("ok.com/x/", "add", 5), ("z.com", "add", 3), ("z.com", "remove", 3), (None, "add", 1)], "entry string, action string, day int")
    events = events.select("entry", "action", F.timestamp_seconds(F.col("day") * 86400).alias("at"))
    caps = spark.createDataFrame([(1, "http://a.bad.com/q", 15), (2, "http://a.bad.com/q", 20), (3, "https://OK.com/x/y?z", 9), (4, "https://ok.com/xy", 9), (5, None, 9), (6, "http://z.com", 4), (7, "http://bad.com", None)], "page_id long, url string, day int")
    caps = caps.select("page_id", "url", F.timestamp_seconds(F.col("day") * 86400).alias("fetched_at"))
    more = caps.union(caps.filter("page_id IN (1, 5)")).withColumn("entry", F.lit("clash"))
    assert sorted((r.page_id, r.entry) for r in url_lists.temporal_verdicts(more, events).collect() if r.page_id in (1, 5)) == [(1, "bad.com"), (1, "bad.com"), (5, None), (5, None)]
    rows = [(1, "http://ok.com/Folder/x"), (2, "http://OK.com/folder/x"), (3, "http://[2001:db8::1]:80/a"), (4, "http://10.0.0.1/"), (5, "http://ok.com/" + "a/" * 5000)]
    odd = spark.createDataFrame(rows, "page_id long, url string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    listed = spark.createDataFrame([("Ok.com/Folder/",), ("[2001:DB8::1]",), ("0.1",)], "entry string").select("entry", F.lit("add").alias("action"), F.lit("2023-01-01").cast("timestamp").alias("at"))
    assert {r.page_id: r.entry for r in url_lists.temporal_verdicts(odd, listed).collect()} == {1: "ok.com/Folder/", 2: None, 3: "[2001:db8::1]", 4: None, 5: None}
    assert not any(r.blocked for r in url_lists.temporal_verdicts(odd, listed.limit(0)).collect())
    assert {r.page_id: r.entry for r in url_lists.temporal_verdicts(caps, events).collect()} == {1: "bad.com", 2: None, 3: "ok.com/x/", 4: None, 5: None, 6: None, 7: None}
    assert url_lists.temporal_verdicts(caps.limit(0), events).count() == 0
