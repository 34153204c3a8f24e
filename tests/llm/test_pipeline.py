"""run() of the pipeline against a plain version of its five stages."""

import base64
import hashlib
import itertools
import math
import random
import re
import statistics
from collections import Counter

import corpus_pipeline
from corvane.llm.queries import multi_50k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = ["".join(random.Random(i).choices("abcdefghij", k=2 + i % 6)) for i in range(500)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def fixture():
    rows, sources = [], ["alpha", "beta", None, "Gamma"]
    for i in range(60):
        rows.append((prose(60 + 7 * (i % 13), i), sources[i % 4]))
    rows += [(rows[i][0], sources[i % 3]) for i in range(0, 30, 3)]  # exact copies, in other sources too
    near = [(rows[i][0].split(), sources[(i + 1) % 4]) for i in range(1, 40, 4)]
    rows += [(" ".join([*w[:-1], f"new{len(w)}"]), s) for w, s in near]
    rows += [(" ".join(["Ünï", *w[2:]]), s) for w, s in near[:4]]
    rows += [(None, "alpha"), ("", "beta"), (" \n\t", None), ("short text", "alpha"), ("loop " * 90, "beta"), ("### " * 60 + prose(60, 900), "beta")]
    rows += [("\n".join([prose(20, 901)] * 6), "alpha"), (prose(50, 902) + " é漢🙂 it's 3.5\n\n " + prose(20, 903), None)]
    rows += [(f"few words {i}", "spam") for i in range(45)] + [(prose(120, 950), "spam")]
    return [(i, t, "en" if i % 2 else "fr", s, len(t or "")) for i, (t, s) in enumerate(rows, 1)]


def failed(text):
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    repeated = len({i + d for i, k in enumerate(windows) if seen[k] > 1 for d in range(3)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    base = len(w) < 50 or 100 * repeated > 50 * len(w)
    soft = sum(c in "#*$%&|<>" for c in text) > 0.05 * chars or len(lines) - len(set(lines)) > 0.3 * len(lines)
    return base or soft or not 2 <= chars / len(w) <= 20


def quality(rows):
    bad = {r[0]: failed(r[1] or "") for r in rows}
    hosts = {h: [bad[r[0]] for r in rows if r[3] == h] for h in {r[3] for r in rows}}
    m = sum(bad.values()) / len(bad)
    noise = statistics.mean(1 / len(x) for x in hosts.values())
    excess = statistics.variance(sum(x) / len(x) for x in hosts.values()) - m * (1 - m) * noise
    k = max(m * (1 - m) / excess - 1 if excess > m * (1 - m) / 1001 else 1000, 0.01)
    rate = {h: (sum(x) + m * k) / (len(x) + k) for h, x in hosts.items()}
    return [r for r in rows if not bad[r[0]] and rate[r[3]] < 0.9]


def exact(rows):
    first = {}
    for r in rows:
        first[r[1]] = min(r, first.get(r[1], r))
    return list(first.values())


def near(rows):
    sets = {}
    for r in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return [r for r in rows if group[r[0]] == r[0]]


def mixed(rows):
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, rest = {}, 1.5 * sum(total.values())
    while True:
        left = [s for s in names if s not in target]
        share = {s: weight[s] * rest / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] >= 2 * total[s]]
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        rest -= sum(target[s] for s in over)
    out = []
    for s in names:
        start, demand = 0, math.floor(target[s] + 0.5)
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n = size[r[0]]
            taken = sum(max(min(start + k * total[s] + n, demand) - start - k * total[s], 0) for k in range(2))
            out += [r] * math.floor(taken / n + 0.5)
            start += n
    return out


def encoded(rows):
    import tiktoken

    v = multi_50k()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.ranks.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
    for i, text, lang, source, chars in rows:
        ids = enc.encode_ordinary(text)
        yield i, lang, source, chars, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids)


def test_run(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    good = quality(rows)
    assert not any(r[3] == "spam" for r in good) and any(r[3] is None for r in good)
    assert len(exact(good)) < len(good) and len(near(exact(good))) < len(exact(good))
    found = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = Counter((*r[:-1], tuple(r[-1])) for r in found.select(*columns).collect())
    assert got == Counter(encoded(mixed(near(exact(good)))))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_finds_the_heap_given_back(spark):
    """Heap that stages filled is free, and out of the executors' hold, before the last stage's Python workers start."""
    import corpus_pipeline

    heap, gateway = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    used = lambda: heap.totalMemory() - heap.freeMemory()
    for _ in range(8):
        garbage = gateway.new_array(gateway.jvm.long, 2 << 20)
        gateway.detach(garbage)
    filled, held = used(), heap.totalMemory()
    docs = spark.createDataFrame([(1, "one text", "en", "src1", 8)], "doc_id long, text string, lang string, source string, n_chars int")
    corpus_pipeline.encode(spark, docs, "")
    assert used() < filled - (64 << 20) and heap.totalMemory() <= held
