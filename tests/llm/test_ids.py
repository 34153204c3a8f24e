"""Null and repeated ids in near-deduplication and in the functions that remove rows."""

import itertools
import random

from corvane.llm import exact_dedup, minhash, mixing, quality_rules

VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


BASE, OTHER = prose(100, 1), prose(100, 2)
NEAR = BASE + " tail"
ROWS = [(1, OTHER, "a"), (4, NEAR, "a"), (4, OTHER + " end", "a"), (None, BASE, "a"), (None, prose(80, 3), "b"), (None, prose(80, 3) + " x", "b"), (9, prose(90, 4), None), (9, prose(90, 4), None), (None, "x", "a")]
SCHEMA = "doc_id long, text string, source string, row_key int, position string"


def table(spark):
    return spark.createDataFrame([(*r, 7, "p") for r in ROWS], SCHEMA).repartition(3)


def sets(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_groups_of_odd_ids(spark):
    group = list(range(len(ROWS)))
    for i, j in itertools.combinations(range(len(ROWS)), 2):
        x, y = sets(ROWS[i][1]), sets(ROWS[j][1])
        if 100 * len(x & y) >= 75 * len(x | y):
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((ROWS[i][0] for i in range(len(ROWS)) if group[i] == g and ROWS[i][0] is not None), default=None) for g in group}
    want = sorted(((r[0], len(sets(r[1])), least[g], r[0] == least[g]) for r, g in zip(ROWS, group, strict=True)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(table(spark)).collect()), key=str)
    assert got == want


def test_removal(spark):
    d = table(spark)
    texts = lambda rows: sorted(r.text for r in rows.collect())
    near = minhash.drop_near_copies(exact_dedup.drop_exact_copies(d))
    assert near.columns == d.columns
    got = near.collect()
    assert len(got) == 5 and {1, 9, 4} == {r.doc_id for r in got if r.doc_id is not None} and all(r.row_key == 7 and r.position == "p" for r in got)
    assert texts(exact_dedup.drop_exact_copies(d)) == sorted({r[1] for r in ROWS})
    assert texts(quality_rules.drop_bad_documents(d)) == sorted(r[1] for r in ROWS if r[1] != "x")
    mixed = mixing.mixed_documents(d)
    taken = {}
    for r in mixing.mixture(d, row="text").collect():
        taken[r.text] = taken.get(r.text, 0) + r.passes
    assert mixed.columns == d.columns and texts(mixed) == sorted(t for t, n in taken.items() for _ in range(n)) and any(r.doc_id is None for r in mixed.collect())
