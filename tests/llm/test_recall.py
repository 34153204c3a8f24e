"""Near-deduplication of the whole small table against all pairs, by full sets."""

import itertools
import os
import re

import pytest

from corvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="no test tables")
def test_no_link_is_lost(spark):
    sets = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)) > 0 and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_minhash_bayes"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
