"""The work of substring deduplication: what is shuffled, and what the index holds after the last batch."""

import random

from corvane.llm import substring
from corvane.sources import workspace


def prose(n, seed):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(300)], k=n))


def test_tables(spark, monkeypatch):
    """Texts are filtered without a shuffle, and only repeated ones move; the last batch is compared, but makes no run that nothing reads."""
    plans = []

    def stored(df, label, by=None):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return workspace.stored(df, label, by)

    monkeypatch.setattr(substring, "stored", stored)
    passage = prose(70, 1)
    rows = [(i, f"{prose(30, 100 + i)} own{i} {passage if i % 4 else ''}") for i in range(24)]
    rows += [rows[21], rows[21]]  # in the second batch
    found = substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == sorted((i, 70 if i % 4 and i > 1 else 0) for i, _ in rows)
    labels = [label for label, _ in plans]
    assert labels.count("texts") == 2 and all("Exchange hashpartitioning" not in p for label, p in plans if label == "texts")
    assert labels.count("prints") == labels.count("docs") == labels.count("once") == 1


def test_last(spark):
    index = substring.FingerprintIndex(spark)
    passage, schema = prose(80, 2), "doc_id long, text string"
    index.add(spark.createDataFrame([(1, passage)], schema))
    held = list(index.runs)
    assert [r.n_removed for r in index.add(spark.createDataFrame([(2, "a " + passage)], schema), last=True).collect()] == [80]
    assert index.runs == held
