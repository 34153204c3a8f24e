"""Disclosing terms: rare entities, terms away from the entity and in documents without it, against a plain count."""

import math
import random

from corvane.llm import pii

VOCAB = [f"w{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghij"]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def marked(text, spans):
    """The words that spans of kind term mark."""
    return {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in spans.split(",") if s) if k == "term"}


def found(spark, texts):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: marked(texts[r.doc_id] or "", r.spans) for r in pii.personal_data(d).collect()}


def test_rare_entity(spark):
    """An entity in one document, and one in two: the terms that stand with it alone disclose it, common words don't."""
    texts = {i: prose(60, i) for i in range(60)}
    texts[70] = f"{prose(20, 70)} Zorblax one@x.example.com {prose(20, 71)}"
    texts[80], texts[81] = (f"{prose(20, i)} Quuxley two@x.example.com {prose(20, i + 5)}" for i in (80, 81))
    got = found(spark, texts)
    assert (got[70], got[80], got[81]) == ({"Zorblax"}, {"Quuxley"}, {"Quuxley"})
    assert not any(got[i] for i in range(60))


def test_entity_of_every_document(spark):
    """What all documents have carries no information, so no term discloses it."""
    assert found(spark, {i: f"alpha all@x.example.com beta{i}" for i in range(4)}) == {i: set() for i in range(4)}


def test_terms_of_whole_documents(spark):
    """A name far from the e-mail, and one in a document without it; rows with null and repeated ids too."""
    texts = {i: prose(60, i) for i in range(60)}
    for i in range(70, 82):
        texts[i] = f"{prose(9, i)} Farnorth {prose(30, i + 9)} three@x.example.com {prose(30, i + 19)} farnorth"
    texts[90] = f"{prose(25, 90)} Farnorth, {prose(25, 91)}"
    got = found(spark, texts)
    assert all({"Farnorth", "farnorth"} <= got[i] for i in range(70, 82)) and got[90] == {"Farnorth"}
    assert not any(got[i] for i in range(60))
    rows = [*texts.items(), (None, texts[90]), (90, prose(30, 92))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [(r.doc_id, r.spans) for r in pii.personal_data(d).filter("doc_id = 90 OR doc_id IS NULL").collect()]
    place = f"term:{texts[90].index('Farnorth')}:{texts[90].index('Farnorth') + 8}"
    assert sorted(spans, key=str) == sorted([(90, place), (None, place), (90, "")], key=str)
    clean = {(r.doc_id, r.clean_text) for r in pii.sanitised(d).collect()}
    assert not any("arnorth" in t for _, t in clean) and len(clean) == len(rows)


def test_against_plain_count(spark):
    """The marked words against the definition, counted pair by pair."""
    rng = random.Random(8)
    texts = {i: prose(rng.randint(0, 40), i) + "".join(f" t{rng.randint(0, 30)}x e{rng.randint(0, 12)}@x.example.com" for _ in range(rng.choice([0, 0, 1, 3]))) for i in range(80)}
    own = {i: ({w for w in t.split() if "@" in w}, {w for w in t.split() if "@" not in w}) for i, t in texts.items()}
    n_docs, shown = len(texts), set()
    for c in set().union(*(e for e, _ in own.values())):
        dfc = sum(c in e for e, _ in own.values())
        for t in set().union(*(w for e, w in own.values() if c in e)):
            n, df = sum(c in e and t in w for e, w in own.values()), sum(t in w for _, w in own.values())
            pmi = math.log2(n * n_docs / (dfc * df))
            if pmi > 0 and pmi >= pii.ALPHA * math.log2(n_docs / dfc) and (n + pii.PRIOR * dfc / n_docs) / (df + pii.PRIOR) >= pii.CHANCE:
                shown.add(t)
    assert len(shown) > 5 and found(spark, texts) == {i: w & shown for i, (_, w) in own.items()}
