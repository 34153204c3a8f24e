import json

import pytest

from corvane.functions import text as T
from corvane.operators import ingest
from corvane.operators.dense import LsaEmbedder
from corvane.operators.evaluate import below, measures, resolved
from corvane.operators.rank import RetrievalConfig, Retriever
from corvane.plans.chat import Chat
from corvane.sources import feeds
from corvane.sources.workspace import stored

H = "array<struct<role:string,content:string>>"
INTEL = "Intel shares jumped after a report that rivals may split the chipmaker. Analysts said a breakup could unlock value for Intel investors. The foundry business is hard to separate. " * 4
NVDA = "Nvidia reported record data center revenue driven by demand for accelerators. Nvidia expects the Blackwell ramp to continue through the year. " * 5
APPLE = "Apple unveiled a new iPhone with on-device features and a faster modem. Apple said the launch would arrive in stores next week. " * 5
RAW = {
    "intc": [
        {"title": "Intel breakup mulled", "link": "https://f.example.com/news/intel-1.html", "full_text": INTEL, "ticker": "x"},
        {"title": "Evercore trims Intel target", "link": "https://f.example.com/news/intel-2.html", "full_text": "Evercore cut its target. PREMIUM Upgrade to read this. Sign in"},
        {"title": " ", "link": "http://a.b"}, {"title": "a", "link": "ftp://x"}, "text", {"title": 3, "link": "http://a.b"}, {"title": "a", "link": "http://a.b", "full_text": None},
    ],
    "NVDA": [
        {"title": "Nvidia posts record quarter", "link": "https://f.example.com/news/nvda-1.html", "full_text": NVDA + " View Comments"},
        {"title": "Intel breakup mulled", "link": "https://f.example.com/news/intel-1.html?src=nv", "full_text": "short"},
    ],
    "AAPL": [{"title": "Apple teases new iPhone", "link": "https://f.example.com/news/aapl-1.html", "full_text": APPLE}],
}


@pytest.fixture(scope="module")
def corpus(spark):
    parsed = feeds.parse_feeds(spark.createDataFrame([(json.dumps(RAW),)], "value string"))
    assert feeds.validation_counts(parsed).first() == (5, 5)
    cfg = ingest.IngestConfig(300, 1, 100)
    arts = stored(ingest.articles(ingest.merged(feeds.records(parsed)), config=cfg), "articles")
    return arts, stored(ingest.chunked(arts, cfg), "chunks")


def test_bad_payload(spark):
    for bad in ("[1]", '{"A": 3}', "{"):
        with pytest.raises(Exception, match="expected a JSON object"):
            feeds.parse_feeds(spark.createDataFrame([(bad,)], "value string")).collect()


def test_report(corpus):
    r = ingest.report(*corpus, 5).first()
    assert (r.raw_records, r.duplicates_merged, r.articles, r.headline_only, r.invalid_records) == (5, 1, 4, 1, 5)
    assert r.boilerplate_removed == {"paywall": 1, "view_comments": 1} and r.articles_per_ticker == {"AAPL": 1, "INTC": 2, "NVDA": 1}


def test_greedy_merge(spark):
    rows = [(1, "A", "t one", "https://x/1", ""), (2, "B", "t two", "https://x/2", "longer"), (3, "C", "t two", "https://x/1", "zz"), (4, "A", "t three", "https://x/3", "")]
    got = {r.cand_seq: r.feeds for r in ingest.merged(spark.createDataFrame(rows, feeds.RECORD)).collect()}
    assert got == {1: ["A", "C"], 2: ["B"], 4: ["A"]}  # a bridge joins its link's article; the two stay apart


def test_chat(spark, corpus):
    r = Retriever(*corpus, RetrievalConfig(top_k=4, per_ticker_k=2, min_anchored_coverage=0.1), LsaEmbedder(8))
    q = [(1, "What is the Intel breakup about?", []), (2, "Compare Apple and Nvidia", []), (3, "weather in Toronto", []), (4, "What about Nvidia?", [("user", "What did Apple say about the launch in stores?")])]
    res, _ = Chat(r).respond(spark.createDataFrame(q, f"qid long, message string, history {H}"))
    got = {x.qid: x for x in res.collect()}
    assert got[1].answered and got[1].sources[0].title == "Intel breakup mulled" and "breakup" in got[1].answer and not got[1].invalid_citations
    assert {t for s in got[2].sources for t in s.tickers} == {"AAPL", "NVDA"} and "\nAAPL:\n" in got[2].answer
    assert not got[3].answered and got[3].uncovered == ["weather", "toronto"] and not got[3].sources
    assert got[4].plan.is_follow_up and got[4].plan.tickers == ["NVDA"]


def test_measures(spark):
    rank = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 7)], "qid long, article_id string, place int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "c"), (3, "q")], "qid long, article_id string")
    assert {r.qid: (r.hit, r.recall, round(r.rr, 4)) for r in measures(rank, rel, 5).collect()} == {1: (1.0, 0.5, 0.5), 2: (0.0, 0.0, 0.1429), 3: (0.0, 0.0, 0.0)}
    assert below({"hit": 0.9}, {"hit": 0.95}) == ["hit 0.900 < 0.950"]


def test_prefix_must_match_one(spark, corpus):
    case = lambda p: spark.createDataFrame([("x", [p])], "case_id string, relevant_titles array<string>")
    assert resolved(case("intel BREAKUP"), corpus[0]).count() == 1
    with pytest.raises(Exception, match="matched 0 articles"):
        resolved(case("nothing"), corpus[0]).collect()


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_rule_counts_name_unused_rules(spark):
    rules = [T.Rule("a", "x", "x"), T.Rule("b", "y", "y"), T.Rule("b", "z", "z")]
    arts = spark.createDataFrame([(["a"],), (["a"],), ([],)], "rules_applied array<string>")
    assert {tuple(r) for r in ingest.rule_counts(arts, rules).collect()} == {("a", 2), ("b", 0)}
    assert {tuple(r) for r in ingest.rule_counts(arts.limit(0), rules).collect()} == {("a", 0), ("b", 0)}
