import pytest
from pyspark.sql import functions as F

from corvane.config import provider, settings
from corvane.functions import text as T
from corvane.functions.stem import stem
from corvane.operators import answer
from corvane.operators.registry import Registry
from corvane.plans.analysis import analyzed, checked_requests

H = "array<struct<role:string,content:string>>"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("link", "want"),
    [("http://Finance.Example.com/News/a.html?x=1#y", "https://finance.example.com/News/a.html"), (" https://a.b/c// ", "https://a.b/c"), ("https://a.b", "https://a.b"), ("nothing", None)],
)
def test_links(spark, link, want):
    assert one(spark, link, T.canonical_link) == want


def test_titles(spark):
    assert one(spark, "Intel: Breakup?! Mulled", T.normalize_title) == "intel breakup mulled"


def test_cleaning(spark):
    clean = lambda t: one(spark, t, lambda c: T.cleaned(T.nfkc(c)))
    r = clean("Body. Text View Comments")
    assert (r.text, r.rules_applied, r.paywalled) == ("Body. Text", ["view_comments"], False)
    assert clean("A. PREMIUM Upgrade to read more. Sign in B").text == "A. B"
    assert clean("A. PREMIUM Upgrade to read").paywalled
    assert clean("read next: x").rules_applied == []  # this rule heeds case
    assert clean("One. Two available to you FREE via this link. Three").text == "One. Three"
    assert clean(clean("Body View Comments").text).rules_applied == []


def test_sentences_and_chunks(spark):
    assert one(spark, 'He said "no." Then 3 left! 42 came.', T.sentences) == ['He said "no."', "Then 3 left!", "42 came."]
    assert [len(x) for x in one(spark, "x" * 250, lambda c: T.chunks(c, 100))] == [100, 100, 50]
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(30))
    for most in (200, 350, 600):
        got = one(spark, text, lambda c, m=most: T.chunks(c, m, 0))
        assert len(got) > 1 and all(1 <= len(c) <= most for c in got) and " ".join(got) == text
    three = " ".join("A" + "b" * 58 + "." for _ in range(3))
    assert len(one(spark, three, lambda c: T.chunks(c, 90, 1))) == 3  # no room for the overlap
    with pytest.raises(ValueError):
        T.chunks(F.lit(""), 0)
    with pytest.raises(ValueError):
        T.chunks(F.lit(""), 10, -1)


def test_tokens_and_stems(spark):
    got = one(spark, "The analysts are raising Intel's targets to $175 with AI", T.tokens)
    assert [stem(w) for w in got] == ["analyst", "rais", "intel", "target", "175", "ai"]
    assert one(spark, "Tell me about the latest news, please", T.tokens) == []


def test_citations_and_markup(spark):
    check = one(spark, "a [1][2, 9] b [1]", lambda c: T.checked_citations(c, F.array(F.lit(1), F.lit(2))))
    assert (check.cited, check.invalid) == ([1, 2], [9])
    assert one(spark, "a [1] b [2, 3].", T.without_citations) == "a b."
    assert one(spark, "<a \"b\" & 'c'>", lambda c: T.escaped(c, True)) == "&lt;a &quot;b&quot; &amp; &#x27;c&#x27;&gt;"


def test_registry(spark):
    r = Registry()
    assert one(spark, "Artificial intelligence at Intel and apple; INTEL", r.tickers_in) == ["INTC", "AAPL"]
    assert one(spark, "What is Intel doing", r.without) == "What is doing"
    about = lambda title, body, feeds: spark.createDataFrame([(title, body, feeds)], "t string, b string, f array<string>").select(r.about(F.col("t"), F.col("b"), F.col("f")).alias("y")).first()["y"]
    assert about("Nvidia up", "", ["AAPL"]) == ["NVDA"]
    assert about("Markets", "Intel Intel Intel once Apple", ["X"]) == ["INTC"]
    assert about("Markets", "Apple once", ["B", "A"]) == ["A", "B"]


def test_analysis(spark):
    rows = [
        (1, "What about Amazon?", [("user", "How are Apple earnings and margins doing?")]),
        (2, "What are analysts saying about its price target?", [("user", "Tell me about Intel")]),
        (3, "Compare Apple and Nvidia", []),
        (4, "How are markets?", None),
    ]
    got = {r.qid: r for r in analyzed(spark.createDataFrame(rows, f"qid long, message string, history {H}")).collect()}
    assert (got[1].tickers, got[1].is_follow_up, got[1].standalone_query) == (["AMZN"], True, "What about Amazon? How are earnings and margins doing?")
    assert (got[2].tickers, got[2].intent) == (["INTC"], "company") and got[2].standalone_query.endswith("Intel")
    assert (got[3].intent, got[3].tickers) == ("comparison", ["AAPL", "NVDA"])
    assert (got[4].intent, got[4].is_follow_up) == ("market", False)


def test_requests_and_history(spark):
    rows = [("ok", [("user", "a")]), (" ", []), ("x" * 2001, []), ("x", [("system", "a")]), ("x", [("user", "")]), ("x", [("user", "a")] * 41)]
    got = [r.rejected for r in checked_requests(spark.createDataFrame(rows, f"message string, history {H}")).collect()]
    assert got[0] is None and all(got[1:])
    h = [("assistant", "hi"), ("user", "a"), ("user", "b"), ("assistant", "x [1]"), ("assistant", " "), ("user", "last")]
    got = spark.createDataFrame([(h,)], f"h {H}").select(answer.normalized_history(F.col("h")).alias("y")).first()["y"]
    assert [(t.role, t.content) for t in got] == [("user", "a\nb"), ("assistant", "x")]


def test_settings():
    assert settings({}).numbers["top_k"] == 8
    assert provider("auto", {"GOOGLE_API_KEY": "x"}) == "gemini" and provider("auto", {}) == "extractive"
    with pytest.raises(ValueError):
        settings({"CORVANE_TOP_K": "31"})
    with pytest.raises(ValueError):
        provider("anthropic", {})
