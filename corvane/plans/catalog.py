"""The named queries over the driver's tables, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.stem import stems
from corvane.operators import answer, dense, evaluate, ingest, lexical
from corvane.operators.rank import RetrievalConfig, Retriever, fused, gate, interleaved, selected, widened
from corvane.operators.registry import Company, Registry
from corvane.plans import analysis
from corvane.plans.chat import Chat, health
from corvane.sources import feeds, sinks
from corvane.sources.workspace import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HISTORY = "array<struct<role:string,content:string>>"

#: Frequent words of the test tables stand for companies, a recurring line for boilerplate.
WORDS = Registry(tuple(Company(w.upper(), w) for w in ("thble", "thtion", "attion", "erble", "ertion", "thanea", "nicht")))
LINE = "The and attion to thanedble the, anea."
RULES = [T.Rule("recurring_line", r"(?i)The and attion to thanedble the, anea\.", "thanedble the, anea.")]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ SQL that several queries share

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN ({STOP}) AND (length(w) > 1 OR regexp_matches(w, '[0-9]')))"


MENTIONS = "list_transform(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: w IN ('thble', 'thtion', 'attion', 'erble', 'ertion', 'thanea', 'nicht')), lambda w: upper(w))"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CANON = r"CASE WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN 'https://' || lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)', 1)) || rtrim(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)', 2), '/') END"
RECORDS = f"""r AS (SELECT doc_id AS seq, upper(source) AS feed, {STRIP.format("substr(string_split(coalesce(text, ''), chr(10))[1], 1, 120)")} AS title,
    'https://docs.example.com/' || md5(coalesce(text, '')) AS link, {STRIP.format("coalesce(text, '')")} AS full_text FROM documents)"""
MERGED = f"""{RECORDS},
    f AS (SELECT link, feed, min(seq) AS at_, count(*) AS n FROM r GROUP BY link, feed),
    g AS (SELECT link, list(feed ORDER BY at_) AS feeds, sum(n)::BIGINT AS records, min(at_) AS cand_seq FROM f GROUP BY link),
    m AS (SELECT g.*, b.title, b.full_text FROM g JOIN (SELECT *, row_number() OVER (PARTITION BY link ORDER BY length(full_text) DESC, seq) AS i FROM r) b ON g.link = b.link AND b.i = 1)"""
CLEAN = rf"""{MERGED},
    a AS (SELECT substr(sha1(link), 1, 12) AS article_id, cand_seq, title, link, feeds, records, contains(lower(full_text), 'thanedble the, anea.') AND regexp_matches(full_text, '(?i)The and attion to thanedble the, anea\.') AS hit,
        trim(regexp_replace(regexp_replace(full_text, '(?i)The and attion to thanedble the, anea\.', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), ' ') AS text FROM m)"""
TAGGED = f"""{CLEAN},
    x AS (SELECT *, {MENTIONS.format("title")} AS mt, {MENTIONS.format("text")} AS mb FROM a),
    y AS (SELECT *, list_distinct(list_concat(mt, mb)) AS every FROM x),
    z AS (SELECT *, list_transform(every, lambda t: 5 * len(list_filter(mt, lambda m: m = t)) + len(list_filter(mb, lambda m: m = t))) AS score FROM y),
    w AS (SELECT *, list_filter(every, lambda t: list_contains(mt, t) OR score[list_position(every, t)] >= greatest(3.0, 0.25 * list_max(score))) AS about FROM z),
    tagged AS (SELECT article_id, cand_seq, title, link, feeds, records, hit, text, list_sort(CASE WHEN len(about) > 0 THEN about ELSE feeds END) AS tickers, length(text) < 400 AS headline_only FROM w)"""
BM25 = f"""d AS (SELECT doc_id AS c, source, {tok("coalesce(text, '')")} AS k FROM documents), s AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM d),
    p AS (SELECT w AS term, c, count(*) AS tf, any_value(dl) AS dl FROM (SELECT c, len(k) AS dl, unnest(k) AS w FROM d) GROUP BY w, c), t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest({tok("text")}) AS term FROM benchmark)),
    b AS (SELECT qid, c, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN t USING (term), s GROUP BY qid, c),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, c) AS rank FROM b)"""
SRC0 = """bf AS (SELECT b.* FROM b JOIN d ON b.c = d.c WHERE source = 'src' || (qid % 20)), rf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, c) AS rank FROM bf)"""


# ------------------------------------------------------------------ inputs


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merged_by_link(feeds.documents_as_records(table(spark, sf_dir, "documents")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.articles(merged(spark, sf_dir), WORDS, rules=RULES)


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.tokens(F.col("text")).alias("tokens"))


def doc_index(spark: SparkSession, sf_dir: str) -> lexical.Postings:
    return lexical.build(stored(doc_tokens(spark, sf_dir), "tokens"))


def source_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question may use the documents of one source."""
    q = questions(spark, sf_dir).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("source"))
    return q.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), "source"), "source").select("qid", "chunk_idx")


def doc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), F.col("source").alias("article_id"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each last user turn, with the turns before it; system turns are left out."""
    c = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    last = c.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    j = c.join(last, "conv_id").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("message"),
        F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", "role", F.col("text").alias("content"))))).alias("h"),
    )
    return j.select(F.col("conv_id").alias("qid"), "message", F.transform("h", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history"))


CONVERSATIONS = """c AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')), l AS (SELECT conv_id, max(turn) AS last FROM c WHERE role = 'user' GROUP BY conv_id),
    cv AS (SELECT conv_id AS qid, max(text) FILTER (turn = last) AS message, coalesce(list(struct_pack(role := role, content := text) ORDER BY turn) FILTER (turn < last), []) AS history FROM c JOIN l USING (conv_id) GROUP BY conv_id)"""


# ------------------------------------------------------------------ functions


@query("f1_canonical_link", f"SELECT page_id, {CANON.format('url')} AS link FROM pages")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_link(F.col("url")).alias("link"))


@query("f2_normalize_title", f"WITH {RECORDS} SELECT seq, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ') AS title FROM r")
def f2(spark, sf_dir):
    return feeds.documents_as_records(table(spark, sf_dir, "documents")).select("seq", T.normalize_title(F.col("title")).alias("title"))


@query("f3_article_id", f"SELECT page_id, substr(sha1({CANON.format('url')}), 1, 12) AS article_id FROM pages")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.article_id(F.col("url")).alias("article_id"))


@query("f5_clean_rules", f"WITH {CLEAN} SELECT article_id, md5(text) AS text_md5, length(text) AS chars, CASE WHEN hit THEN 'recurring_line' ELSE '' END AS rules FROM a")
def f5(spark, sf_dir):
    return corpus(spark, sf_dir).select("article_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("chars"), F.array_join("rules_applied", ",").alias("rules"))


#: A text for each of the news rules, as a page may hold it; none for the last.
PLANTED = [
    "PREMIUM Upgrade to read this MT Newswires article and get more. Sign in", "Why are we interested in the stocks that hedge funds pile into? The reason is simple (see more details here).", "READ NEXT: five more stocks to read about",
    "story continues", "Want the latest recommendations from Zacks Investment Research? Download it today", "Yahoo Finance Video • 12 hours ago 10:42", "View Comments", "Disclosure: None.",
    "This article is originally published at Insider Monkey.", "was originally published by The Motley Fool", "This post was written by Ann O'Neil-Smith.", "Benzinga does not provide investment advice. All rights reserved.",
    "Read the latest financial and business news from Yahoo Finance", "Continue Reading  ", "A report is available to you FREE via this link.", "",
]


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _news_sql() -> str:
    """The rules one after the other, each on what the ones before left."""
    of = "[" + ", ".join(map(_sql, PLANTED)) + "]"
    text = f"coalesce(text, '') || '  ' || {of}[1 + doc_id % 16] || '. More words follow. ' || {of}[1 + (doc_id // 16) % 16] || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' The end.' END"
    steps = [f"r0 AS (SELECT doc_id, {text} AS t, []::VARCHAR[] AS names FROM documents)"]
    for i, r in enumerate(T.NEWS_RULES):
        p = _sql(re.sub(r"^\(\?([a-zA-Z]+)\)", lambda m: f"(?{m[1].replace('U', '')})" if m[1] != "U" else "", r.pattern))
        steps.append(f"r{i + 1} AS (SELECT doc_id, regexp_replace(t, {p}, ' ', 'g') AS t, CASE WHEN regexp_matches(t, {p}) AND NOT list_contains(names, '{r.name}') THEN list_append(names, '{r.name}') ELSE names END AS names FROM r{i})")
    return f"WITH {', '.join(steps)} SELECT doc_id, md5(trim(regexp_replace(t, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) AS text_md5, array_to_string(names, ',') AS rules, list_contains(names, 'paywall') AS paywalled FROM r{len(T.NEWS_RULES)}"


@query("f5_news_rules", _news_sql())
def f5_news(spark, sf_dir):
    """Every rule on documents into which texts that it removes were put."""
    of = ", ".join(_sql(x) for x in PLANTED)
    first, second = (F.expr(f"element_at(array({of}), cast({at} as int))") for at in ("1 + doc_id % 16", "1 + floor(doc_id / 16) % 16"))
    end = F.when(F.col("doc_id") % 2 == 0, "").otherwise(" The end.")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("  "), first, F.lit(". More words follow. "), second, end)
    c = table(spark, sf_dir, "documents").select("doc_id", T.cleaned(T.nfkc(text)).alias("c"))
    return c.select("doc_id", F.md5("c.text").alias("text_md5"), F.array_join("c.rules_applied", ",").alias("rules"), "c.paywalled")


@query(
    "f7_sentences",
    rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]["”’)]?)[\s\p{{Z}}]+([A-Z0-9"“‘(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM s""",
)
def f7(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query(
    "f9_chunks",
    rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]["”’)]?)[\s\p{{Z}}]+([A-Z0-9"“‘(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS s FROM documents),
    n AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN length(x) > 900 THEN list_transform(regexp_extract_all(x, '(?s)(.{{1,900}}$|.{{1,899}} |.{{900}}) *', 1), lambda y: {STRIP.format("y")}) ELSE [x] END)) AS s FROM s),
    w AS (SELECT doc_id, s, 1 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS cur, 0 AS size FROM n
        UNION ALL
        SELECT doc_id, s, i + 1, CASE WHEN over THEN list_append(done, array_to_string(cur, ' ')) ELSE done END,
            list_append(CASE WHEN NOT over THEN cur WHEN room THEN [cur[-1]] ELSE []::VARCHAR[] END, x), CASE WHEN NOT over THEN size WHEN room THEN length(cur[-1]) + 1 ELSE 0 END + length(x) + 1
        FROM (SELECT *, len(cur) > 0 AND size + length(x) + 1 > 900 AS over, length(cur[-1]) + 1 + length(x) + 1 <= 900 AS room FROM (SELECT *, s[i] AS x FROM w WHERE i <= len(s)))),
    e AS (SELECT doc_id, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, ' ')) ELSE done END AS c FROM w WHERE i = len(s) + 1)
    SELECT doc_id, len(c)::BIGINT AS n, md5(array_to_string(c, '|')) AS chunks_md5 FROM e""",
)
def f9(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", T.chunks(F.coalesce("text", F.lit("")), 900, 1).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


@query("f13_tokens", f"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tok(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS k FROM documents)")
def f13(spark, sf_dir):
    d = doc_tokens(spark, sf_dir)
    return d.select(F.col("chunk_idx").alias("doc_id"), F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("f14_stem")
def f14(spark, sf_dir):
    return stems(doc_tokens(spark, sf_dir).select(F.explode("tokens").alias("word")))


@query(
    "f18_tfidf",
    f"""WITH k AS (SELECT item_id AS c, {tok("text")} AS k FROM benchmark),
    g AS (SELECT c, g, count(*) AS tf FROM (SELECT c, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS g FROM k) GROUP BY c, g),
    f AS (SELECT g, count(*) AS df FROM g GROUP BY g HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM k),
    w AS (SELECT c, g, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM g JOIN f USING (g), n)
    SELECT c AS item_id, g AS gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY c)), 6) AS weight FROM w""",
)
def f18(spark, sf_dir):
    w, _ = dense.tfidf(questions(spark, sf_dir).withColumnRenamed("qid", "chunk_idx"), 2)
    return w.select(F.col("chunk_idx").alias("item_id"), "gram", F.round("w", 6).alias("weight"))


@query("f22_tickers", f"SELECT doc_id, array_to_string(list_reverse(list_distinct(list_reverse([]::VARCHAR[]))), ',') AS tickers FROM documents WHERE FALSE UNION ALL SELECT doc_id, coalesce(string_agg(t, ',' ORDER BY i), '') FROM (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(m) AS t, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, {MENTIONS.format('text')} AS m FROM documents)) GROUP BY doc_id, t) RIGHT JOIN (SELECT doc_id FROM documents) USING (doc_id) GROUP BY doc_id")
def f22(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(WORDS.tickers_in(F.col("text")), ",").alias("tickers"))


@query("f24_article_tickers", f"WITH {TAGGED} SELECT article_id, array_to_string(tickers, ',') AS tickers, headline_only FROM tagged")
def f24(spark, sf_dir):
    return corpus(spark, sf_dir).select("article_id", F.array_join("tickers", ",").alias("tickers"), "headline_only")


#: Citations for texts that have none: numbers in brackets at their end.
CITED = "coalesce(text, '') || ' [' || (doc_id % 7) || ', ' || (doc_id % 5) || '] and [' || (doc_id % 7) || '].'"


@query("f28_citations", f"SELECT doc_id, array_to_string(list_filter(n, lambda x: x BETWEEN 1 AND 4), ',') AS cited, array_to_string(list_filter(n, lambda x: x NOT BETWEEN 1 AND 4), ',') AS invalid FROM (SELECT doc_id, CASE WHEN doc_id % 7 = doc_id % 5 THEN [doc_id % 7] ELSE [doc_id % 7, doc_id % 5] END AS n FROM documents)")
def f28(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.checked_citations(F.expr(CITED), F.array(*map(F.lit, (1, 2, 3, 4)))).alias("c"))
    return d.select("doc_id", F.array_join(F.col("c.cited").cast("array<string>"), ",").alias("cited"), F.array_join(F.col("c.invalid").cast("array<string>"), ",").alias("invalid"))


UNCITED = r"regexp_replace({}, '[\s\p{{Z}}]*\[[0-9]+(\s*,\s*[0-9]+)*\]', '', 'g')"


@query("f29_strip_citations", f"SELECT doc_id, md5({STRIP.format(UNCITED.format(CITED))}) AS text_md5 FROM documents")
def f29(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_citations(F.expr(CITED))).alias("text_md5"))


@query("f30_escape", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS body_md5, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS attribute_md5 FROM pages")
def f30(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escaped(F.col("html"))).alias("body_md5"), F.md5(T.escaped(F.col("html"), True)).alias("attribute_md5"))


# ------------------------------------------------------------------ ingestion


@query("s5_validation", f"WITH {RECORDS} SELECT count_if(title <> '')::BIGINT AS raw_records, count_if(title = '')::BIGINT AS invalid_records FROM r")
def s5(spark, sf_dir):
    r = feeds.documents_as_records(table(spark, sf_dir, "documents"))
    return feeds.validation_counts(r.withColumn("is_valid", feeds.valid_record(F.col("title"), F.col("link"))))


@query("s1_feed_json", "SELECT upper(source) AS feed, doc_id AS record, coalesce(text, '') <> '' AS is_valid FROM documents WHERE FALSE UNION ALL SELECT upper(source), row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, length(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[\\s\\p{Z}]+', '', 'g')) > 0 FROM documents")
def s1(spark, sf_dir):
    """A JSON payload for each source, parsed again."""
    d = table(spark, sf_dir, "documents")
    rec = F.struct("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", 2)[0].alias("title"), F.concat(F.lit("https://x.example.com/"), "doc_id").alias("link"))
    lists = d.groupBy("source").agg(F.array_sort(F.collect_list(rec)).alias("l"))
    parsed = feeds.parse_feeds(lists.select(F.to_json(F.create_map("source", "l")).alias("value")))
    return parsed.select("feed", F.col("rec_pos").cast("long").alias("record"), "is_valid")


@query("a1_dedupe_link", f"WITH {MERGED} SELECT link, cand_seq, array_to_string(feeds, ',') AS feeds, records FROM m")
def a1(spark, sf_dir):
    return merged(spark, sf_dir).select(T.canonical_link(F.col("link")).alias("link"), "cand_seq", F.array_join("feeds", ",").alias("feeds"), "records")


@query(
    "a1_dedupe_full",
    f"""WITH RECURSIVE {RECORDS}, k AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, 'l' || link AS lk, 't' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ') AS tk FROM r),
    w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS cand, []::VARCHAR[] AS keys, []::BIGINT[] AS cands
        UNION ALL
        SELECT i, seq, cand, list_concat(keys, new), list_concat(cands, list_transform(new, lambda x: cand))
        FROM (SELECT k.i, k.seq, coalesce(cands[list_position(keys, lk)], cands[list_position(keys, tk)], k.seq) AS cand, keys, cands, list_filter([lk, tk], lambda x: NOT list_contains(keys, x)) AS new FROM w JOIN k ON k.i = w.i + 1)),
    c AS (SELECT r.*, cand FROM r JOIN w USING (seq)), f AS (SELECT cand, feed, min(seq) AS at_ FROM c GROUP BY cand, feed)
    SELECT cand AS cand_seq, link, feeds, records FROM (SELECT cand, link, row_number() OVER (PARTITION BY cand ORDER BY length(full_text) DESC, seq) AS i FROM c)
        JOIN (SELECT cand, string_agg(feed, ',' ORDER BY at_) AS feeds FROM f GROUP BY cand) USING (cand) JOIN (SELECT cand, count(*) AS records FROM c GROUP BY cand) USING (cand) WHERE i = 1""",
)
def a1_full(spark, sf_dir):
    return ingest.merged(feeds.documents_as_records(table(spark, sf_dir, "documents"))).select("cand_seq", T.canonical_link(F.col("link")).alias("link"), F.array_join("feeds", ",").alias("feeds"), "records")


@query("a4_rule_counts", f"WITH {CLEAN} SELECT 'recurring_line' AS rule, count(*) AS articles FROM a WHERE hit")
def a4(spark, sf_dir):
    return ingest.rule_counts(corpus(spark, sf_dir), RULES)


@query("a6_articles_per_ticker", f"WITH {TAGGED} SELECT ticker, count(*) AS articles FROM (SELECT unnest(tickers) AS ticker FROM tagged) GROUP BY ticker")
def a6(spark, sf_dir):
    return ingest.articles_per_ticker(corpus(spark, sf_dir))


@query("a7_corpus_tickers", f"WITH {TAGGED} SELECT string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM (SELECT unnest(tickers) AS ticker FROM tagged)")
def a7(spark, sf_dir):
    return ingest.corpus_tickers(corpus(spark, sf_dir)).select(F.array_join("tickers", ",").alias("tickers"))


@query("q1_ingest_report")
def q1(spark, sf_dir):
    a = stored(corpus(spark, sf_dir), "articles")
    return sinks.report_json(ingest.report(a, ingest.chunked(a)))


# ------------------------------------------------------------------ retrieval


@query("q2_bm25", f"WITH {BM25} SELECT qid, c AS doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5")
def q2(spark, sf_dir):
    r = lexical.search(questions(spark, sf_dir), doc_index(spark, sf_dir), 5)
    return r.select("qid", F.col("chunk_idx").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("q2_bm25_filtered", f"WITH {BM25}, {SRC0} SELECT qid, c AS doc_id, round(score, 6) AS score, rank FROM rf WHERE rank <= 5")
def q2_filtered(spark, sf_dir):
    r = lexical.search(questions(spark, sf_dir), doc_index(spark, sf_dir), 5, source_allowed(spark, sf_dir))
    return r.select("qid", F.col("chunk_idx").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


FUSED = f"{BM25}, {SRC0}, fu AS (SELECT qid, c, sum(1 / (60.0::DOUBLE + rank)) AS score FROM (SELECT qid, c, rank FROM rk WHERE rank <= 40 UNION ALL SELECT qid, c, rank FROM rf WHERE rank <= 40) GROUP BY qid, c), fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, c) AS rank FROM fu)"


def fused_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, i = questions(spark, sf_dir), doc_index(spark, sf_dir)
    return fused([(lexical.search(q, i, 40), 1.0), (lexical.search(q, i, 40, source_allowed(spark, sf_dir)), 1.0)])


@query("a13_rrf", f"WITH {FUSED} SELECT qid, c AS doc_id, round(score, 9) AS score FROM fu")
def a13(spark, sf_dir):
    return fused_docs(spark, sf_dir).select("qid", F.col("chunk_idx").alias("doc_id"), F.round("score", 9).alias("score"))


SELECTED = f"{FUSED}, se AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM (SELECT fr.*, source, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS i FROM fr JOIN d USING (c)) WHERE i <= 2)"


@query("w2_cap", f"WITH {SELECTED} SELECT qid, pos, c AS doc_id FROM se WHERE pos <= 8")
def w2(spark, sf_dir):
    s = selected(lexical.ranked(fused_docs(spark, sf_dir)), doc_source(spark, sf_dir), 8, 2)
    return s.select("qid", F.col("pos").cast("long").alias("pos"), F.col("chunk_idx").alias("doc_id"))


@query(
    "w3_interleave",
    f"""WITH {BM25}, {SRC0}, li AS (SELECT qid, 0 AS ord, rank AS pos, c FROM rk WHERE rank <= 8 UNION ALL SELECT qid, 1, rank, c FROM rf WHERE rank <= 8),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid, c ORDER BY pos, ord) AS i FROM li), n AS (SELECT qid, c, row_number() OVER (PARTITION BY qid ORDER BY pos, ord) AS pos FROM o WHERE i = 1)
    SELECT qid, pos, c AS doc_id FROM n WHERE pos <= 12""",
)
def w3(spark, sf_dir):
    q, i = questions(spark, sf_dir), doc_index(spark, sf_dir)
    part = lambda r, n: r.select("qid", F.lit(n).alias("ord"), F.col("rank").alias("pos"), "chunk_idx")
    lists = part(lexical.search(q, i, 8), 0).unionByName(part(lexical.search(q, i, 8, source_allowed(spark, sf_dir)), 1))
    return interleaved(lists).select("qid", F.col("pos").cast("long").alias("pos"), F.col("chunk_idx").alias("doc_id"))


@query("j5_widen", f"WITH {BM25}, {SRC0}, u AS (SELECT qid, c, 0 AS phase, rank FROM rf WHERE rank <= 3 UNION ALL SELECT qid, c, 1, rank FROM rk WHERE rank <= 10 AND (qid, c) NOT IN (SELECT (qid, c) FROM rf WHERE rank <= 3)) SELECT qid, c AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY phase, rank) AS rank FROM u")
def j5(spark, sf_dir):
    q, i = questions(spark, sf_dir), doc_index(spark, sf_dir)
    w = widened(lexical.search(q, i, 3, source_allowed(spark, sf_dir)), lexical.search(q, i, 10))
    return w.select("qid", F.col("chunk_idx").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


COVERED = f"{BM25}, co AS (SELECT qid, sum(CASE WHEN df IS NULL THEN 0 ELSE ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END) / sum(ln(1 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE))) AS coverage FROM q LEFT JOIN t USING (term), s GROUP BY qid)"


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = questions(spark, sf_dir).select("qid", F.posexplode("tokens").alias("pos", "stem"))
    return lexical.coverage(t.withColumn("surface", F.col("stem")), doc_index(spark, sf_dir))


@query("a14_coverage", f"WITH {COVERED} SELECT qid, round(coverage, 6) AS coverage FROM co")
def a14(spark, sf_dir):
    return covered(spark, sf_dir).select("qid", F.round("coverage", 6).alias("coverage"))


@query(
    "a15_uncovered",
    f"""WITH {BM25}, w AS (SELECT item_id AS qid, unnest(k) AS term, generate_subscripts(k, 1) - 1 AS pos FROM (SELECT item_id, list_concat({tok("text")}, ['zzq' || item_id % 5, 'zzr', 'zzq' || item_id % 5]) AS k FROM benchmark)),
    m AS (SELECT qid, term, min(pos) AS a, max(pos) AS z FROM w WHERE term NOT IN (SELECT term FROM t) GROUP BY qid, term)
    SELECT item_id AS qid, coalesce(string_agg(term || z, ',' ORDER BY a), '') AS uncovered FROM benchmark LEFT JOIN m ON qid = item_id GROUP BY item_id""",
)
def a15(spark, sf_dir):
    """Words that no document has, put behind each question; a surface form tells its position."""
    tail = F.concat(F.lit("zzq"), (F.col("qid") % 5).cast("string"))
    t = questions(spark, sf_dir).select("qid", F.posexplode(F.concat("tokens", F.array(tail, F.lit("zzr"), tail))).alias("pos", "stem"))
    c = lexical.coverage(t.withColumn("surface", F.concat("stem", F.col("pos").cast("string"))), doc_index(spark, sf_dir))
    return c.select("qid", F.array_join("uncovered", ",").alias("uncovered"))


@query("p7_gate", f"WITH {COVERED} SELECT item_id AS qid, round(coalesce(coverage, 0), 6) AS coverage, coalesce(coverage, 0) >= CASE WHEN item_id % 2 = 0 THEN 0.2 ELSE 0.6 END AND item_id IN (SELECT qid FROM rk) AS sufficient FROM benchmark LEFT JOIN co ON qid = item_id")
def p7(spark, sf_dir):
    q = questions(spark, sf_dir)
    plans = q.select("qid", F.when(F.col("qid") % 2 == 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("tickers"))
    v = gate(lexical.search(q, doc_index(spark, sf_dir), 8), plans, covered(spark, sf_dir))
    return v.select("qid", F.round("coverage", 6).alias("coverage"), "sufficient")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), F.col("embedding").cast("array<double>").alias("vec"), "label")


DOTS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), x AS (SELECT a.vec_id AS qid, b.vec_id AS c, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS score, a.label AS la, b.label AS lb FROM e a, e b WHERE a.vec_id % 50 = 0)"


@query("q3_dense_embeddings", f"WITH {DOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, c) AS rank FROM x) SELECT qid, c AS vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10 AND score > 0")
def q3(spark, sf_dir):
    v = unit_vectors(spark, sf_dir)
    r = dense.search(v.filter("chunk_idx % 50 = 0").select(F.col("chunk_idx").alias("qid"), "vec"), v, 10)
    return r.select("qid", F.col("chunk_idx").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("q3_dense_filtered", f"WITH {DOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, c) AS rank FROM x WHERE la = lb) SELECT qid, c AS vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10 AND score > 0")
def q3_filtered(spark, sf_dir):
    v = unit_vectors(spark, sf_dir)
    q = v.filter("chunk_idx % 50 = 0")
    allowed = q.select(F.col("chunk_idx").alias("qid"), "label").join(v.select("chunk_idx", "label"), "label").select("qid", "chunk_idx")
    r = dense.search(q.select(F.col("chunk_idx").alias("qid"), "vec"), v, 10, allowed)
    return r.select("qid", F.col("chunk_idx").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("q3_lsa")
def q3_lsa(spark, sf_dir):
    d = stored(doc_tokens(spark, sf_dir), "tokens")
    e = dense.LsaEmbedder(64).fit(d)
    r = dense.search(e.embed(questions(spark, sf_dir), "qid"), e.embed(d), 10)
    return r.select("qid", F.col("chunk_idx").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


TICKER = "'src' || ({}) % 20"
PICKED = "SELECT qid, c, art, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, art ORDER BY rank) AS i FROM {}) WHERE i <= 2"


@query(
    "q4_routed",
    f"""WITH {BM25}, da AS (SELECT c, source, source || '-' || (c % 5) AS art FROM d), ev AS (SELECT rk.*, art FROM rk JOIN da USING (c) WHERE rank <= 40),
    tk AS (SELECT item_id AS qid, 0 AS ord, {TICKER.format("item_id")} AS source FROM benchmark WHERE item_id % 3 > 0 UNION ALL SELECT item_id, 1, {TICKER.format("item_id + 7")} FROM benchmark WHERE item_id % 3 = 2 UNION ALL SELECT item_id, 2, {TICKER.format("item_id + 11")} FROM benchmark WHERE item_id % 3 = 2),
    nr AS (SELECT * FROM (SELECT qid, ord, c, art, row_number() OVER (PARTITION BY qid, ord ORDER BY round(score, 12) DESC, c) AS rank FROM b JOIN da USING (c) JOIN tk USING (qid, source)) WHERE rank <= 40),
    mk AS ({PICKED.format("ev")}), fi AS (SELECT * FROM ({PICKED.format("(SELECT * FROM nr WHERE qid % 3 = 1)")}) WHERE pos <= 8), en AS (SELECT qid FROM fi GROUP BY qid HAVING count(DISTINCT art) >= 2),
    wd AS (SELECT qid, c, art, row_number() OVER (PARTITION BY qid ORDER BY phase, rank) AS rank FROM (SELECT qid, c, art, rank, 0 AS phase FROM nr WHERE qid % 3 = 1 UNION ALL SELECT qid, c, art, rank, 1 FROM ev WHERE qid % 3 = 1 AND (qid, c) NOT IN (SELECT (qid, c) FROM nr))),
    pw AS ({PICKED.format("wd")}), pc AS (SELECT qid, ord, c, art, row_number() OVER (PARTITION BY qid, ord ORDER BY rank) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, ord, art ORDER BY rank) AS i FROM nr WHERE qid % 3 = 2) WHERE i <= 2),
    bl AS (SELECT qid, c, art, row_number() OVER (PARTITION BY qid ORDER BY pos, ord) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, c ORDER BY pos, ord) AS k FROM pc WHERE pos <= 4) WHERE k = 1)
    SELECT qid, pos, c AS doc_id, art AS article_id FROM mk WHERE qid % 3 = 0 AND pos <= 8 UNION ALL SELECT qid, pos, c, art FROM fi WHERE qid IN (FROM en) UNION ALL SELECT qid, pos, c, art FROM pw WHERE pos <= 8 AND qid NOT IN (FROM en) UNION ALL SELECT qid, pos, c, art FROM bl WHERE pos <= 12""",
)
def q4_routed(spark, sf_dir):
    """The retriever's three routes by lexical search: a third of the questions for the market, for one company, and for three; each document is a chunk,
    five articles a source, sources stand for companies."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), F.concat_ws("-", "source", (F.col("doc_id") % 5).cast("string")).alias("article_id"), F.coalesce("text", F.lit("")).alias("index_text"), "source")
    arts = d.select("article_id", F.array("source").alias("tickers")).distinct()
    of = lambda n: F.concat(F.lit("src"), ((F.col("item_id") + n) % 20).cast("string"))
    kind = F.col("item_id") % 3
    none = F.array().cast("array<string>")
    plans = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("standalone_query"), F.when(kind == 0, "market").when(kind == 1, "company").otherwise("comparison").alias("intent"),
        F.when(kind == 0, none).when(kind == 1, F.array(of(0))).otherwise(F.array(of(0), of(7), of(11))).alias("tickers"),
    )
    passages, _ = Retriever(arts, d, RetrievalConfig(semantic_weight=0.0), stemmed=False).retrieve(plans)
    return passages.select("qid", F.col("pos").cast("long").alias("pos"), F.col("chunk_idx").alias("doc_id"), "article_id")


@query(
    "q4_hybrid",
    f"""WITH {BM25}, ve AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), dx AS (SELECT a.vec_id AS qid, b.vec_id AS c, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS score FROM ve a JOIN benchmark ON item_id = a.vec_id, ve b),
    dr AS (SELECT qid, c, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, c) AS rank FROM dx WHERE round(score, 12) > 0), un AS (SELECT qid, c, 1 / (60.0::DOUBLE + rank) AS part FROM rk WHERE rank <= 40 UNION ALL SELECT qid, c, 0.5::DOUBLE / (60.0::DOUBLE + rank) FROM dr WHERE rank <= 40)
    SELECT qid, c AS doc_id, round(sum(part), 9) AS score FROM un GROUP BY qid, c""",
)
def q4_hybrid(spark, sf_dir):
    """Lexical ranking fused with that of given vectors at half its weight; a question's vector is the one of its number."""
    v = unit_vectors(spark, sf_dir).drop("label")
    q = questions(spark, sf_dir)
    near = dense.search(v.join(q.select(F.col("qid").alias("chunk_idx")), "chunk_idx", "left_semi").withColumnRenamed("chunk_idx", "qid"), v, 40)
    return fused([(lexical.search(q, doc_index(spark, sf_dir), 40), 1.0), (near, 0.5)]).select("qid", F.col("chunk_idx").alias("doc_id"), F.round("score", 9).alias("score"))


# ------------------------------------------------------------------ questions and history


@query("p12_requests", "SELECT conv_id, turn, CASE WHEN text IS NULL OR length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) = 0 THEN 'message is blank' WHEN length(text) > 2000 THEN 'message is too long' WHEN role NOT IN ('user', 'assistant') THEN 'unknown role' END AS rejected FROM conversations")
def p12(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    h = F.array(F.struct("role", F.lit("x").alias("content")))
    return analysis.checked_requests(c.select("conv_id", "turn", F.col("text").alias("message"), h.alias("history"))).select("conv_id", "turn", "rejected")


FOUND = f"""{CONVERSATIONS}, o AS (SELECT *, list_distinct({MENTIONS.format("message")}) AS own, list_reverse(list_filter(history, lambda t: t.role = 'user')) AS prior FROM cv)"""


@query(
    "q9_analysis",
    rf"""WITH {FOUND}, f AS (SELECT *, len(prior) > 0 AND (regexp_matches(message, '(?i)^\s*(?:(?:and|so|ok|okay|now|then|also)[\s,]+)*(?:(?:what|how)\s+about|same\s+for|and\s+for|and|also)(?:[^\p{{L}}\p{{N}}\p{{M}}_]|$)')
        OR (len(own) = 0 AND regexp_matches(message, '(?i)(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])(?:it|its|it''s|they|their|them|this|that|those|these|he|his|she|her|the\s+(?:company|stock|firm|shares))(?:[^\p{{L}}\p{{N}}\p{{M}}_]|$)'))) AS is_follow_up FROM o),
    g AS (SELECT *, list_filter(list_transform(prior, lambda t: list_distinct({MENTIONS.format("t.content")})), lambda m: len(m) > 0)[1] AS inherited FROM f),
    h AS (SELECT *, CASE WHEN is_follow_up AND len(own) = 0 THEN coalesce(inherited, []) ELSE own END AS tickers FROM g)
    SELECT qid, is_follow_up, array_to_string(list_sort(tickers), ',') AS tickers, CASE WHEN len(tickers) >= 2 THEN 'comparison' WHEN len(tickers) = 1 THEN 'company' ELSE 'market' END AS intent FROM h""",
)
def q9(spark, sf_dir):
    p = analysis.analyzed(conversations(spark, sf_dir), WORDS, stemmed=False)
    return p.select("qid", "is_follow_up", F.array_join(F.array_sort("tickers"), ",").alias("tickers"), "intent")


@query("f25_standalone_query")
def f25(spark, sf_dir):
    return analysis.analyzed(conversations(spark, sf_dir), WORDS).select("qid", "standalone_query")


@query(
    "w7_history",
    rf"""WITH {CONVERSATIONS}, h AS (SELECT qid, unnest(list_slice(history, greatest(len(history) - 7, 1), len(history))) AS t, generate_subscripts(list_slice(history, greatest(len(history) - 7, 1), len(history)), 1) AS i FROM cv),
    s AS (SELECT qid, i, t.role AS role, CASE WHEN t.role = 'assistant' THEN {STRIP.format(UNCITED.format("t.content"))} ELSE t.content END AS content FROM h),
    b AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY qid ORDER BY i) THEN 0 ELSE 1 END AS new FROM s WHERE {STRIP.format("content")} <> ''),
    g AS (SELECT *, sum(new) OVER (PARTITION BY qid ORDER BY i) AS island FROM b), m AS (SELECT qid, island, any_value(role) AS role, string_agg(content, chr(10) ORDER BY i) AS content FROM g GROUP BY qid, island),
    n AS (SELECT *, min(island) OVER (PARTITION BY qid) AS a, max(island) OVER (PARTITION BY qid) AS z FROM m), k AS (SELECT * FROM n WHERE NOT (island = a AND role <> 'user') AND NOT (island = z AND role = 'user'))
    SELECT cv.qid, coalesce(string_agg(role || ':' || content, '|' ORDER BY island), '') AS history FROM cv LEFT JOIN k USING (qid) GROUP BY cv.qid""",
)
def w7(spark, sf_dir):
    c = conversations(spark, sf_dir).select("qid", answer.normalized_history(F.col("history"), 8).alias("h"))
    return c.select("qid", F.array_join(F.transform("h", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|").alias("history"))


# ------------------------------------------------------------------ answers

ARTICLE = "'d' || c AS article_id"


def source_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources for the questions: each document's whole text is a chunk, and the documents of one source make an article."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "source")
    chunks = d.select(F.col("doc_id").alias("chunk_idx"), F.col("source").alias("article_id"), F.col("t").alias("text"))
    arts = d.select(F.col("source").alias("article_id")).distinct().select("article_id", F.concat(F.lit("Title <"), "article_id", F.lit(">")).alias("title"), F.concat(F.lit("https://x.example.com/"), "article_id").alias("link"), F.array(F.upper("article_id")).alias("tickers"), (F.col("article_id") == "src3").alias("headline_only"))
    q = questions(spark, sf_dir)
    passages = stored(lexical.search(q, doc_index(spark, sf_dir), 6).select("qid", F.col("rank").alias("pos"), "chunk_idx"), "passages")
    return answer.sources(passages, chunks, arts), q


SOURCES = f"""{BM25}, pa AS (SELECT qid, rank, c, d.source, coalesce(text, '') AS text FROM rk JOIN d USING (c) JOIN documents ON doc_id = c WHERE rank <= 6),
    so AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS number, string_agg(text, ' ' ORDER BY rank) AS text FROM pa GROUP BY qid, source)"""


@query("a17_sources", f"WITH {SOURCES} SELECT qid, number, source AS article_id, md5(text) AS text_md5 FROM so")
def a17(spark, sf_dir):
    s, _ = source_rows(spark, sf_dir)
    return s.select("qid", F.col("number").cast("long").alias("number"), "article_id", F.md5("text").alias("text_md5"))


@query(
    "f31_context",
    f"""WITH {SOURCES}, bl AS (SELECT qid, number, '<source id="' || number || '" title="Title &lt;' || source || '&gt;" tickers="' || upper(source) || '" headline_only="' || CASE WHEN source = 'src3' THEN 'true' ELSE 'false' END || '">' || chr(10)
        || replace(replace(replace(substr(text, 1, 2400), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</source>' AS b FROM so)
    SELECT qid, md5('<sources>' || chr(10) || string_agg(b, chr(10) ORDER BY number) || chr(10) || '</sources>') AS context_md5 FROM bl GROUP BY qid""",
)
def f31(spark, sf_dir):
    s, _ = source_rows(spark, sf_dir)
    c = answer.rendered_context(s, s.select("qid").distinct().withColumn("uncovered", F.array().cast("array<string>")))
    return c.select("qid", F.md5("context").alias("context_md5"))


#: The lines that an extractive answer quotes from each source; the titles where no source has any.
LINES = rf"""{SOURCES}, st AS (SELECT qid, number, source, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT qid, number, source, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]["”’)]?)[\s\p{{Z}}]+([A-Z0-9"“‘(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS s FROM so WHERE source <> 'src3')),
    qt AS (SELECT qid, list(term) AS q FROM q GROUP BY qid), ov AS (SELECT st.*, len(list_intersect(list_distinct({tok("s")}), q)) AS n, q FROM st JOIN qt USING (qid) WHERE length(s) >= 40),
    be AS (SELECT *, row_number() OVER (PARTITION BY qid, number ORDER BY n DESC, i) AS k FROM ov WHERE n >= greatest(least(2, len(q)), 1)),
    li AS (SELECT qid, number, i, trim(regexp_replace(s, '[\s\p{{Z}}]+', ' ', 'g'), ' ') AS s, '' AS tag FROM be WHERE k <= 2 UNION ALL SELECT qid, number, 0, 'Title <src3>', ' (headline only)' FROM so WHERE source = 'src3'),
    al AS (SELECT * FROM li UNION ALL SELECT qid, number, 0, 'Title <' || source || '>', CASE WHEN source = 'src3' THEN ' (headline only)' ELSE '' END FROM so WHERE qid NOT IN (SELECT qid FROM li))"""


@query(
    "q10_extractive",
    rf"""WITH {LINES}
    SELECT qid, md5({STRIP.format(f"'{answer.INTRO.strip()}' || chr(10) || chr(10) || string_agg('- ' || s || ' [' || number || ']' || tag || chr(10), '' ORDER BY number, i)")}) AS answer_md5 FROM al GROUP BY qid""",
)
def q10(spark, sf_dir):
    s, q = source_rows(spark, sf_dir)
    plans = q.select("qid", F.lit("market").alias("intent"), F.array().cast("array<string>").alias("tickers"))
    return answer.extractive_answers(stored(s, "sources"), plans, q, stemmed=False).select("qid", F.md5("answer").alias("answer_md5"))


@query(
    "q10_comparison",
    rf"""WITH {LINES}, bu AS (SELECT qid, number, source, string_agg('- ' || s || ' [' || number || ']' || tag || chr(10), '' ORDER BY i) AS b FROM al JOIN so USING (qid, number) GROUP BY qid, number, source),
    ak AS (SELECT qid, unnest([0, 7, 11]) AS o FROM (SELECT DISTINCT qid FROM so)), pt AS (SELECT ak.qid, o, coalesce(string_agg(b, '' ORDER BY number), '- No articles about this company were found.' || chr(10)) AS b FROM ak LEFT JOIN bu ON bu.qid = ak.qid AND source = 'src' || ((ak.qid + o) % 20) GROUP BY ak.qid, o)
    SELECT qid, md5({STRIP.format(f"'{answer.INTRO.strip()}' || chr(10) || string_agg(chr(10) || 'SRC' || ((qid + o) % 20) || ':' || chr(10) || b, '' ORDER BY o)")}) AS answer_md5 FROM pt GROUP BY qid""",
)
def q10_comparison(spark, sf_dir):
    """The same questions as comparisons of three companies, some of which no source is about."""
    s, q = source_rows(spark, sf_dir)
    of = F.array(*(F.concat(F.lit("SRC"), ((F.col("qid") + n) % 20).cast("string")) for n in (0, 7, 11)))
    s = stored(s, "sources")
    plans = q.join(s.select("qid").distinct(), "qid", "left_semi").select("qid", F.lit("comparison").alias("intent"), of.alias("tickers"))
    return answer.extractive_answers(s, plans, q, stemmed=False).select("qid", F.md5("answer").alias("answer_md5"))


class Echo:
    """A model that cites the first source and one that doesn't exist."""

    name = "echo"

    def stream(self, system: str, messages: list[tuple[str, str]], max_tokens: int) -> Iterator[str]:
        yield f"{len(messages)} messages"
        yield " [1] [99]"


def chat(spark: SparkSession, sf_dir: str, **more) -> Chat:
    a = stored(corpus(spark, sf_dir), "articles")
    c = stored(ingest.chunked(a), "chunks")
    return Chat(Retriever(a, c, RetrievalConfig(), dense.LsaEmbedder(32)), WORDS, **more)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("message"), F.array().cast(HISTORY).alias("history"))


@query("q12_chat")
def q12(spark, sf_dir):
    r, _ = chat(spark, sf_dir).respond(asked(spark, sf_dir))
    return r.select("qid", "answered", F.round("coverage", 6).alias("coverage"), F.col("plan.intent").alias("intent"), F.size("sources").alias("sources"), F.size("citations").alias("citations"), F.md5("answer").alias("answer_md5"))


@query("q11_model_answers")
def q11(spark, sf_dir):
    r, e = chat(spark, sf_dir, make_client=Echo, answerer="echo").respond(asked(spark, sf_dir))
    return sinks.events(r, e).select("qid", "seq", "event", sinks.sse(F.col("event"), F.col("data")).alias("frame"))


@query("s9_response_json")
def s9(spark, sf_dir):
    r, _ = chat(spark, sf_dir).respond(asked(spark, sf_dir))
    return sinks.response_json(r)


@query("q15_health", f"WITH {TAGGED} SELECT 'ok' AS status, 'extractive' AS answerer, count(*) AS articles FROM tagged")
def q15(spark, sf_dir):
    a = corpus(spark, sf_dir)
    return health(a, a.limit(0), "extractive").drop("chunks")


# ------------------------------------------------------------------ evaluation

CASES = """rel AS (SELECT item_id AS qid, doc_id AS c FROM benchmark b JOIN documents d ON contains(d.text, b.text)), me AS (SELECT rel.qid, count_if(rank <= 5) > 0 AS hit, count_if(rank <= 5) / count(*) AS recall, coalesce(1 / min(rank), 0) AS rr FROM rel LEFT JOIN (SELECT * FROM rk WHERE rank <= 8) k ON k.qid = rel.qid AND k.c = rel.c GROUP BY rel.qid)"""


def holders(spark: SparkSession, sf_dir: str, texts: DataFrame, i: lexical.Postings) -> DataFrame:
    """(qid, chunk_idx) of the texts (chunk_idx, text), with index i, that contain a benchmark item. They share its rarest token, so candidates come from a
    join by token before texts are compared."""
    inner = F.when(F.size("tokens") > 2, F.slice("tokens", F.lit(2), F.size("tokens") - 2)).otherwise(F.col("tokens"))  # the outer ones may be parts of words
    rarest = questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(inner)).alias("term")).join(i.term_stats, "term")
    first = rarest.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("df", "term"))).filter("n = 1").select("qid", "term")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    return first.join(i.postings, "term").select("qid", "chunk_idx").join(texts, "chunk_idx").join(items, "qid").filter(F.contains("text", "item")).select("qid", "chunk_idx")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit, recall and rr of each benchmark item that documents contain, its document ranking by BM25 taken as the articles'."""
    i = doc_index(spark, sf_dir)
    q = questions(spark, sf_dir)
    rank = lexical.search(q, i, 8).select("qid", F.col("chunk_idx").alias("article_id"), F.col("rank").alias("place"))
    both = holders(spark, sf_dir, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), "text"), i)
    return evaluate.measures(rank, both.select("qid", F.col("chunk_idx").alias("article_id")))


@query("q13_eval_cases", f"WITH {BM25}, {CASES} SELECT qid, hit::DOUBLE AS hit, round(recall, 6) AS recall, round(rr, 6) AS rr FROM me")
def q13(spark, sf_dir):
    return cases(spark, sf_dir).select("qid", "hit", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


@query("a22_by_category", f"WITH {BM25}, {CASES} SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(*) AS n, round(avg(hit::DOUBLE), 6) AS hit, round(avg(rr), 6) AS mrr FROM benchmark LEFT JOIN me ON qid = item_id GROUP BY category")
def a22(spark, sf_dir):
    r = questions(spark, sf_dir).select("qid").join(cases(spark, sf_dir), "qid", "left").withColumn("category", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))
    return evaluate.by_category(r).select("category", "n", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"))


@query("a20_summary", f"WITH {BM25}, {CASES} SELECT count(*) AS n, round(avg(hit::DOUBLE), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM benchmark LEFT JOIN me ON qid = item_id")
def a20(spark, sf_dir):
    r = questions(spark, sf_dir).select("qid").join(cases(spark, sf_dir), "qid", "left").withColumn("ticker_coverage", F.lit(None).cast("double")).withColumn("gate_correct", F.lit(True))
    return evaluate.summary(r).select("n", *(F.round(c, 6).alias(c) for c in ("hit", "recall", "mrr")))


@query("a21_gate", f"WITH {COVERED}, g AS (SELECT item_id, coalesce(coverage, 0) >= 0.6 AND item_id IN (SELECT qid FROM rk) AS ok, CASE WHEN item_id % 4 = 0 THEN NULL ELSE (item_id % 8) / 8.0::DOUBLE END AS tc FROM benchmark LEFT JOIN co ON qid = item_id) SELECT count(*) AS n, round(avg(tc), 6) AS ticker_coverage, round(avg((ok = (item_id % 3 > 0))::INT::DOUBLE), 6) AS gate FROM g")
def a21(spark, sf_dir):
    """How often the gate agrees with what was expected, and the mean of ticker coverage over the cases that have one."""
    q = questions(spark, sf_dir)
    v = gate(lexical.search(q, doc_index(spark, sf_dir), 8), q.select("qid", F.array().cast("array<string>").alias("tickers")), covered(spark, sf_dir))
    none = F.lit(None).cast("double")
    r = v.select(none.alias("hit"), none.alias("recall"), none.alias("rr"), F.when(F.col("qid") % 4 > 0, (F.col("qid") % 8) / 8.0).alias("ticker_coverage"), (F.col("sufficient") == (F.col("qid") % 3 > 0)).alias("gate_correct"))
    return evaluate.summary(r).select("n", F.round("ticker_coverage", 6).alias("ticker_coverage"), F.round("gate", 6).alias("gate"))


@query("q14_ablation")
def q14(spark, sf_dir):
    a = stored(corpus(spark, sf_dir), "articles")
    c = stored(ingest.chunked(a), "chunks")
    texts = a.select(F.col("cand_seq").alias("chunk_idx"), "text")
    found = holders(spark, sf_dir, texts, lexical.build(stored(texts.select("chunk_idx", T.tokens("text").alias("tokens")), "tokens")))
    held = found.join(a.select(F.col("cand_seq").alias("chunk_idx"), "article_id"), "chunk_idx").select(F.col("qid").cast("string").alias("case_id"), "article_id")
    relevant = stored(held.distinct(), "relevant")
    golden = asked(spark, sf_dir).select(F.col("qid").cast("string").alias("case_id"), F.lit("all").alias("category"), F.col("message").alias("question"), "history", F.array().cast("array<string>").alias("relevant_titles"), WORDS.tickers_in(F.col("message")).alias("must_cover_tickers"), F.lit(True).alias("expect_answered"))
    return evaluate.ablation(golden, a, c, registry=WORDS, relevant=relevant)


@query("r1_stream")
def r1(spark, sf_dir):
    """The questions as a stream: the events that the streaming query appends."""
    from corvane.sources.workspace import shared_dir
    from corvane.streaming.chat import answer_stream

    out = f"{shared_dir(spark)}/corvane/stream-{uuid.uuid4().hex}"
    source = stored(asked(spark, sf_dir), "questions")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    answer_stream(stream, chat(spark, sf_dir), f"{out}/events", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/events").select("qid", "seq", "event", "data")


