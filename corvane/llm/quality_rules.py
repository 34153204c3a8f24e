"""Quality rules for documents, judged together with the host that they come from; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, free_name, lookup, only, row_key, scratched, sha256
from corvane.sources.workspace import stored

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat: the base rule. The others count against a document and its host: symbols per word character, repeated
    share of lines, mean word length. A host whose shrunken failure rate reaches blocked loses all its documents."""

    min_words: int = 50
    max_repeat: int = 50
    max_symbols: float = 0.05
    max_dup_lines: float = 0.30
    min_mean_word: float = 2.0
    max_mean_word: float = 20.0
    blocked: float = 0.90


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is then computed once a row; a plain nested expression might run once an element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str) -> str:
    """SQL: how many words of the array lie in a 3-word window that occurs twice or more.

    Windows are compared by a 64-bit hash inside one document only (for 20,000 words a false match has a chance of about 1e-11).
    Sorted hashes put equal windows side by side; sorted positions give the union of the windows' words.
    """
    null = "array(CAST(NULL AS STRUCT<h: BIGINT, i: INT>))"
    triples = f"slice(arrays_zip({words}, slice({words}, 2, size({words})), slice({words}, 3, size({words}))), 1, greatest(size({words}) - 2, 0))"
    hashed = f"array_sort(transform({triples}, (x, i) -> struct(xxhash64(x.{words}, x.`1`, x.`2`) AS h, i AS i)))"
    beside = f"arrays_zip(s, concat({null}, slice(s, 1, greatest(size(s) - 1, 0))), concat(slice(s, 2, size(s)), {null}))"
    twice = _let(hashed, "s", f"transform(filter({beside}, t -> t.s.h = t.`1`.h OR t.s.h = t.`2`.h), t -> t.s.i)")
    gaps = "zip_with(slice(p, 2, size(p)), slice(p, 1, greatest(size(p) - 1, 0)), (b, a) -> least(3, b - a))"
    return _let(f"array_sort({twice})", "p", f"IF(size(p) = 0, 0L, aggregate({gaps}, 3L, (n, g) -> n + g))")


def measured(docs: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """doc_id, host, the counts of each document of docs (doc_id, text, host column), base_failed and failed (any rule is broken)."""
    d = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    spaced, blank = "translate(t, '\\t\\n\\u000B\\u000C\\r', '     ')", "translate(l, ' \\t\\u000B\\u000C\\r', '')"
    words = _let(f"array_remove(split({spaced}, ' +'), '')", "w", f"struct(CAST(size(w) AS BIGINT) AS n, {repeat_words('w')} AS r)")
    lines = _let(f"filter(split(t, '\\n'), l -> length({blank}) > 0)", "x", "struct(CAST(size(x) AS BIGINT) AS n, CAST(size(x) - size(array_distinct(x)) AS BIGINT) AS d)")
    d = d.select(
        "doc_id", "host", F.expr(words).alias("w"), F.expr(lines).alias("l"),
        F.char_length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"))
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    soft = (
        (F.col("n_symbols") > rules.max_symbols * F.col("word_chars"))
        | (F.col("n_dup_lines") > rules.max_dup_lines * F.col("n_lines"))
        | ((F.col("n_words") > 0) & ((mean < rules.min_mean_word) | (mean > rules.max_mean_word)))
    )
    return d.withColumn("base_failed", base).withColumn("broken", soft).withColumn("failed", base | soft)


def host_rates(stats: DataFrame) -> DataFrame:
    """(host_key, n, rate): each host's failure rate, shrunk towards the mean of all hosts.

    The beta prior is fitted to the hosts by moments: with mean m and variance v of the raw rates, less the binomial noise in v,
    its strength is m (1 - m) / v - 1. A host of few documents so stays near m, a large one near its own rate. Where the hosts
    don't differ beyond noise, the strength is 1000.
    """
    hosts = stats.groupBy("host_key").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("int")).alias("f")).withColumn("raw", F.col("f") / F.col("n"))
    prior = hosts.agg((F.sum("f") / F.sum("n")).alias("m"), F.coalesce(F.var_samp("raw"), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("noise"))
    spread = F.col("m") * (1 - F.col("m"))
    excess = F.col("v") - spread * F.col("noise")
    strength = F.when(excess > spread / 1001, spread / excess - 1).otherwise(F.lit(1000.0))
    prior = prior.select("m", F.greatest(strength, F.lit(0.01)).alias("strength"))  # one row
    return hosts.join(F.broadcast(prior)).select("host_key", "n", ((F.col("f") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"))


@scratched
def quality_verdicts(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per document of docs (doc_id, text, host column): the counts, base_failed, host_rate, host_blocked, kept.

    A document is kept if it breaks no rule of its own and its host isn't blocked: hosts whose shrunken failure rate reaches
    rules.blocked lose all their documents. Null and empty texts have no words and fail the base rule; documents without a host
    form one host of their own. Repeated rows are judged alike. Host counts are aggregated on the map side first, and the
    hosts' verdicts come back by lookup(), so a host with a third of all rows stays cheap. Other columns are ignored.
    """
    stats = measured(docs, host, rules).withColumn("host_key", F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("-")))
    stats = stored(stats, "stats")
    hosts = stored(host_rates(stats), "hosts")
    d = lookup(stats, hosts, "host_key", "n")
    blocked = F.coalesce(F.col("rate") >= rules.blocked, F.lit(False))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rate").alias("host_rate"), blocked.alias("host_blocked"), (~F.col("failed") & ~blocked).alias("kept"),
    )


def drop_bad_documents(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """docs without the rows that quality_verdicts() rejects, null and repeated ids or not; all columns stay."""
    hosts = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))
    name = free_name(docs, "row_key")
    rows = docs.withColumn(name, row_key(F.concat(sha256(), hosts)))
    seen = rows.select(F.col(name).alias("doc_id"), "text", F.col(host).alias("host"))
    gone = stored(quality_verdicts(seen, "host", rules).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "rejected")
    return only(rows, gone, name, "left_anti").drop(name)
