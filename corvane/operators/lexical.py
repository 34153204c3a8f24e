"""BM25 over an inverted index held in tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.workspace import stored

K1, B = 1.5, 0.75


#: Postings of a term that go to one task at most; a term with more is dealt over several.
SPLIT = 1_000_000
#: Terms of questions that go to every task at most, so that postings aren't shuffled.
FEW = 200_000


@dataclass
class Postings:
    """Stored tables: postings (term, part, chunk_idx, tf, dl), terms (term, df) and one row of stats (n, avgdl). The postings of a term that has many are dealt over
    parts by chunk_idx; parts() says over how many."""

    postings: DataFrame
    term_stats: DataFrame
    stats: DataFrame


def parts(df: Column) -> Column:
    return F.ceil(df / F.lit(SPLIT)).cast("int")


def build(chunks: DataFrame, tokens: Column | str = "tokens") -> Postings:
    """The index of chunks (chunk_idx, tokens), built once. Chunks without tokens count in n and avgdl."""
    c = chunks.select("chunk_idx", (F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens"))
    stats = stored(c.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl")), "stats")
    # Dealt by chunk before words become rows, so that counts need no further shuffle and a task that scans postings has all of its chunks'.
    words = c.repartition("chunk_idx").select("chunk_idx", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    found = stored(words.groupBy("term", "chunk_idx").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "found")
    terms = stored(found.groupBy("term").agg(F.count("*").alias("df")), "terms")
    frequent = terms.filter(F.col("df") > SPLIT).select("term", parts(F.col("df")).alias("parts"))
    if frequent.isEmpty():
        return Postings(found.withColumn("part", F.lit(0)), terms, stats)
    part = F.pmod(F.xxhash64("chunk_idx"), F.coalesce("parts", F.lit(1))).cast("int")
    split = found.join(F.broadcast(frequent), "term", "left")  # a table of at most a millionth of the postings
    return Postings(stored(split.select("term", part.alias("part"), "chunk_idx", "tf", "dl"), "postings"), terms, stats)


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def exact_sum(part: Column) -> Column:
    """The sum of parts from 0 to a million, the same in whatever order rows come: whole and fractional 2^-32ths are added as longs and rounded once. A sum of
    doubles depends on the order, so equal documents could get unequal scores."""
    scaled = part * F.lit(2.0**32)
    whole = scaled.cast("long")
    rest = ((scaled - whole) * F.lit(2.0**40)).cast("long")
    return (F.sum(whole) + F.sum(rest) / F.lit(2.0**40)) / F.lit(2.0**32)


def scores(queries: DataFrame, index: Postings, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_idx, score) of queries (qid, tokens), each distinct term once. allowed (qid, chunk_idx) restricts the chunks."""
    terms = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term")).join(index.term_stats, "term")
    terms = stored(terms.withColumn("part", F.explode(F.sequence(F.lit(0), parts(F.col("df")) - 1))), "asked")
    if terms.count() <= FEW:
        terms = F.broadcast(terms)
    hits = terms.join(index.postings, ["term", "part"])
    if allowed is not None:
        hits = hits.join(allowed, ["qid", "chunk_idx"], "left_semi")
    hits = hits.crossJoin(F.broadcast(index.stats))  # one row
    norm = 1 - B + B * F.col("dl") / F.col("avgdl")
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    return hits.groupBy("qid", "chunk_idx").agg(exact_sum(part).alias("score"))


def ranked(scored: DataFrame, limit: int | None = None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """scored with rank 1.. by falling score, then chunk_idx; with a limit, only the first so many. Scores are compared to 12 digits."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 12).desc(), "chunk_idx")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def search(queries: DataFrame, index: Postings, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    return ranked(scores(queries, index, allowed), limit)


def coverage(terms: DataFrame, index: Postings) -> DataFrame:
    """(qid, coverage, uncovered) of terms (qid, pos, stem, surface): the share, weighted by idf, of the distinct stems that the index has, and the
    last surface form of each of the others, by first appearance. Queries without terms are absent."""
    t = terms.groupBy("qid", "stem").agg(F.min("pos").alias("pos"), F.max_by("surface", "pos").alias("surface"))
    t = t.join(index.term_stats.withColumnRenamed("term", "stem"), "stem", "left").crossJoin(F.broadcast(index.stats.select("n")))
    df = F.coalesce("df", F.lit(0))
    t = t.withColumn("w", idf(F.col("n"), df)).withColumn("in", df > 0)
    missing = F.array_sort(F.collect_list(F.when(~F.col("in"), F.struct("pos", "surface"))))
    share = F.sum(F.when(F.col("in"), F.col("w")).otherwise(0.0)) / F.sum("w")
    return t.groupBy("qid").agg(F.coalesce(share, F.lit(0.0)).alias("coverage"), missing["surface"].alias("uncovered"))
