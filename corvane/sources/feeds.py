"""Article feeds and golden sets from JSON, and the tables that stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import canonical_link, stripped

RECORD = "seq long, feed string, title string, link string, full_text string"


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """Records of payloads (value: a JSON object {feed: [record, ...]}): feed_pos, rec_pos, feed, title, link, full_text, is_valid.

    Feeds keep the order of their keys; names are upper-cased, and of names that so become equal the last list counts, at the first
    one's place. A payload that isn't such an object is an error when read. A record is valid if title and link are
    strings, title isn't blank, link is http(s) with a host that can be read, and full_text is a string or missing; strings are stripped.
    """
    doc = F.try_parse_json(F.col("value"))
    fails = F.raise_error(F.lit("expected a JSON object of feeds, each a list of records"))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    p = payloads.select(F.when(is_object, doc).otherwise(fails).alias("doc"), F.json_object_keys("value").alias("names"))
    spark = payloads.sparkSession
    feeds = spark.sql("SELECT array_position(names, f.key) AS feed_pos, upper(f.key) AS feed, f.value AS list FROM {payloads}, LATERAL variant_explode(doc) AS f", payloads=p)
    is_list = F.schema_of_variant("list").startswith("ARRAY")
    feeds = feeds.withColumn("list", F.when(is_list, F.col("list")).otherwise(fails))
    feeds = feeds.groupBy("feed").agg(F.min("feed_pos").alias("feed_pos"), F.max_by(F.to_json("list"), "feed_pos").alias("list"))
    rows = spark.sql("SELECT feed_pos, feed, r.pos AS rec_pos, r.value AS rec FROM {lists}, LATERAL variant_explode(parse_json(list)) AS r", lists=feeds)
    return rows.select("feed_pos", "rec_pos", "feed", *(_field(n).alias(n) for n in ("title", "link")), F.coalesce(_field("full_text"), F.lit("")).alias("full_text"), _kind("full_text").alias("kind")).withColumn(
        "is_valid", valid_record(F.col("title"), F.col("link")) & F.coalesce(F.col("kind") == "STRING", F.lit(True))
    ).drop("kind")


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("rec", f"$.{name}", "variant"))


def _field(name: str) -> Column:
    return F.when(_kind(name) == "STRING", stripped(F.try_variant_get("rec", f"$.{name}", "string")))


def valid_record(title: Column, link: Column) -> Column:
    url = F.lower(link).rlike("^https?://") & canonical_link(link).isNotNull() & ~link.rlike(r"^[^/]*//[^/?#]*[\[\]]")
    return F.coalesce((title != "") & url, F.lit(False))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """parse_feeds() of the JSON files at path, each read whole."""
    return parse_feeds(spark.read.text(path, wholetext=True))


def records(parsed: DataFrame) -> DataFrame:
    """The valid records in corpus order: seq, feed, title, link, full_text."""
    seq = F.col("feed_pos").cast("long") * (1 << 32) + F.col("rec_pos")
    return parsed.filter("is_valid").select(seq.alias("seq"), "feed", "title", "link", "full_text")


def validation_counts(parsed: DataFrame) -> DataFrame:
    """One row: raw_records (the valid ones) and invalid_records."""
    return parsed.agg(F.count_if("is_valid").alias("raw_records"), F.count_if(~F.col("is_valid")).alias("invalid_records"))


def documents_as_records(documents: DataFrame) -> DataFrame:
    """Records from a table of texts (doc_id, text, source): the first line is the title; equal texts share a link."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").alias("seq"), F.upper("source").alias("feed"), stripped(F.substring(F.split(text, "\n", 2)[0], 1, 120)).alias("title"),
        F.concat(F.lit("https://docs.example.com/"), F.md5(text), F.lit("?src="), F.col("source")).alias("link"), stripped(text).alias("full_text"),
    )


GOLDEN = "cases array<struct<id string, category string, question string, history array<struct<role string, content string>>, relevant_titles array<string>, must_cover_tickers array<string>, expect_answered boolean>>"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a golden set, one row each, with the defaults of what is left out; a case without id, category or question is an error."""
    cases = spark.read.schema(GOLDEN.replace("> ", ">")).json(path, multiLine=True).select(F.inline("cases"))
    named = F.col("id").isNotNull() & F.col("category").isNotNull() & F.col("question").isNotNull()
    return cases.select(
        F.when(named, F.col("id")).otherwise(F.raise_error(F.lit("a golden case lacks id, category or question"))).alias("case_id"), "category", "question",
        *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("history", "array<struct<role:string,content:string>>"), ("relevant_titles", "array<string>"), ("must_cover_tickers", "array<string>"))),
        F.coalesce("expect_answered", F.lit(True)).alias("expect_answered"),
    )
