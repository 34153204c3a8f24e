"""Exact deduplication by a 128-bit content hash, with the bytes of every group compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import free_name, lookup, only, row_key, scratched, sha256, without_rows
from corvane.sources.workspace import stored


def md5_128(text: Column) -> Column:
    """The default content hash: 16 bytes."""
    return F.unhex(F.md5(text))


@scratched
def exact_groups(docs: DataFrame, keep: str = "min", digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document of docs (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. keep: whether the smallest ("min", the method's own rule) or
    the largest id of a group stays. Only hashes and ids are shuffled for all rows. The texts of groups of two or more are then
    reduced to their smallest and largest (an aggregate that combines on the map side, so a group of any size stays cheap);
    where those differ, the hash collided, and that group is split by the texts themselves.

    Rows that repeat an id with the same text all count in group_size and share one verdict. A null id stays only if its group has
    no other id. Other columns are ignored; an empty table gives no rows.
    """
    best = F.max if keep == "max" else F.min
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    hashed = docs.select("doc_id", text).withColumn("h", digest(F.col("text")))
    keys = stored(hashed.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256")), "keys")
    groups = stored(keys.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "groups")
    many = groups.count()
    members = only(hashed, groups.select("h"), "h", n=many)
    apart = stored(members.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("h"), "collisions")
    split = apart.count()
    if split:
        parts = only(hashed, apart, "h", n=split).groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        parts = stored(parts.select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "parts")
        apart_keys = stored(only(keys, apart, "h", n=split).drop("h"), "apart")
        keys = only(keys, apart, "h", "left_anti", n=split)
        groups = only(groups, apart, "h", "left_anti", n=split)
    found = lookup(keys, groups, "h", "group_size").drop("h")
    if split:
        found = found.unionByName(lookup(apart_keys, parts, "text_sha256", "group_size"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs with one row of each group of equal texts, that which exact_groups() keeps; all columns stay. Of rows that repeat both id and text, one stays."""
    verdicts = exact_groups(docs, keep).select("kept", row_key(F.col("text_sha256")).alias("key"))
    seen = stored(verdicts.groupBy("key").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"), "copies")
    rest = without_rows(docs, seen.filter("NOT kept"))
    twice = seen.filter("kept").select("key")
    if not twice.head(1):
        return rest
    name = free_name(docs, "row_key")
    again = only(rest.withColumn(name, row_key(sha256())), twice.withColumnRenamed("key", name), name)
    return without_rows(rest, twice).unionByName(again.dropDuplicates([name]).drop(name))
