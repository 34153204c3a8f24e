"""URL filters with dated lists: every capture is judged by the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS
from corvane.sources.workspace import stored

#: Copies of the list and parts of the captures where the list is too large to broadcast.
SALT = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: Hosts that are addresses and so have no domain above them.
ADDRESS = r"^(\[|[0-9.]+$)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, an IPv6 address with its brackets; empty if it has none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def keys_of(url: Column) -> Column:
    """What entries may match a URL: its host and every domain above it (none above an address), and the host with every folder of the path
    ("host/a/"), in the path's own case."""
    host = host_of(url)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*(/[^?#]*)", 1)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(above)
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    keys = F.when(F.size(parts) > 1, F.concat(above, folders)).otherwise(above)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def validity(events: DataFrame) -> DataFrame:
    """(entry, since, until) of events (entry, action add or remove, at): an entry holds from each add to its next event, whatever that is.

    until is null while it still holds. Of events at one time, removal is the last, so an entry added and removed at once never
    holds. Events without entry or time, and other actions, are left out. The host of an entry is lower-cased, its path keeps its case.
    """
    host = F.substring_index("entry", "/", 1)
    entry = F.concat(F.lower(host), F.substr("entry", F.char_length(host) + 1))
    e = events.filter(F.col("entry").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove")).select(entry.alias("entry"), "action", "at").distinct()
    order = Window.partitionBy("entry").orderBy("at", "action")
    e = e.withColumn("until", F.lead("at").over(order)).filter("action = 'add' AND (until IS NULL OR until > at)")
    return e.select("entry", F.col("at").alias("since"), "until")


def temporal_verdicts(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One row per capture of captures (page_id, url, fetched_at): page_id, host, fetched_at, n_active, entry, blocked.

    n_active entries matched the capture and held at fetched_at; entry is the first of them in order of code points. Captures without
    URL, host or time match nothing. Captures equal in page_id, url and fetched_at have as many equal rows; other columns are ignored.

    The join is by key and interval: intervals of one entry don't overlap, so a key of a capture meets at most one. The list is
    broadcast up to BROADCAST_ROWS rows; a longer one is repeated SALT times and captures are dealt over the copies, so that a host
    with a third of all captures is spread.
    """
    spans = stored(validity(events), "validity")
    c = captures.select("page_id", "url", "fetched_at").select("*", F.posexplode_outer(keys_of(F.col("url"))).alias("nth", "key"))
    holds = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    if spans.count() <= BROADCAST_ROWS:
        found = c.join(F.broadcast(spans), (F.col("key") == F.col("entry")) & holds, "left")
    else:
        c = c.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(SALT)).cast("int"))
        spans = spans.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = c.join(spans, (F.col("key") == F.col("entry")) & (F.col("salt") == F.col("copy")) & holds, "left")
    copies = F.count_if(F.coalesce("nth", F.lit(0)) == 0)  # each key of a capture has one row
    found = found.groupBy("page_id", "url", "fetched_at").agg(copies.alias("n"), F.collect_set("entry").alias("entries"))
    found = found.select("page_id", "url", "fetched_at", F.size("entries").cast("long").alias("n_active"), F.array_min("entries").alias("entry"), F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    return found.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at", "n_active", "entry", (F.col("n_active") > 0).alias("blocked"))
