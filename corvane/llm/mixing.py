"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, free_name, only, row_key, scratched, sha256
from corvane.sources.workspace import stored

#: Rows that one bucket of the running sums holds on average.
BUCKET_ROWS = 20_000
#: Weights of the sources in order, repeating, and how each source's weight moves over training: at time t of 0..1 the weight is
#: weight * (1 + slope * (2 t - 1)), whose mean over training is the weight itself.
WEIGHTS, SLOPES = (3.0, 1.0, 2.0), (0.5, 0.0, -0.5)


def count_words(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null. Counts word starts by removing what follows each first character."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(spaced, " +"), "")).cast("long")


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target, slope) of sources (source, source_size, n), one row a source.

    share of all sizes is dealt out by weight; a target stops at most times its source's size and the excess goes to the others
    by weight, until none is above. That fixed point is a water level: with the sources ordered by cap over weight, the first k
    are capped where the level of the others reaches their caps. The table has a row a source, which is why one task may sort it.
    """
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", "rank")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    s = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", pick(WEIGHTS)).withColumn("slope", pick(SLOPES))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    s = s.withColumn("total", share * F.sum("source_size").over(every))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    others = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", left / others)  # if all before are capped and none from here on
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every)
    target = F.when(level.isNull() | (F.col("fill") <= level), F.col("cap")).otherwise(F.col("weight") * level)
    return s.withColumn("target", target).select("source", "source_size", "n", "target", "slope")


def taken_between(start: Column, size: Column, demand: Column) -> Column:
    """How much of [start, start + size) lies below demand."""
    return F.greatest(F.least(start + size, demand) - start, F.lit(0)).cast("long")


def training_time(part: Column, slope: Column) -> Column:
    """The time at which a source has been asked for part (0..1) of its target: the inverse of the integral of its schedule,
    t + slope (t^2 - t)."""
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * part, F.lit(0.0)))
    return F.when(slope == 0, part).otherwise((root - (1 - slope)) / (2 * slope))


@scratched
def mixture(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0, by: str = "source", row: str | None = None) -> DataFrame:
    """One row per document of docs (doc_id, text, source column): doc_id, size, source_size, target, taken, passes, position.

    Each source is one endless tape of its documents in a hashed order. The mix reads the tape up to the source's target, so a
    document is taken in whole passes and the one at the end in part; sums differ from the targets by less than one word. The
    place on the tape, put through the inverse of the source's cumulative schedule, is the time at which training reads the
    document: position (0..1, of the first pass; null where nothing is taken). ranged() puts the rows in that order.

    Running sums are built from bucket sums, so that no task gets a whole source: buckets of the hashed order, of BUCKET_ROWS rows
    on average, are summed, their sums are accumulated (a row a bucket), and only inside a bucket are rows put in order.
    Ties in the hashed order go by doc_id, then size; rows that are equal in both are interchangeable. Sizes of 0 take 0; an empty
    table gives no rows. A null source is a source of its own. Other columns are ignored, but for row, which is passed on and breaks
    further ties.
    """
    own = [row] if row else []
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), sha256()))  # null ids are spread by their texts
    order = F.md5(F.concat(name, F.lit(f":{seed}" if seed else "")))
    d = docs.select("doc_id", F.col(by).cast("string").alias("source"), count_words(F.col("text")).alias("size"), order.alias("order"), *own)
    d = stored(d.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))), "sizes")
    n = d.count()
    buckets = max(1, n // BUCKET_ROWS, min(1024, n // 50))
    first = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    d = d.withColumn("bucket", F.floor(first * buckets / 2**32).cast("long"))  # in the hashed order
    sums = stored(d.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("bucket_rows"), F.first("source").alias("source")), "buckets")
    sources = sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"), F.sum("bucket_rows").alias("n"))
    targets = source_targets(sources.select("source", "source_size", "n"), share, most)
    targets = stored(targets.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))).drop("source"), "targets")
    run = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(run), F.lit(0))).select("source_key", "bucket", "base", "bucket_rows")
    starts = stored(starts.drop("bucket_rows").join(targets.drop("n"), "source_key"), "starts")
    inside = Window.partitionBy("source_key", "bucket").orderBy("order", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_key", "bucket"])
    begin, size = F.col("base") + F.col("before"), F.col("size")
    demand = F.floor(F.col("target") + 0.5)
    taken = sum((taken_between(begin + k * F.col("source_size"), size, demand) for k in range(most)), F.lit(0).cast("long"))
    d = d.withColumn("taken", taken.cast("long"))
    passes = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.col("taken") / F.greatest(size, F.lit(1)) + 0.5)).cast("int")
    at = training_time(F.least(begin / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0)), F.col("slope"))
    d = d.withColumn("position", F.when(F.col("taken") > 0, F.abs(at))).withColumn("passes", passes)
    out = d.select("doc_id", "size", "source_size", "target", "taken", "passes", "position", begin.alias("tape"), "slope", *own)
    return stored(out, "mixture")


def ranged(m: DataFrame) -> DataFrame:
    """Rows of mixture() in training order, what isn't taken last."""
    n = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return m.repartitionByRange(n, F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0, by: str = "source") -> DataFrame:
    """docs as training reads them: each row as often as mixture() takes it (to the nearest whole pass), range-sorted by the
    training position of each pass; rows that the mix doesn't reach go. All columns stay. A row is known by its id, source and text, so rows with a
    null id and with a repeated one count for themselves; rows equal in all three share what they take together."""
    key, at = free_name(docs, "row_key"), free_name(docs, "position")
    source = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    rows = docs.withColumn(key, row_key(F.concat(sha256(), source)))
    every = mixture(rows.select("doc_id", "text", F.col(by), F.col(key)), share, most, seed, by, key)
    m = every.filter("passes > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("k"), "tape", "source_size", "target", "slope")
    time = training_time(F.least((F.col("tape") + F.col("k") * F.col("source_size")) / F.col("target"), F.lit(1.0)), F.col("slope"))
    m = stored(m.select(key, time.alias(at)), "passes")
    same = stored(every.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "equal")
    if same.head(1):  # m has the passes of all the equal rows, so one of them is enough
        rows = only(rows, same, key, "left_anti").unionByName(only(rows, same, key).dropDuplicates([key]))
    found = rows.join(m, key)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartitionByRange(n, at, "doc_id").sortWithinPartitions(at, "doc_id")
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
