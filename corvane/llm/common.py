"""What the operators share: skew-safe lookups, row keys, row removal, tables that go."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.workspace import Scratch, stored

#: A key with at least 1/HEAVY of all rows is heavy; so there are at most HEAVY heavy keys at any size.
HEAVY = 256
#: A list of ids or digests is broadcast up to so many rows (some 150 MB in memory at 16 bytes a key); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Characters that separate words in the contracts of this package.
SPACES = "\t\n\x0b\x0c\r "


def scratched(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f (docs, ...), whose stored() tables go when it returns, but for its result, which is stored too."""

    @wraps(f)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        with Scratch(docs.sparkSession) as tables:
            found = f(docs, *args, **more)
            found = found if hasattr(found, "corvane_table") else stored(found, f.__name__)
            tables.keep(found)
        return found

    return run


def row_key(text_sha256: Column) -> Column:
    """16 bytes that name a row by its doc_id, which may be null or repeat, and the SHA-256 of its text in hex."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_sha256)))


def sha256(text: str = "text") -> Column:
    """Of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores as make it differ from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose row_key() is in gone (key); all columns stay."""
    name = free_name(docs, "row_key")
    rows = docs.withColumn(name, row_key(sha256()))
    return only(rows, gone.select(F.col("key").alias(name)).distinct(), name, "left_anti").drop(name)


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows left-joined with table (one row a key; count: how many of rows have the key).

    Heavy keys, of which there are at most HEAVY, are broadcast; only the others are shuffled, so no task gets a hot key.
    Both inputs should be stored tables, as each is read twice.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    least = max(2, -(-total // HEAVY))
    heavy, light = table.filter(F.col(count) >= least), table.filter(F.col(count) < least)
    hot = rows.join(F.broadcast(heavy), key, "inner")
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return cold.unionByName(hot)


def only(rows: DataFrame, keys: DataFrame, key: str | list[str], how: str = "left_semi", n: int | None = None) -> DataFrame:
    """rows whose key is (left_semi) or isn't (left_anti) in keys: by broadcast if keys are few, else by a shuffle join."""
    if (keys.count() if n is None else n) <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return rows.join(keys, key, how)
