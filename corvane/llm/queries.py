"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, classifier, exact_dedup, licenses, minhash, mixing, pii, quality_rules, substring, url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "op2_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")


#: DuckDB for the words [^\\x20\\x09-\\x0D]+ of a text t.
WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op6_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {WORDS} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
    win AS (SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
    s AS (SELECT w.doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols > 0.05::DOUBLE * word_chars OR n_dup_lines > 0.3::DOUBLE * n_lines
        OR (n_words > 0 AND (word_chars / n_words < 2 OR word_chars / n_words > 20)) AS broken FROM s),
    h AS (SELECT host, count(*) AS n, count_if(base_failed OR broken) AS f FROM b GROUP BY host),
    p AS (SELECT sum(f) / sum(n) AS m, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS noise FROM h),
    q AS (SELECT m, greatest(CASE WHEN v - m * (1 - m) * noise > m * (1 - m) / 1001 THEN m * (1 - m) / (v - m * (1 - m) * noise) - 1 ELSE 1000.0 END, 0.01) AS k FROM p),
    r AS (SELECT host, (f + m * k) / (n + k) AS rate FROM h, q)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, rate >= 0.9 AS host_blocked,
        NOT base_failed AND NOT broken AND rate < 0.9 AS kept FROM b JOIN r USING (host)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.withColumn("host_rate", F.round("host_rate", 6))


@query(
    "op7_curriculum_mix",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    z AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM z GROUP BY source),
    fill AS (  -- rounds: what is open shares what is left; sources above their cap close
        SELECT 0 AS i, source, source_size, cap, weight, NULL::DOUBLE AS target, 1.5::DOUBLE * sum(source_size) OVER () AS rest FROM s
        UNION ALL
        SELECT i + 1, source, source_size, cap, weight, CASE WHEN target IS NOT NULL THEN target WHEN share >= cap THEN cap END,
            rest - coalesce(sum(CASE WHEN target IS NULL AND share >= cap THEN cap END) OVER (), 0)
        FROM (SELECT *, weight * rest / sum(CASE WHEN target IS NULL THEN weight END) OVER () AS share FROM fill) WHERE i < 30),
    t AS (SELECT source, source_size, coalesce(target, weight * rest / sum(CASE WHEN target IS NULL THEN weight END) OVER ()) AS target FROM fill WHERE i = 30),
    u AS (SELECT *, [0.5, 0.0, -0.5][((dense_rank() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS a FROM t),
    y AS (SELECT doc_id, size, source_size, target, a, floor(target + 0.5)::BIGINT AS need,
        (sum(size) OVER (PARTITION BY z.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS b FROM z JOIN u ON z.source IS NOT DISTINCT FROM u.source),
    x AS (SELECT *, greatest(least(b + size, need) - b, 0) + greatest(least(b + source_size + size, need) - b - source_size, 0) AS taken, least(b / greatest(target, 1), 1.0::DOUBLE) AS part FROM y)
    SELECT doc_id, size, source_size, round(target, 3) AS target, taken::BIGINT AS taken,
        CASE WHEN taken > 0 THEN round(CASE WHEN a = 0 THEN part ELSE abs((sqrt(greatest((1 - a) * (1 - a) + 4 * a * part, 0)) - (1 - a)) / (2 * a)) END, 6) END AS position FROM x""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.ranged(m).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("position", 6).alias("position"))


@query("op9_minhash_bayes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def multi_50k() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), multi_50k())


@query("op8_fingerprint_index")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


@query("op10_sanitisation")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql() -> str:
    """DuckDB for the canonical lines of a text t."""
    x = r"' ' || replace(regexp_replace(lower(t), '[^\p{L}\p{N}\n]+', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for variant, usual in licenses.SPELLINGS:
        x = f"replace({x}, ' {variant} ', ' {usual} ')"
    lines = f"list_transform(string_split(regexp_replace({x}, ' +', ' ', 'g'), chr(10)), lambda l: trim(l, ' '))"
    return f"list_filter({lines}, lambda l: l <> '' AND NOT (regexp_matches(l, '{licenses.NOTICE}') OR (regexp_matches(l, '{licenses.HOLDER}') AND NOT regexp_matches(l, '{licenses.BODY}'))))"


@query(
    "op4_license_scan",
    f"""
    WITH known AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licenses.KNOWN)}) AS v(license, t)),
    k AS (SELECT sha256(array_to_string(x, ' ')) AS digest, min(license) AS license FROM (SELECT license, {_canonical_sql()} AS x FROM known) GROUP BY digest),
    d AS (SELECT doc_id, {_canonical_sql()} AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    w AS (SELECT doc_id, CASE WHEN len(x) > 0 THEN sha256(array_to_string(x, ' ')) END AS digest FROM d),
    n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, sha256(unnest(x)) AS digest FROM d) JOIN k USING (digest) GROUP BY doc_id)
    SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM w LEFT JOIN k USING (digest) LEFT JOIN n USING (doc_id)""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The pages have no fetch times and there is no list, so both are made by rule: page p is fetched p mod 366 days (and p mod 24 hours) into
#: 2024; three of four hosts, by their MD5, are added, removed and perhaps added again on days that its MD5 gives; one domain and one folder of each host too.
@query(
    "op1_url_lists",
    r"""
    WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_hours(((page_id % 366) * 24 + page_id % 24)::INT) AS fetched_at,
        rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '.') AS host, regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
    h AS (SELECT DISTINCT host, md5(host) AS m FROM c WHERE host <> '' AND substr(md5(host), 12, 1) < 'c'),
    raw AS (SELECT host AS entry, 'add' AS action, ('0x' || substr(m, 1, 2))::INT AS day FROM h
        UNION ALL SELECT host, 'remove', ('0x' || substr(m, 1, 2))::INT + ('0x' || substr(m, 3, 2))::INT // 4 FROM h
        UNION ALL SELECT host, 'add', ('0x' || substr(m, 1, 2))::INT + ('0x' || substr(m, 5, 2))::INT // 2 FROM h WHERE substr(m, 7, 1) < '8'
        UNION ALL SELECT host || '/fr/', 'add', ('0x' || substr(m, 9, 2))::INT FROM h
        UNION ALL SELECT * FROM (VALUES ('example.com', 'add', 100), ('example.com', 'remove', 110)) AS v),
    e AS (SELECT DISTINCT entry, action, TIMESTAMP '2024-01-01 00:00:00' + to_days(day) AS moment FROM raw),
    i AS (SELECT * FROM (SELECT entry, action, moment AS since, lead(moment) OVER (PARTITION BY entry ORDER BY moment, action) AS until FROM e) WHERE action = 'add' AND (until IS NULL OR until > since)),
    k AS (SELECT page_id, url, host, fetched_at, unnest(CASE WHEN regexp_matches(host, '^(\[|[0-9.]+$)') THEN [host] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.')) END
        || list_transform(range(1, len(string_split(path, '/'))), lambda j: host || array_to_string(string_split(path, '/')[1:j], '/') || '/')) AS key FROM c)
    SELECT c.page_id, c.host, c.fetched_at, coalesce(x.n, 0) AS n_active, x.entry, coalesce(x.n, 0) > 0 AS blocked
    FROM c LEFT JOIN (SELECT page_id, url, fetched_at, count(DISTINCT entry) AS n, min(entry) AS entry FROM k JOIN i ON key = entry AND fetched_at >= since AND (until IS NULL OR fetched_at < until) GROUP BY ALL) x
        ON c.page_id = x.page_id AND c.url = x.url""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hours = ((F.col("page_id") % 366) * 24 + F.col("page_id") % 24).cast("int")
    captures = pages.withColumn("fetched_at", start + F.make_dt_interval(hours=hours))
    h = pages.select(url_lists.host_of(F.col("url")).alias("host")).withColumn("m", F.md5("host")).filter("host <> '' AND substr(m, 12, 1) < 'c'").distinct()
    byte = lambda i: F.conv(F.substring("m", i, 2), 16, 10).cast("int")
    event = lambda entry, action, day: F.struct(entry.alias("entry"), F.lit(action).alias("action"), day.cast("int").alias("day"))
    again = F.when(F.substring("m", 7, 1) < "8", event(F.col("host"), "add", byte(1) + F.floor(byte(5) / 2)))
    made = F.array(event(F.col("host"), "add", byte(1)), event(F.col("host"), "remove", byte(1) + F.floor(byte(3) / 4)), again, event(F.concat("host", F.lit("/fr/")), "add", byte(9)))
    events = h.select(F.explode(made).alias("e")).filter("e IS NOT NULL").select("e.*")
    events = events.union(spark.createDataFrame([("example.com", "add", 100), ("example.com", "remove", 110)], events.schema))
    return url_lists.temporal_verdicts(captures, events.select("entry", "action", (start + F.make_dt_interval(days=F.col("day"))).alias("at")))
