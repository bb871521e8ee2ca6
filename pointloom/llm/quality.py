"""Quality rules with adaptive limits (operator 1), DataFrame functions only.

Fixed base rules come first. Then every remaining document is held against limits learned from the
data: for each language and source a mergeable quantile sketch of each metric (a histogram whose
buckets keep the six leading bits of an integer, so a quantile is off by at most 1/32) gives the
quartiles, and a document is rejected where a metric lies further outside them than
``max(slack, SPREAD * interquartile range)``. Sketches are plain counts: partial ones from any
partition, source or day add up. Groups under ``min_docs`` use the merged sketch of their language,
then that of the whole corpus.

Defined results: a null text has no words (base rule fails, not kept); null language or source
are groups of their own; an empty table gives an empty result; repeated rows are judged row by row;
further columns, of whatever name, are ignored. Texts may be of any length: a text of over 2**20
words, or with colliding window hashes, takes an exact path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, stored, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Interquartile ranges beyond the quartiles that are still accepted.
SPREAD = 3
#: Smallest group whose own sketch is trusted.
MIN_DOCS = 50
#: metric -> (integer expression, least distance above the upper quartile, least distance below the lower one or None).
METRICS = {
    "symbols": ("1000 * n_symbols div nullif(n_words, 0)", 100, None),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", 450, None),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", 300, None),
    "upper": ("1000 * n_upper div nullif(word_chars, 0)", 300, None),
    "word_len": ("100 * word_chars div nullif(n_words, 0)", 300, 200),
}
#: Groups up to this many rows of limits are broadcast; beyond, the join shuffles.
BROADCAST_GROUPS = 100_000

_KEYS = """
CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>)
ELSE sort_array(transform(sequence(0, n_words - 3),
  i -> (xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)) & -1048576L) | cast(i & 1048575 AS bigint))) END
"""
_FOUND = """
filter(_keys, (k, j) -> shiftright(k, 20) = shiftright(get(_keys, j - 1), 20)
                     OR shiftright(k, 20) = shiftright(get(_keys, j + 1), 20))
"""
_COLLIDES = """
n_words > 1048576 OR (size(_found) > 1 AND exists(sequence(1, size(_found) - 1), j ->
  shiftright(get(_found, j), 20) = shiftright(get(_found, j - 1), 20) AND NOT (
    get(_words, cast(get(_found, j) & 1048575 AS int)) = get(_words, cast(get(_found, j - 1) & 1048575 AS int))
    AND get(_words, cast(get(_found, j) & 1048575 AS int) + 1) = get(_words, cast(get(_found, j - 1) & 1048575 AS int) + 1)
    AND get(_words, cast(get(_found, j) & 1048575 AS int) + 2) = get(_words, cast(get(_found, j - 1) & 1048575 AS int) + 2))))
"""
_EXACT = """
sort_array(transform(sequence(0, n_words - 3),
  i -> struct(get(_words, i) AS a, get(_words, i + 1) AS b, get(_words, i + 2) AS c, cast(i AS bigint) AS i)))
"""
_PLACES = f"""
CASE WHEN size(_found) = 0 AND n_words <= 1048576 THEN cast(array() AS array<bigint>)
WHEN NOT ({_COLLIDES}) THEN sort_array(transform(_found, k -> k & 1048575L))
ELSE aggregate(array({_EXACT}), cast(array() AS array<bigint>), (none, s) -> sort_array(transform(
  filter(s, (x, j) -> (x.a = get(s, j - 1).a AND x.b = get(s, j - 1).b AND x.c = get(s, j - 1).c)
                   OR (x.a = get(s, j + 1).a AND x.b = get(s, j + 1).b AND x.c = get(s, j + 1).c)), x -> x.i))) END
"""
_COVERED = """
CASE WHEN size(_places) < 2 THEN 0L
ELSE aggregate(sequence(1, size(_places) - 1), 3L, (n, j) -> n + least(3L, get(_places, j) - get(_places, j - 1))) END
"""


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each row plus its text statistics and ``base_failed``."""
    keep = ["doc_id", "lang", "source"] if keep is None else keep
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    own = [F.col(c) for c in keep]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    first = docs.select(
        *own,
        F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{SPACE}]+")).alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
    )
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper"]
    second = first.select(
        *keep, "_words", "word_chars", "n_symbols", "n_upper",
        F.size("_words").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    third = second.withColumn("_keys", F.expr(_KEYS)).withColumn("_found", F.expr(_FOUND)).withColumn("_places", F.expr(_PLACES))
    out = third.select(*keep, *stats, F.expr(_COVERED).alias("n_repeat_words")).withColumn("n_words", F.col("n_words").cast("long"))
    # The row number is never negative. It only keeps the optimizer from moving later filters below these
    # steps, where each would hold several copies of every expression above.
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR monotonically_increasing_id() < 0"))


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, metric, bucket, n); add up n to merge."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("long").alias("v")) for m, (e, _, _) in METRICS.items()])
    flat = rows.where("NOT base_failed").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.*")
    bucket = F.expr("v - v % cast(pow(2, greatest(0, length(bin(v)) - 6)) AS bigint)")
    return stored(flat.withColumn("bucket", bucket).groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n")))


def limits(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) with ``<metric>_hi`` and ``<metric>_lo``; small in any corpus (groups, not documents)."""
    nothing = F.lit(None).cast("string")
    levels = sketch.select(F.lit(0).alias("level"), "lang", "source", "metric", "bucket", "n")
    levels = levels.unionByName(sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", nothing.alias("source"), "metric", "bucket", "n"))
    levels = levels.unionByName(sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), nothing.alias("lang"), nothing.alias("source"), "metric", "bucket", "n"))
    # A group's buckets are few (at most 32 for each power of two), so each group is one short array.
    grouped = levels.groupBy("level", "lang", "source", "metric").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))

    def quantile(part: int) -> Column:
        return F.expr(
            f"aggregate(b, struct(0L AS c, cast(null AS bigint) AS q), (s, x) -> struct(s.c + x.n AS c, "
            f"coalesce(s.q, CASE WHEN 4 * (s.c + x.n) >= {part} * total THEN x.bucket END) AS q)).q"
        )

    quartiles = grouped.select("level", "lang", "source", "metric", "total", quantile(1).alias("q1"), quantile(3).alias("q3"))
    hi = F.coalesce(*[F.when(F.col("metric") == m, F.col("q3") + F.greatest(F.lit(up), SPREAD * (F.col("q3") - F.col("q1")))) for m, (_, up, _) in METRICS.items()])
    lo = F.coalesce(*[F.when(F.col("metric") == m, F.col("q1") - F.greatest(F.lit(down), SPREAD * (F.col("q3") - F.col("q1")))) for m, (_, _, down) in METRICS.items() if down is not None])
    each = quartiles.withColumn("hi", hi).withColumn("lo", lo)
    wide = each.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"),
        F.struct(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in ("hi", "lo")]).alias("limit"),
    )
    own, by_lang, overall = (wide.where(F.col("level") == i).drop("level") for i in range(3))
    by_lang = by_lang.select(F.col("lang").alias("_lang"), F.col("total").alias("_t1"), F.col("limit").alias("_l1"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall.select(F.col("limit").alias("_l2"))), F.lit(True), "left")
    picked = F.when(F.col("total") >= MIN_DOCS, F.col("limit")).when(F.col("_t1") >= MIN_DOCS, F.col("_l1")).otherwise(F.col("_l2"))
    return joined.select("lang", "source", picked.alias("limit")).select("lang", "source", "limit.*")


def verdict() -> Column:
    """The method's verdict on a row with its metrics and its group's limits."""
    ok = F.lit(True)
    for m, (e, _, down) in METRICS.items():
        ok = ok & (F.expr(e) <= F.col(f"{m}_hi"))
        if down is not None:
            ok = ok & (F.expr(e) >= F.col(f"{m}_lo"))
    return ok


def with_limits(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """Join each row to its group's limits. ``learned`` is stored, so its size is known and checked."""
    groups = learned.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if learned.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    return rows.join(groups, rows["lang"].eqNullSafe(F.col("_lang")) & rows["source"].eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


def judge(docs: DataFrame) -> DataFrame:
    """Statistics and verdict for each row of ``docs`` (doc_id, text, lang, source)."""
    rows = stored(measured(docs))
    learned = stored(limits(sketches(rows)).coalesce(1))
    return with_limits(rows, learned).withColumn("kept", F.coalesce(~F.col("base_failed") & verdict(), F.lit(False)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Rows are measured once and kept with their statistics: the text is never shuffled, and rows
    with the same id are judged by their own text.
    """
    own = list(docs.columns)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "lang", "source", "text")
    rows = stored(measured(packed, ["_row", "lang", "source"]))
    learned = stored(limits(sketches(rows)).coalesce(1))
    return with_limits(rows, learned).where(~F.col("base_failed") & verdict()).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
x AS (SELECT r, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'upper', 'word_len']) AS metric,
  unnest([1000 * n_symbols // n_words, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words, 1000 * n_upper // word_chars, 100 * word_chars // n_words]) AS v FROM b WHERE NOT base_failed),
s AS (SELECT lang, source, metric, v - v % pow(2, greatest(0, length(bin(v)) - 6))::BIGINT AS bucket, count(*) AS n FROM x GROUP BY ALL),
l AS (SELECT 0 AS level, * FROM s UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM s GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM s GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM l),
q AS (SELECT level, lang, source, metric, max(total) AS total, min(bucket) FILTER (4 * c >= total) AS q1, min(bucket) FILTER (4 * c >= 3 * total) AS q3 FROM u GROUP BY ALL),
h AS (SELECT *, q3 + greatest(CASE metric WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 450 WHEN 'repeats' THEN 300 WHEN 'upper' THEN 300 ELSE 300 END, 3 * (q3 - q1)) AS hi,
  CASE metric WHEN 'word_len' THEN q1 - greatest(200, 3 * (q3 - q1)) END AS lo FROM q),
o AS (SELECT a.lang, a.source, a.metric, CASE WHEN a.total >= 50 THEN a.hi WHEN e.total >= 50 THEN e.hi ELSE z.hi END AS hi, CASE WHEN a.total >= 50 THEN a.lo WHEN e.total >= 50 THEN e.lo ELSE z.lo END AS lo
  FROM (SELECT * FROM h WHERE level = 0) a JOIN (SELECT * FROM h WHERE level = 1) e ON a.metric = e.metric AND a.lang IS NOT DISTINCT FROM e.lang JOIN (SELECT * FROM h WHERE level = 2) z ON a.metric = z.metric),
y AS (SELECT x.r, bool_and(v <= hi AND (lo IS NULL OR v >= lo)) AS ok FROM x JOIN o ON x.metric = o.metric AND x.lang IS NOT DISTINCT FROM o.lang AND x.source IS NOT DISTINCT FROM o.source GROUP BY x.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(ok, false) AS kept FROM b LEFT JOIN y USING (r)
"""
