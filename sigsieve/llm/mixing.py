"""Mixing sources to target weights: temperature weights, realised as budgeted block permutations.

Weights are w_s = p_s**a / sum(p**a) over the sources' token shares p.  Entropy falls and the largest number of passes
over a source falls as a grows from 0 to 1, so both targets are met by bisection.  Each source is then read in epochs;
an epoch is a permutation of the source's documents, in blocks dealt by a hash of the epoch and the document, and the
last epoch stops where the source's token budget ends.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A token is a word, as in the rest of this package.
TOKENS = r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)"
STEPS = 50
#: Copies of one row that one task writes out.
COPIES_PER_TASK = 65_536


def source_weights(tokens: DataFrame, entropy_share: float | None, repetition_limit: float, budget_tokens: int | None) -> DataFrame:
    """(source, n_docs, total, exponent, weight, quota) of each source that has tokens.

    exponent is the largest in [0, 1] whose entropy is at least `entropy_share` of the possible ln(sources) (1 without
    that target), raised to the smallest at which no source is read more than `repetition_limit` times.  The budget,
    all tokens by default, is at most repetition_limit times all tokens, as more could not be met by any weights.
    One row holds the sources' totals during the bisection: a list of sources, not of documents.
    """
    per = tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("total")).where("total > 0")
    one = per.agg(F.sort_array(F.collect_list(F.struct("source", "total", "n_docs"))).alias("s")).where("size(s) > 0")
    one = one.withColumn("all", F.expr("aggregate(s, 0L, (a, x) -> a + x.total)"))
    wanted = "all" if budget_tokens is None else f"{int(budget_tokens)}L"
    one = one.withColumn("budget", F.expr(f"least(cast({wanted} as double), {float(repetition_limit)}D * all)"))
    one = one.withColumn("p", F.expr("transform(s, x -> x.total / cast(all as double))"))
    z = "aggregate(p, 0D, (t, x) -> t + pow(x, {a}))"
    entropy = f"aggregate(p, 0D, (t, x) -> t - pow(x, {{a}}) / {z} * ln(pow(x, {{a}}) / {z}))"
    passes = f"budget / all * aggregate(p, 0D, (t, x) -> greatest(t, pow(x, {{a}} - 1))) / {z}"

    def bisect(low_moves: str) -> F.Column:
        mid = "((r.lo + r.hi) / 2)"
        test = low_moves.format(a=mid)
        return F.expr(f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (r, i) -> "
                      f"if({test}, named_struct('lo', {mid}, 'hi', r.hi), named_struct('lo', r.lo, 'hi', {mid})))")

    if entropy_share is None:
        one = one.withColumn("a_entropy", F.lit(1.0))
    else:
        target = f"{float(entropy_share)}D * ln(cast(size(p) as double))"
        one = one.withColumn("a_entropy", F.when(F.expr(f"{entropy.format(a='1D')} >= {target}"), 1.0).otherwise(
            bisect(f"{entropy} >= {target}")["lo"]))
    limit = f"{float(repetition_limit)}D"
    one = one.withColumn("a_passes", F.when(F.expr(f"{passes.format(a='0D')} <= {limit}"), 0.0).otherwise(
        bisect(f"{passes} > {limit}")["hi"]))
    one = one.withColumn("exponent", F.round(F.greatest("a_entropy", "a_passes"), 9))
    one = one.withColumn("z", F.expr(z.format(a="exponent")))
    row = one.select("exponent", "z", "budget", "all", F.explode("s").alias("x"))
    weight = F.expr("pow(x.total / cast(all as double), exponent) / z")
    return row.select("x.source", "x.n_docs", "x.total", "exponent", F.round(weight, 12).alias("weight"),
                      F.round(F.round(weight, 12) * F.col("budget"), 0).cast("bigint").alias("quota"))


def _copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, n_tokens) with `copy`, numbering equal rows from 0.  They are counted before any shuffle, and
    many copies are written out again by many tasks."""
    counted = rows.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES_PER_TASK})")))
    parts = parts.repartition("doc_id", "source", "n_tokens", "part")
    numbers = F.expr(f"sequence(part * {COPIES_PER_TASK}, least(n, (part + 1) * {COPIES_PER_TASK}) - 1)")
    return parts.select("doc_id", "source", "n_tokens", F.explode(numbers).alias("copy"))


def mix(docs: DataFrame, entropy_share: float | None = 0.95, repetition_limit: float = 4.0, budget_tokens: int | None = None,
        block_docs: int = 256, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place): the documents to read, each source in blocks 0, 1, ... of each epoch.

    A source's null name is a source of its own.  Null or wordless texts have no tokens and cost nothing; a source
    without any token has weight 0 and gives no rows.  Repeated rows are documents of their own: they are counted, and
    the copy number enters the hash, as the number of tokens does without a doc_id, so neither a repeated id nor rows
    without one meet in one block.  Read a block in the order of `place`.  Running token sums go over documents inside a block, blocks inside a span of 4,096 blocks, and
    spans inside an epoch, so a hot source is summed by many tasks.
    """
    rows = cut(_copies(docs.select("doc_id", "source", F.expr(TOKENS).cast("bigint").alias("n_tokens"))))
    weights = source_weights(rows, entropy_share, repetition_limit, budget_tokens)
    plan = cut(weights.select(F.col("source").alias("_source"), "n_docs", "total", "quota"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    epochs = rows.join(plan, same).drop("_source").withColumn("epoch", F.explode(F.expr("sequence(0L, div(quota, total))")))
    digest = F.md5(F.concat(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                            F.when(F.col("doc_id").isNotNull() & (F.col("copy") == 0), "").otherwise(F.concat_ws("|", F.lit(""), "n_tokens", "copy"))))
    epochs = epochs.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    epochs = epochs.withColumn("block", F.expr(f"pmod(_h, cast(ceil(n_docs / {block_docs}D) as bigint))"))
    epochs = epochs.withColumn("left_over", F.expr("quota - epoch * total")).select(
        "doc_id", "source", "n_tokens", "epoch", "block", "_h", "left_over")
    key = ["source", "epoch"]
    sums = epochs.groupBy(*key, "block").agg(F.sum("n_tokens").alias("n")).withColumn("span", F.expr("div(block, 4096)"))
    spans = sums.groupBy(*key, "span").agg(F.sum("n").alias("n"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("source").alias("s1"), F.col("epoch").alias("e1"), F.col("span").alias("p1"), before(key, "span").alias("span_at"))
    sums = sums.withColumn("in_span", before([*key, "span"], "block"))
    starts = sums.join(spans, F.col("source").eqNullSafe(F.col("s1")) & (F.col("epoch") == F.col("e1")) & (F.col("span") == F.col("p1")))
    starts = starts.select(F.col("source").alias("s2"), F.col("epoch").alias("e2"), F.col("block").alias("b2"), (F.col("span_at") + F.col("in_span")).alias("block_at"))
    inside = Window.partitionBy(*key, "block").orderBy("_h", "doc_id", "n_tokens")
    placed = epochs.withColumn("place", F.row_number().over(inside).cast("bigint")).withColumn(
        "_upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = placed.join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2")) & (F.col("block") == F.col("b2")))
    return whole.where("block_at + _upto <= left_over").select("doc_id", "source", "n_tokens", "epoch", "block", "place")


def mix_sql(docs_cte: str) -> str:
    """DuckDB for mix() with its defaults.  docs_cte: common table expressions that end with one named docs."""
    return rf"""
WITH RECURSIVE {docs_cte},
raw AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM docs),
tok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, n_tokens) - 1 AS copy FROM raw),
src AS (SELECT source, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS total FROM tok GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT CAST(sum(total) AS BIGINT) AS everything, CAST(sum(total) AS DOUBLE) AS budget, count(*) AS n_src FROM src),
lst AS (SELECT list(total / CAST(everything AS DOUBLE) ORDER BY source NULLS FIRST) AS p FROM src, tot),
one AS (SELECT list_sum(list_transform(p, lambda x: -x * ln(x))) >= 0.95 * ln(CAST(n_src AS DOUBLE)) AS flat FROM lst, tot),
ent AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, list_sum(list_transform(p, lambda x: -pow(x, mid) / z * ln(pow(x, mid) / z))) >= 0.95 * ln(CAST(n_src AS DOUBLE)) AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, p, n_src, list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS z FROM ent, lst, tot WHERE i < 50))),
rep AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, list_max(list_transform(p, lambda x: pow(x, mid - 1))) / z > 4.0 AS up
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, p, list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS z FROM rep, lst WHERE i < 50))),
ex AS (
  SELECT round(greatest(CASE WHEN flat THEN 1.0 ELSE (SELECT lo FROM ent WHERE i = 50) END,
                        CASE WHEN list_max(list_transform(p, lambda x: pow(x, -1.0))) / len(p) <= 4.0 THEN 0.0 ELSE (SELECT hi FROM rep WHERE i = 50) END), 9) AS a
  FROM one, lst),
zed AS (SELECT a, list_sum(list_transform(p, lambda x: pow(x, a))) AS z FROM ex, lst),
plan AS (SELECT source, n_docs, total, CAST(round(round(pow(total / CAST(everything AS DOUBLE), a) / z, 12) * budget, 0) AS BIGINT) AS quota FROM src, tot, zed),
ep AS (
  SELECT t.doc_id, t.source, t.n_tokens, t.copy, n_docs, quota, total, unnest(range(0, quota // total + 1)) AS epoch
  FROM tok t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source),
hashed AS (
  SELECT *, CAST('0x' || substr(md5('42|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')
    || CASE WHEN doc_id IS NOT NULL AND copy = 0 THEN '' ELSE '|' || n_tokens || '|' || copy END), 1, 15) AS BIGINT) AS h FROM ep),
blocked AS (SELECT *, h % CAST(ceil(n_docs / 256.0) AS BIGINT) AS block FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, epoch, block ORDER BY h, doc_id, n_tokens) AS place,
    sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block, h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM blocked)
SELECT doc_id, source, n_tokens, epoch, block, place FROM placed WHERE upto <= quota - epoch * total
"""
