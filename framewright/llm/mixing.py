"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a in 0..1 and normalised. The exponent
is bisected on a grid: the largest one whose mixture has the target entropy, or, if
that would read some source more often than the repetition limit allows, the smallest
one that keeps the limit. The mixture is realised against a token budget: a source's
documents stand in blocks by hash; whole passes take every block, the last pass takes
blocks in an order permuted by source and pass until the budget is met, and documents
of the one block that the budget cuts in hashed order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Steps of the exponent's grid and blocks of a source.
GRID, BLOCKS = 1 << 16, 4096
#: Words: runs of bytes other than space and 9 to 13.
WORDS = r"[^\x20\x09-\x0D]+"


def mixture(shares: list[float], a: float) -> list[float]:
    powers = [p**a for p in shares]
    total = sum(powers)
    return [x / total for x in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def exponent(shares: list[float], evenness: float, repeat: float, budget: float) -> int:
    """Grid step of the exponent. ``evenness`` is the target entropy as a part of that
    of equal weights, ``budget`` the tokens to realise as a multiple of those there are,
    ``repeat`` the most passes over a source (1 and the natural shares if unreachable).
    """

    def last(holds) -> int:  # largest step for which it holds, if it holds below
        low, high = 0, GRID
        if holds(high):
            return high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    if len(shares) < 2:
        return GRID
    # a hair below the target, so that equal weights meet an evenness of 1
    target = evenness * math.log(len(shares)) - 1e-9
    even = last(lambda k: entropy(mixture(shares, k / GRID)) >= target)
    passes = lambda k: max(w * budget / p for w, p in zip(mixture(shares, k / GRID), shares, strict=True))
    over = lambda k: passes(k) > repeat + 1e-9
    fewest = GRID if over(GRID) else (0 if not over(0) else last(over) + 1)
    return max(even, fewest)


def hashed(*parts) -> F.Column:
    """A number below 2^32 from the parts' text, the same in any engine with MD5."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_plan(totals: list[tuple[str, int]], evenness: float, repeat: float, budget: float) -> list[tuple[str, int, float, int, int]]:
    """``source, tokens, weight, whole passes, tokens of the last pass`` of each source."""
    totals = sorted((s, n) for s, n in totals if n > 0)
    everything = sum(n for _, n in totals)
    shares = [n / everything for _, n in totals]
    weights = mixture(shares, exponent(shares, evenness, repeat, budget) / GRID) if totals else []
    plan = []
    for (source, tokens), w in zip(totals, weights, strict=True):
        due = math.floor(w * (budget * everything))
        plan.append((source, tokens, w, due // tokens, due % tokens))
    return plan


def mix(docs: DataFrame, evenness: float = 0.95, repeat: float = 4.0, budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, pass, n_tokens, weight``: one row for each time a document is read.

    Tokens are words. A null source is the empty name. Documents without words carry
    no tokens and are left out, as are those with a null id; rows that share an id are
    one document, their words added up, of the first of their sources. The plan is a row for each source; a source's last pass
    falls short of its budget by less than its next document. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(source_col, F.lit("")).alias("source"), words.alias("n_tokens"))
    rows = rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    rows = saved(rows.withColumn("block", F.pmod(hashed("block", F.col("doc_id")), F.lit(BLOCKS)).cast("int")), "sized")
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    totals = [(r["source"], r["tokens"]) for r in blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).toLocalIterator()]
    schema = "source string, total long, weight double, passes long, rest long"
    plan = spark.createDataFrame(source_plan(totals, evenness, repeat, budget), schema)
    # BLOCKS rows at most for a source
    order = Window.partitionBy("source").orderBy("place", "block")
    placed = blocks.join(plan, "source").withColumn("place", hashed("pass", F.col("passes"), F.col("source"), F.col("block"))).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    placed = placed.select("source", "block", "weight", "passes", F.when(F.col("before") + F.col("tokens") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 2).otherwise(0).alias("take"), (F.col("rest") - F.col("before")).alias("room"))
    found = rows.join(placed, ["source", "block"])
    whole = found.select("doc_id", "source", "n_tokens", "weight", F.explode(F.when(F.col("passes") + (F.col("take") == 1).cast("long") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") + (F.col("take") == 1).cast("long") - 1))).alias("pass"))
    cut = found.where("take = 2")
    inside = Window.partitionBy("source").orderBy(hashed("document", F.col("doc_id")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("upto", F.sum("n_tokens").over(inside)).where("upto <= room").select("doc_id", "source", "n_tokens", "weight", F.col("passes").alias("pass"))
    return whole.unionByName(cut).select("doc_id", "source", "pass", "n_tokens", "weight")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mixture reads them, with their columns. Rows
    with a null id count as documents too, known by their text's hash."""
    own = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = docs.withColumn("_key", F.coalesce(F.col(id_col).cast("string"), own))
    times = mix(keyed, id_col="_key", text_col=text_col, **options).groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("_times"))
    return keyed.join(times, "_key").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(docs.columns)


def oracle_sql(evenness: float = 0.95, repeat: float = 4.0, budget: float = 1.0) -> str:
    """The same rows in DuckDB's SQL; the exponent is looked up on the whole grid."""
    md5 = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
    return f"""
WITH sized AS (
  SELECT doc_id, min(coalesce(source, '')) AS source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS n_tokens
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (SELECT *, {md5("'block:' || doc_id")} % {BLOCKS} AS block FROM sized WHERE n_tokens > 0),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM docs GROUP BY source),
shares AS (SELECT source, total, total / sum(total) OVER () AS p, count(*) OVER () AS s FROM totals),
curve AS (
  SELECT k, ln(sum(pow(p, k / {GRID}.0))) - (k / {GRID}.0) * sum(pow(p, k / {GRID}.0) * ln(p)) / sum(pow(p, k / {GRID}.0)) AS h,
    max(pow(p, k / {GRID}.0 - 1)) * {budget} / sum(pow(p, k / {GRID}.0)) AS passes, any_value(s) AS s
  FROM shares, range(0, {GRID} + 1) AS g(k) GROUP BY k),
steps AS (
  SELECT CASE WHEN max(s) < 2 THEN {GRID} ELSE greatest(
    coalesce(max(k) FILTER (h >= {evenness} * ln(s) - 1e-9), 0),
    coalesce(max(k) FILTER (passes > {repeat} + 1e-9) + 1, 0)) END AS k FROM curve),
weighted AS (
  SELECT source, total, pow(p, least(k, {GRID}) / {GRID}.0) / sum(pow(p, least(k, {GRID}) / {GRID}.0)) OVER () AS weight,
    sum(total) OVER () AS everything FROM shares, steps),
plan AS (
  SELECT source, total, weight, floor(weight * ({budget} * everything))::BIGINT // total AS passes,
    floor(weight * ({budget} * everything))::BIGINT % total AS rest FROM weighted),
blocks AS (
  SELECT d.source, block, sum(n_tokens)::BIGINT AS tokens, any_value(weight) AS weight, any_value(passes) AS passes, any_value(rest) AS rest
  FROM docs d JOIN plan USING (source) GROUP BY d.source, block),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY {md5("'pass:' || passes || ':' || source || ':' || block")}, block) - tokens AS before FROM blocks),
found AS (
  SELECT d.doc_id, d.source, d.n_tokens, weight, passes, rest - before AS room,
    CASE WHEN before + tokens <= rest THEN 1 WHEN before < rest THEN 2 ELSE 0 END AS take
  FROM docs d JOIN placed USING (source, block)),
cut AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY {md5("'document:' || doc_id")}, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM found WHERE take = 2)
SELECT doc_id, source, unnest(range(0, passes + (take = 1)::BIGINT)) AS pass, n_tokens::BIGINT AS n_tokens, round(weight, 9) AS weight FROM found
UNION ALL
SELECT doc_id, source, passes, n_tokens::BIGINT, round(weight, 9) FROM cut WHERE upto <= room
"""
