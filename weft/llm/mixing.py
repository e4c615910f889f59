"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets.  Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share
the sum of all sizes.  A target stops at ``MAX_REPEATS`` times its source's size and the
excess goes to the others by weight: target = min(cap, level * weight), where ``level``
is found by sorting the sources by cap / weight.

Schedule.  The mix is a list of slots of ``block`` words.  Slot n takes the golden-ratio
point frac((n + 1) * 0.618...), and the cumulative target shares map the point to a
source.  The k-th slot of a source takes the k-th block of its shuffled word stream,
and starts over when the stream ends, until the source's target is reached; the few
slots that a source is short of (low discrepancy keeps it to the logarithm of their
number) are appended.  Documents lie in a source's stream in the order of a hash, so a
document is taken as often as the slots cover it.

No window runs over a whole source: ranks and running sums are two-level (inside hash
or slot ranges of bounded size, then over the ranges), so a source with a third of all
rows is spread like any other.  Only the table of sources is ordered as a whole.

Nulls and edge cases: a null text has size 0; documents of size 0 take 0; null is a
source of its own, sorted last; repeated ids (and repeated rows) are separate documents;
a null id is allowed.  With no words at all every target and every take is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import common

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
GOLDEN = 0.6180339887498949
#: Words of a slot at most; small inputs take smaller blocks, about this many slots a source.
BLOCK_WORDS = 1024
SLOTS_A_SOURCE = 500
#: Rows that one window range holds, about.
RANGE_ROWS = 4_096
_WORD = "[^\\x20\\x09-\\x0D]++"
_BEFORE = (W.unboundedPreceding, -1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_no, source_size, weight, target, low, high`` from rows ``(source, size)``."""
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    named = named.withColumn("source_no", number).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    every = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    # the level if this source and all later ones stay under their caps
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(*_BEFORE)), F.lit(0))) / F.sum("weight").over(
        by_cap.rowsBetween(0, W.unboundedFollowing)
    )
    # which rises until the first source that stays under, and falls after it
    named = named.withColumn("level", level).withColumn("level", F.max("level").over(every))
    named = named.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    total = F.sum("target").over(every)
    upto = F.sum("target").over(W.orderBy("source_no"))
    return named.withColumn("words", F.least(F.floor("target"), F.col("cap"))).select(
        "source", "source_no", "source_size", "weight", "target", "words", F.try_divide(upto - F.col("target"), total).alias("low"), F.try_divide(upto, total).alias("high")
    )


def _block(total: int, sources: int) -> int:
    return max(1, min(BLOCK_WORDS, total // (max(1, sources) * SLOTS_A_SOURCE)))


def _running(df: DataFrame, group: str, part: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over a group's earlier rows; ``part`` splits each group into ordered ranges."""
    inside = W.partitionBy(group, part).orderBy(*order).rowsBetween(*_BEFORE)
    parts = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(W.partitionBy(group).orderBy(part).rowsBetween(*_BEFORE)), F.lit(0))).drop("_sum")
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(parts, [group, part]).withColumn(name, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")


def schedule(spark, sources: DataFrame, total: int, n_sources: int) -> DataFrame:
    """The slots: ``slot, source_no, turn`` (the source's how many-th slot, from 0) and what it takes:
    ``block, first`` (word of the stream), ``full`` (words of the block), ``taken`` (words taken of it)."""
    block = _block(total, n_sources)
    slots = -(-total // block)
    # guide table: each cell of [0, 1) lists the one or few sources whose share meets it
    cells = max(1024, 4 * n_sources)
    guide = sources.where("high > low").select(
        "source_no", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"),
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 1) * F.lit(GOLDEN)) % F.lit(1.0)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells)).withColumn("part", F.expr(f"slot div {RANGE_ROWS}"))
    placed = points.join(guide, "cell").where("u >= low AND u < high").select("slot", "part", "source_no")
    ranked = _running(placed, "source_no", "part", [F.col("slot")], F.lit(1), "turn").select("slot", "source_no", "turn")
    need = (
        sources.select("source_no", "source_size", "words")
        .withColumn("per_round", F.expr(f"(source_size + {block - 1}) div {block}"))
        .withColumn("need", F.expr(f"CASE WHEN source_size = 0 THEN 0 ELSE (words div source_size) * per_round + (words % source_size + {block - 1}) div {block} END"))
    )
    got = ranked.groupBy("source_no").agg(F.count("*").alias("got"))
    short = need.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("need > got")
    extra = short.select("source_no", F.explode(F.sequence("got", F.col("need") - 1)).alias("turn")).select(F.lit(None).cast("long").alias("slot"), "source_no", "turn")
    all_slots = ranked.unionByName(extra).join(need, "source_no").where("turn < need")
    return (
        all_slots.withColumn("block", F.expr("turn % per_round"))
        .withColumn("first", F.expr(f"block * {block}"))
        .withColumn("full", F.expr(f"least({block}, source_size - first)"))
        .withColumn("taken", F.expr("least(full, words - (turn div per_round) * source_size - first)"))
        .select("slot", "source_no", "turn", "block", "first", "full", "taken")
    )


def mix(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns ``doc_id, text, source``): ``id, row, size, source_size, target, taken``.

    ``row`` names a key by which rows can be told apart, if they have one.
    """
    spark = docs.sparkSession
    key = F.lit(None).cast("long") if row is None else F.col(row)
    sized = common.written(docs.select(F.col("doc_id").alias("id"), key.alias("row"), "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = common.written(targets(sized), "mix-sources")
    total, n_sources = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    rows = sized.count()
    block = _block(total, n_sources)
    slots = schedule(spark, sources, total, n_sources)
    blocks = slots.groupBy("source_no", "block").agg(
        F.sum(F.expr("CASE WHEN taken = full THEN 1 ELSE 0 END")).alias("times"),
        F.max(F.expr("CASE WHEN taken < full THEN taken ELSE 0 END")).alias("part"),
    )
    ranges = max(1, rows // RANGE_ROWS)
    laid = (
        sized.join(sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
        .withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / float(1 << 32) * ranges))
    )
    order = [F.col("key"), F.col("id"), F.col("size"), F.col("row")]
    laid = laid.withColumn("nth", F.row_number().over(W.partitionBy("source_no", "range").orderBy(*order)))
    laid = _running(laid, "source_no", "range", [F.col("nth")], F.col("size"), "at")
    own = ["source_no", "range", "nth", "id", "row", "size", "source_size", "target"]
    words = laid.where("size > 0").select(*own, "at", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    first, last = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    part_end = F.least(last, F.col("block") * block + F.col("part"))
    taken = words.join(blocks, ["source_no", "block"], "left").withColumn(
        "taken", F.coalesce(F.col("times") * (last - first) + F.greatest(part_end - first, F.lit(0)), F.lit(0))
    )
    none = laid.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    taken = taken.groupBy(*own).agg(F.sum("taken").alias("taken"))
    return taken.unionByName(none).select("id", "row", "size", "source_size", "target", "taken")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, 3 * source_size AS cap FROM s0
), s2 AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1
), s3 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s2
), s4 AS (
  SELECT *, least(cap::DOUBLE, max(l) OVER () * w) AS target FROM s3
), s5 AS (
  SELECT *, least(floor(target)::BIGINT, cap) AS words, (sum(target) OVER (ORDER BY no) - target) / nullif(sum(target) OVER (), 0) AS low,
    sum(target) OVER (ORDER BY no) / nullif(sum(target) OVER (), 0) AS high FROM s4
), p AS (
  SELECT coalesce(sum(source_size), 0)::BIGINT AS total, greatest(1, least(1024, coalesce(sum(source_size), 0)::BIGINT // (greatest(1, count(*)) * 500))) AS block FROM s5
), pts AS (
  SELECT n AS slot, ((n + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM p, unnest(range((total + block - 1) // block)) r(n)
), ranked AS (
  SELECT no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS turn FROM pts JOIN s5 ON u >= low AND u < high
), need AS (
  SELECT no, source_size, words, (source_size + block - 1) // block AS per_round,
    CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * ((source_size + block - 1) // block) + (words % source_size + block - 1) // block END AS need FROM s5, p
), turns AS (
  SELECT no, turn FROM ranked
  UNION ALL SELECT no, unnest(range(got, need)) FROM (SELECT no, need, (SELECT count(*) FROM ranked r WHERE r.no = need.no) AS got FROM need) WHERE need > got
), slots AS (
  SELECT no, turn % per_round AS b, least(block, source_size - (turn % per_round) * block) AS full_len,
    least(block, source_size - (turn % per_round) * block, words - (turn // per_round) * source_size - (turn % per_round) * block) AS taken
  FROM turns JOIN need USING (no), p WHERE turn < need
), blocks AS (
  SELECT no, b, sum(CASE WHEN taken = full_len THEN 1 ELSE 0 END) AS times, max(CASE WHEN taken < full_len THEN taken ELSE 0 END) AS part FROM slots GROUP BY ALL
), laid AS (
  SELECT doc_id, d.size, s5.no, source_size, target, row_number() OVER () AS rid,
    coalesce(sum(size) OVER (PARTITION BY no ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
), cut AS (
  SELECT rid, no, a, size, unnest(range(a // block, (a + size - 1) // block + 1)) AS b FROM laid, p WHERE size > 0
), took AS (
  SELECT rid, sum(times * (least(a + size, (b + 1) * block) - greatest(a, b * block))
    + greatest(least(a + size, (b + 1) * block, b * block + part) - greatest(a, b * block), 0)) AS taken
  FROM cut JOIN blocks USING (no, b), p GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(took.taken, 0)::BIGINT AS taken FROM laid LEFT JOIN took USING (rid)
"""
