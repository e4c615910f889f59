"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Each document's white-space-normalised text becomes a digest (SHA-256) and a check
(XXH64 and byte length), by which equal digests are verified at every level: rows of one
digest whose checks differ never meet.  Documents are dealt by position, not by content,
over lanes of about ``LANE_ROWS`` rows each.

* A lane's run is its distinct digests in order, each with its smallest identifier and
  its count.  Runs are made by sorting, and by walking what is sorted.
* In round r lane n sends its run to lane n - n mod FAN^r (a k-nomial tree): the runs
  that meet are merged by digest, equal neighbours become one entry with the smallest
  identifier and the sum of counts, and after log_FAN(lanes) rounds one run is left.
* On the way back the winner of each digest goes to the lanes that hold it and from
  there to the documents, which are joined by digest *and* lane.

A run is spread over tasks by digest at every level, so no task holds a whole run, and a
digest that a third of all rows share meets at most ``FAN`` entries of it in any merge,
and at most ``LANE_ROWS`` rows in any join.

Nulls and edge cases: a null text is empty, and all empty texts are one group; a text
of white space alone is one space and another group; a null id is never the smallest
while its group has another (a group of null ids alone keeps a null ``keep_id`` and
keeps every one of its rows); a repeated id gives one row each, and all rows that
carry the smallest id are kept.  Where rows have a key of their own (``row``) one row of
each group is kept, the smallest by id and then by key.  An empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import common

#: Rows of a lane, about.
LANE_ROWS = 32_768
#: Runs that one merge takes.
FAN = 8
_SPACE = "[\\x20\\x09-\\x0D]+"
_KEY = ["digest", "check", "length"]


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def digests(docs: DataFrame, lanes: int, row: str | None = None) -> DataFrame:
    """``id, row, lane`` and the digest, check and length of each row's normalised text.

    The lane is drawn by where the row stands; the result is to be written once, not computed twice.
    """
    key = F.lit(None).cast("long") if row is None else F.col(row)
    return docs.select(F.col("doc_id").alias("id"), key.alias("row"), normalised(F.col("text")).alias("t")).select(
        "id",
        "row",
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int").alias("lane"),
        F.sha2("t", 256).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("length"),
    )


def _merged(entries: DataFrame) -> DataFrame:
    """One entry for each lane's digest: entries are sorted, and of equal neighbours the first stays, with the count of all."""
    equal = W.partitionBy("lane", *_KEY).orderBy("smallest")
    first = entries.withColumn("n", F.sum("n").over(equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn("nth", F.row_number().over(equal))
    return first.where("nth = 1").drop("nth")


def runs(marked: DataFrame) -> DataFrame:
    """Each lane's run ``(digest, check, length, lane, smallest, n)``; ``smallest`` sorts by whether there is an id, id and row."""
    own = F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("smallest")
    return _merged(marked.select(*_KEY, "lane", own, F.lit(1).cast("long").alias("n")))


def tree_merge(run: DataFrame, lanes: int) -> DataFrame:
    """Merge the runs of ``lanes`` lanes in rounds of ``FAN`` until lane 0 holds all."""
    step = FAN
    while step < lanes * FAN:
        run = _merged(run.withColumn("lane", F.expr(f"lane - lane % {step}")))
        step *= FAN
    return run


def duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns ``doc_id`` and ``text``): ``id, row, keep_id, group_size, kept, digest``."""
    lanes = max(1, -(-docs.select("doc_id").count() // LANE_ROWS))
    marked = common.written(digests(docs, lanes, row), "digests")
    first = common.written(runs(marked), "runs")
    winners = tree_merge(first, lanes).select(*_KEY, F.col("smallest").alias("winner"), F.col("n").alias("group_size"))
    by_lane = first.select(*_KEY, "lane").join(winners, _KEY)
    kept = F.col("id").eqNullSafe(F.col("winner.id")) & F.col("row").eqNullSafe(F.col("winner.row"))
    return marked.join(by_lane, [*_KEY, "lane"]).select("id", "row", F.col("winner.id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def op9_exact(spark, sf_dir: str) -> DataFrame:
    return duplicates(common.documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


#: White space is written out: DuckDB's \\s differs.
OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
