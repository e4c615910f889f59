"""A training-corpus pipeline: five stages, each of which calls one operator.

Each stage takes ``(spark, docs, sf_dir)``, works on every row that the stage before it
kept, and its result is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.

Decisions belong to rows, not to ids: a stage gives rows a key of their own, so rows with null or repeated ids are judged like any
other, each by its own text.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common, exact, mixing, pieces, simhash, toxicity

#: Documents with at least this probability of being toxic go.
TOXIC = 0.7
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    common.release(docs.sparkSession)
    return common.keyed(docs, COLUMNS, "rows")


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Keyed documents but those whose key is among ``rejected`` (one column, ``row``); texts move only where those are many."""
    return rows.join(common.if_small(common.written(rejected, "rejected")), "row", "left_anti").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents (operator 1, learnt from the labels outside its held-out fold)."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), common.fold("_id", 3) != 1)
    rows = _keyed(docs)
    return _without(rows, toxicity.score(rows, model, ["row"]).where(F.col("score") >= TOXIC).select("row"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of equal texts, the one with the smallest id (operator 9)."""
    rows = _keyed(docs)
    return _without(rows, exact.duplicates(rows, "row").where(~F.col("kept")).select("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group whose texts are linked by a similarity of their word 5-shingles of 0.8 or more (operator 5)."""
    rows = _keyed(docs)
    grouped = common.written(simhash.similar(rows).join(rows.select("row", "doc_id"), "row"), "near-groups")
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row"))
    return _without(rows, grouped.select("row").join(first, "row", "left_anti"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents as the mix takes them (operator 7).

    The schedule takes a document's words a whole number of times, but for the few at a
    block border; those are rounded to whole copies.  Documents without words stay once.
    """
    rows = _keyed(docs)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    taken = common.written(mixing.mix(rows, "row").select("row", copies.alias("copies")).where("copies > 0"), "copies")
    return rows.join(common.if_small(taken), "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document and check the way back (operator 4)."""
    return pieces.round_trip(docs, pieces.default_model()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: The learned and the tokenising stage are beyond SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
