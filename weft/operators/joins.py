"""Joins that references, validation and queries come down to.

Reference tables are joined without a hint: Catalyst broadcasts them while their
measured size is below the session's threshold, and shuffles beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(facts: DataFrame, key: str, reference: DataFrame, reference_key: str, columns: Sequence[str]) -> DataFrame:
    """Facts with the columns of the entity that their natural key names; null where there is none."""
    right = reference.select(F.col(reference_key).alias("_key"), *columns)
    return facts.join(right, F.col(key) == F.col("_key"), "left").drop("_key")


def dangling(facts: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """Facts whose reference names no entity (a null reference names nothing and dangles not)."""
    right = reference.select(F.col(reference_key).alias("_key")).distinct()
    return facts.where(F.col(key).isNotNull()).join(right, F.col(key) == F.col("_key"), "left_anti")


def existing(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of the left whose key is on the right."""
    return left.join(right.select(F.col(right_key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_semi")


def relation_input(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows given with a query; they come from the caller, so their size is the caller's."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def any_of(*branches: DataFrame) -> DataFrame:
    """Disjunction: the distinct bindings of any branch."""
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out.distinct()


def hop(start: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Chained equi joins: each step is ``(table, key so far, key of the table)``."""
    for table, left, right in steps:
        start = start.join(table, start[left] == table[right])
    return start


def pull(parents: DataFrame, key: str, children: DataFrame, child_key: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with their children nested as a sorted list of structs (an empty list where there are none)."""
    nested = children.groupBy(F.col(child_key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    empty = F.array().cast(nested.schema[name].dataType)
    return parents.join(nested, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, empty))


def referencing(children: DataFrame, fk: str, child_key: str, limit: int = 10, lanes: int = 64) -> DataFrame:
    """The first ``limit`` entities that refer to each target.

    A target's children are ranked lane by lane first, so that one which a third of all
    rows refer to is no list and no partition of its own.
    """
    pairs = children.where(F.col(fk).isNotNull()).select(F.col(fk).alias("target"), F.col(child_key).alias("_child")).distinct()
    pairs = pairs.withColumn("_lane", F.pmod(F.xxhash64("_child"), F.lit(lanes)))
    for by in (["target", "_lane"], ["target"]):
        pairs = pairs.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy("_child"))).where(F.col("_rank") <= limit)
    return pairs.groupBy("target").agg(F.array_sort(F.collect_list("_child")).alias("referencing"))


def map_by_table(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Value mapping from a table ``(raw, canonical)``; ``_error`` is filled where a value has no entry."""
    joined = df.join(table.select(F.col("raw").alias("_raw"), "canonical"), F.col(column) == F.col("_raw"), "left")
    missing = F.col(column).isNotNull() & F.col("_raw").isNull()
    return joined.withColumn("_error", F.when(missing, F.concat(F.lit("no mapping for "), F.col(column).cast("string")))).drop("_raw")


def upsert_conflicts(incoming: DataFrame, stored: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Rows whose key is stored with another value: one row for each attribute that differs.

    Attributes that the incoming row doesn't bring change nothing and are not compared.
    """
    old = stored.select(F.col(key).alias("_key"), *[F.col(a).alias(f"_old_{a}") for a in attributes])
    both = incoming.join(old, F.col(key) == F.col("_key"))
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"_old_{a}").cast("string").alias("old"), F.col(a).cast("string").alias("new")) for a in attributes])
    found = both.select(F.col(key).cast("string").alias("key"), F.explode(pairs).alias("_p")).select("key", "_p.*")
    return found.where(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed by exact name; a name that isn't there is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
