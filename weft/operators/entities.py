"""Merging, batching and history of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BATCH = 50


def upsert_merge(rows: DataFrame, key: Sequence[str], one: Sequence[str], many: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Rows of one key as one entity.

    Attributes of one value take the last that is there, in ``order``; attributes of
    many values gather a set.  Partial aggregates meet in the shuffle, so a key with
    any number of rows is no list anywhere but for the values it keeps.
    """
    last = F.struct(*order)
    picked = [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), last)).alias(a) for a in one]
    gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in many]
    return rows.groupBy(*key).agg(*picked, *gathered)


def conflicts(rows: DataFrame, key: Sequence[str], one: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree on an attribute of one value, with the number of values."""
    counts = [F.count_distinct(a).alias(a) for a in one]
    found = rows.groupBy(*key).agg(*counts)
    return found.where(" OR ".join(f"`{a}` > 1" for a in one))


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; ties go to the greatest whole row."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("_last"))
    return best.select(*key, "_last.*")


def ranked(rows: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (), part: Column | None = None, name: str = "rank") -> DataFrame:
    """Number rows from 0 in a fixed order inside each ``within``.

    ``part`` cuts the order into ranges: a number that never falls as the order goes on
    (a line number divided by a range's size, say).  Rows are ranked inside their range
    and ranges by their counts, so no partition holds all rows of one ``within``.
    """
    part = F.lit(0) if part is None else part
    rows = rows.withColumn("_part", F.coalesce(part.cast("long"), F.lit(-1)))
    inside = F.row_number().over(W.partitionBy(*within, "_part").orderBy(*order)) - 1
    sizes = rows.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(w).alias(f"_w{k}") for k, w in enumerate(within)], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k, w in enumerate(within):
        same = same & F.col(w).eqNullSafe(F.col(f"_w{k}"))
    numbered = rows.withColumn("_inside", inside).join(sizes, same)
    return numbered.withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part", "_p", *[f"_w{k}" for k in range(len(within))])


def batches(rows: DataFrame, order: Sequence[Column | str], size: int = BATCH, within: Sequence[str] = (), name: str = "batch", part: Column | None = None) -> DataFrame:
    """Number rows in a fixed order and cut them into batches, file by file (``within``); ``part`` as in ``ranked``."""
    if not 1 <= size:
        raise ValueError("a batch has at least one row")
    return ranked(rows, order, within, part, name).withColumn(name, F.floor(F.col(name) / size))


def batch_id(import_name: Column | str, file: Column | str, batch: Column) -> Column:
    """A transaction id that a retry makes again."""
    parts = [F.lit(x) if isinstance(x, str) else x for x in (import_name, file)]
    return F.sha2(F.concat_ws("/", *parts, batch.cast("string")), 256)


def not_committed(rows: DataFrame, ledger: DataFrame, key: str = "tx_id") -> DataFrame:
    """Rows of batches that the ledger doesn't hold."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def current(datoms: DataFrame) -> DataFrame:
    """What is true now: assertions whose latest mention of (e, a, v) is an assertion."""
    latest = datoms.groupBy("e", "a", "v").agg(F.max_by("added", "tx").alias("added"))
    return latest.where("added").select("e", "a", "v")


def retractions(datoms: DataFrame, first: int, last: int, tx: int) -> DataFrame:
    """What takes back all that was asserted between two transactions."""
    asserted = datoms.where(F.col("tx").between(first, last) & F.col("added"))
    return asserted.select("e", "a", "v").distinct().select("e", "a", "v", F.lit(tx).cast("long").alias("tx"), F.lit(False).alias("added"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def union_kinds(*kinds: DataFrame) -> DataFrame:
    """Entities of several kinds in one frame; attributes that a kind lacks are null."""
    out = kinds[0]
    for kind in kinds[1:]:
        out = out.unionByName(kind, allowMissingColumns=True)
    return out
