"""What an import leaves behind in files: entities, batches, matrices with schema names, reference data.

All are written by Spark's own writers, so a task that is repeated writes the same rows
and a folder is whole once it has its ``_SUCCESS``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import entities, joins
from weft.plans.config import Job
from weft.sources import delimited


def job_name(job: Job) -> str:
    """A name for a job's files that depends on the job alone."""
    return f"{job.kind}-{hashlib.sha256(json.dumps(asdict(job), sort_keys=True, default=str).encode()).hexdigest()[:16]}"


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def write_entities(frames: Mapping[str, DataFrame], folder: str, resume: bool = False) -> list[str]:
    """Each named frame of entities under ``folder``; with ``resume`` those that are there in whole stay. Returns what was written."""
    done = []
    for name, frame in frames.items():
        if not (resume and exists(frame.sparkSession, f"{folder}/{name}/_SUCCESS")):
            frame.write.mode("overwrite").parquet(f"{folder}/{name}")
            done.append(name)
    return done


def write_batches(frame: DataFrame, folder: str, import_name: str, order: list, size: int = entities.BATCH, within: tuple[str, ...] = (), part: Column | None = None) -> DataFrame:
    """Rows in batches: ``tx_id`` and ``import`` stand beside each row; the files are read back."""
    numbered = entities.batches(frame, order, size, within, "_batch", part)
    place = F.concat_ws("/", F.lit(import_name), *[F.coalesce(F.col(w).cast("string"), F.lit("")) for w in within], F.col("_batch").cast("string"))
    numbered.withColumns({"tx_id": F.sha2(place, 256), "import": F.lit(import_name)}).drop("_batch").write.mode("overwrite").parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def write_reference(frame: DataFrame, folder: str, size: int = 100) -> DataFrame:
    """Distinct rows in batches of ``size``, in an order that depends on the rows alone."""
    rows = frame.distinct()
    key = F.xxhash64(*rows.columns)
    parts = F.shiftright(key, 52)  # even ranges of the order, since the key is a hash
    entities.batches(rows.withColumn("_key", key), ["_key", *frame.columns], size, (), "batch", parts).drop("_key").write.mode("overwrite").parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def write_matrix(spark: SparkSession, source: str, target: str, names: Mapping[str, str], constants: Mapping[str, object] | None = None, separator: str = "\t") -> None:
    """A matrix file with columns renamed by exact name and constant columns added at the end."""
    header = delimited.header(spark, source, separator)
    rows = joins.renamed(delimited.native(spark, source, header, separator).drop(delimited.BAD), names)
    rows = rows.select("*", *[F.lit(v).cast("string").alias(c) for c, v in (constants or {}).items()])
    rows.write.mode("overwrite").option("sep", separator).option("header", True).option("emptyValue", "").csv(target)
