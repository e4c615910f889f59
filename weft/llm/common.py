"""What the training-data operators share: folds, samples, shared tables and text blocks.

Text reaches numpy as the raw UTF-8 buffer of an Arrow column.  ``blocks`` cuts a
record batch into pieces of bounded size at row boundaries and ``hash_words`` turns
every word of a piece into a 64-bit hash without building a Python object per word.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once; one longer text is its own piece.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes lower-cased, A-Z only.
_LOW = np.arange(256, dtype=np.uint64)
_LOW[ord("A") : ord("Z") + 1] += 32
#: Places of a word whose hash values are tabulated; later places are computed.
_PLACES = 48


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _placed(octets: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A number for each (byte, place in its word), as good as drawn at random."""
    return mix(((place.astype(np.uint64) << np.uint64(8)) | _LOW[octets]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64)))


@cache
def _place_table(seed: int) -> np.ndarray:
    table = _placed(np.tile(np.arange(256), _PLACES), np.repeat(np.arange(_PLACES), 256), seed)
    table[np.tile(_SPACE, _PLACES)] = 0
    return table


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; on a cluster, whose
    machines would not see that, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A table of few columns, hinted for broadcast only where it was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left: Spark's cleaner drops shuffles and broadcasts once the driver has collected their handles."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` and a unique ``row``, which stays with its row whatever ids repeat or are null.

    A scan of Parquet files is keyed by each row's file and place in it; anything else is
    written once, with a key, since its rows have no place of their own.
    """
    try:
        placed = docs.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
        paths = placed.select("_path").distinct()
        placed.schema  # noqa: B018  (fails here if there is no file behind a row)
    except AnalysisException:
        return written(docs.select(*columns, F.monotonically_increasing_id().alias("row")), name)
    numbers = F.row_number().over(Window.orderBy("_path")) - 1  # one row a file
    files = written(paths.select("_path", numbers.cast("long").alias("_file")), "files")
    row = F.shiftleft("_file", 40) + F.col("_at")  # files of up to 2^40 rows
    return placed.join(if_small(files, 100_000), "_path").select(*columns, row.alias("row"))


def fold(id_column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id (in no held-out fold)."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string")) % modulus, F.lit(-1))


def unit(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)).cast("double") / float(1 << 53)


def sample_rows(df: DataFrame, keys: Sequence[str], bound: int, seed: int = 0) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``keys`` (all rows if there are fewer); rows that agree in them go together."""
    rows = df.select(F.lit(1)).count()
    return df if rows <= bound else df.where(unit(*map(F.col, keys), seed=seed) < bound / rows)


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, name: str) -> DataFrame:
    """``(id, text, label)`` of about ``bound`` labelled documents, written once.

    ``keep`` is a condition on ``doc_id``.  The side that is broadcast holds the
    chosen labels only: ``bound`` rows of an id and a flag, whatever the input.  Of
    documents that repeat an id one teaches (the one with the smallest text), so the
    result has no more rows than labels were chosen.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(
        keep & F.col("_id").isNotNull() & F.col("label").isNotNull()
    )
    chosen = sample_rows(chosen, ["_id"], bound).groupBy("_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return written(found.select(F.col("_id").alias("id"), "text", "label"), name)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets from 0)`` for runs of rows of about ``size`` bytes."""
    raw, bounds = utf8(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def find_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each row's first word (one more entry than rows)."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word, lower-cased A-Z; the same word has the same hash everywhere.

    Each byte in its place has a number of its own and a word's hash is their sum.
    """
    table = _place_table(seed)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        first, high = starts[at:end], int(ends[end - 1])
        sizes = np.diff(np.append(first, high))
        place = np.arange(high - low, dtype=np.int32) - np.repeat((first - low).astype(np.int32), sizes)
        octets = data[low:high]
        late = np.flatnonzero(place >= _PLACES) if sizes.max() > _PLACES else place[:0]
        whole = place[late]
        place[late] = 0
        values = table[(place << 8) + octets]
        if len(late):
            values[late] = np.where(_SPACE[octets[late]], 0, _placed(octets[late], whole, seed))
        out[at:end] = np.add.reduceat(values, first - low)
        at = end
    return mix(out)


def map_texts(df: DataFrame, columns: list[Column], function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over just ``columns``; other columns of ``df`` can't clash."""
    return df.select(*columns).mapInArrow(function, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
