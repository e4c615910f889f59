"""Exact top-k inner products by a three-phase uniform threshold.

The score of a pair is the sum of ``LISTS`` local scores, one for each group of
dimensions (the scheme of Cao and Wang 2004; groups are of equal size, the dimensions
with the most energy in the queries come first).

1. Each partition of candidates leads with one list, gathers for every query the ``k`` + 1
   best of its local scores, and resolves those few exactly.  The k-th best of a query's
   resolved scores is a safe cutoff, since at least k candidates reach it.
2. Every partition learns the cutoffs and collects the sufficient entries, list by list:
   after each list an entry stays only if its partial score and what its other lists can
   add at most (by the norms of the remaining dimensions) reach the cutoff.  While many
   stay a list is one matrix product; once few do, only their products are formed.
3. Entries that are left after the last list have their exact scores; each partition keeps
   its k best of them (ties to the smaller id), whose union holds the k best of all.

Queries are every row whose id divides by ``QUERY_STEP``.  They lie in blocks of about
``QUERY_BLOCK`` in the shared folder, one file each, and so do the cutoffs; each task
holds one chunk of candidates and one block at a time, so the number of jobs doesn't
depend on the number of queries and nothing is gathered on the driver.

Components are floor(256 x).  Sums are exact: in double precision while they are provably
below 2^53, in whole numbers of any size beyond; a score outside 64 bits is given as the
nearest long, and such scores are ties.  Nulls and edge cases: vectors that are null or
hold null or non-finite components take no part, nor do rows with a null id; a shorter
vector counts as padded with zeros; a candidate with the query's own id is left out;
repeated ids are separate candidates, but of rows that repeat a query's id one (the
smallest vector) is asked; fewer than k candidates give fewer rows; an empty table gives
none; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import common
from weft.llm.eliasfano import pack, unpack
from weft.llm.lm import read_file, write_file

K = 5
LISTS = 8
QUERY_STEP = 50
#: Queries of a block, about.
QUERY_BLOCK = 20_000
#: Candidates that a task holds at a time.
CHUNK = 65_536
#: Candidates, and queries, multiplied at once.
ROWS = 2_048
QUERIES = 512
#: Share of pairs below which products are formed pair by pair.
FEW = 0.05
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_MOST = 1.7976931348623157e308
_ROW = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """``id, v``: floor(256 x) of every usable vector, in double precision (exact: a double from 2^53 on is whole)."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & usable)
        # from 2^45 on 256 x is whole; where it is no double it stays the largest one
        .select("id", F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 45), F.floor(x * 256).cast("double")).otherwise(F.greatest(F.least(x * 256, F.lit(_MOST)), F.lit(-_MOST)))).alias("v"))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros (or cut) to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    sizes = np.diff(bounds)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], sizes)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def _whole(matrix: np.ndarray) -> np.ndarray:
    """Components as Python's whole numbers."""
    return np.array([int(x) for x in matrix.ravel().tolist()], object).reshape(matrix.shape)


class Queries:
    """A block of queries, cut into ``LISTS`` groups of dimensions."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        order = np.argsort(-np.square(matrix / max(float(np.abs(matrix).max(initial=0)), 1.0)).sum(0), kind="stable")
        self.groups = [g for g in np.array_split(order, LISTS) if len(g)] or [np.zeros(0, np.int64)]
        self.largest = float(np.abs(matrix).max(initial=0))

    def fits(self, rows: np.ndarray) -> bool:
        """Whether every sum of products, in whatever order, is exact in double precision."""
        return self.largest * float(np.abs(rows).max(initial=0)) * max(1, self.matrix.shape[1]) < _EXACT

    def resolve(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole scores of queries with as many candidate vectors."""
        return np.einsum("ij,ij->i", self.matrix[query], rows)


class Counts:
    """What a search did: pairs met, and local scores formed in the second phase (``LISTS`` a pair at most)."""

    def __init__(self, spark) -> None:
        self.pairs, self.formed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)


class _Best:
    """The k best ``(score, id)`` of each query so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.parts.append((query, score.astype(np.int64), ident))
        self.waiting += len(query)
        if self.waiting > 1 << 20:
            self._merge()

    def _merge(self) -> None:
        query, score, ident = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ident, ~score, query))  # ~ turns the order round without overflow
        query, score, ident = query[order], score[order], ident[order]
        first = np.searchsorted(query, query)  # rank inside the query
        top = np.arange(len(query)) - first < self.k
        self.parts = [(query[top], score[top], ident[top])]
        self.waiting = 0

    def result(self, queries: Queries) -> pa.RecordBatch:
        self.parts.append((np.zeros(0, np.int64),) * 3)
        self._merge()
        query, score, ident = self.parts[0]
        return pa.record_batch([pa.array(queries.ids[query]), pa.array(ident), pa.array(score)], ["query_id", "vec_id", "score"])


# ---- blocks of queries in the shared folder -----------------------------------


def _stored(base: str, kind: str, value: str):
    """Writes each block (rows sorted by ``block``, then id) as one file; reports its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, current = [], [], None

        def close() -> None:
            table = pa.Table.from_batches(held)
            ids, column = table.column("id").to_numpy(), table.column(value).combine_chunks()
            if kind == "q":
                width = max(1, int(np.diff(column.offsets.to_numpy()).max(initial=0)))
                parts = {"ids": ids, "v": _matrix(column, width).ravel(), "width": np.array([width])}
            else:
                parts = {"ids": ids, "v": column.to_numpy(zero_copy_only=False)}
            write_file(base, f"{kind}-{current}", pack(parts))
            done.append(current)

        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if block[a] != current and held:
                    close()
                    held = []
                current = int(block[a])
                held.append(batch.slice(a, b - a))
        if held:
            close()
        yield pa.record_batch([pa.array(done, pa.int64())], ["block"])

    return run


@lru_cache(2)
def _queries(base: str, block: int) -> Queries | None:
    raw = read_file(base, f"q-{block}")
    if raw is None:
        return None
    parts = unpack(raw)
    return Queries(parts["ids"], parts["v"].reshape(-1, int(parts["width"][0])))


@lru_cache(2)
def _cutoffs(base: str, block: int) -> np.ndarray:
    """The cutoff of each query of a block; lowest where fewer than k were resolved."""
    out = np.full(len(_queries(base, block).ids), -_LONG - 1, np.int64)
    raw = read_file(base, f"c-{block}")
    if raw is not None:
        parts = unpack(raw)
        out[np.searchsorted(_queries(base, block).ids, parts["ids"])] = parts["v"]
    return out


# ---- the phases --------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(at, CHUNK))
            n += held[-1].num_rows
            if n >= CHUNK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _pieces(base: str, blocks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Queries, Iterator[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """For each chunk of candidates and block of queries: pieces ``(first query, end query, ids, rows)``."""
    for table in _chunks(batches):
        ids, column = table.column("id").to_numpy(), table.column("v").combine_chunks()
        for block in range(blocks):
            queries = _queries(base, block)
            if queries is None:
                continue
            rows = _matrix(column, queries.matrix.shape[1])

            def pieces(queries: Queries = queries, rows: np.ndarray = rows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
                for at in range(0, len(ids), ROWS):
                    for low in range(0, len(queries.ids), QUERIES):
                        yield low, min(low + QUERIES, len(queries.ids)), ids[at : at + ROWS], rows[at : at + ROWS]

            yield block, queries, pieces()


def _exact_scores(queries: Queries, low: int, high: int, rows: np.ndarray) -> np.ndarray:
    """All scores of a piece whose sums may pass 2^53, clipped to longs."""
    product = _whole(queries.matrix[low:high]).dot(_whole(rows).T)
    return np.clip(product, -_LONG - 1, _LONG).astype(np.int64)


def _first_phase(base: str, blocks: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = 0
        for _, queries, pieces in _pieces(base, blocks, batches):
            best = _Best(k)
            for low, high, ids, rows in pieces:
                if not queries.fits(rows):
                    score = _exact_scores(queries, low, high, rows)
                    at = np.nonzero(ids[None, :] != queries.ids[low:high, None])
                    best.add(low + at[0], score[at], ids[at[1]])
                    continue
                group = queries.groups[lead % len(queries.groups)]
                lead += 1  # the next piece leads with the next list
                local = queries.matrix[low:high][:, group] @ rows[:, group].T
                # the query's own row may take a place in the list, so one more is gathered
                tops = np.argpartition(-local, min(k, local.shape[1] - 1), axis=1)[:, : k + 1]
                own = np.nonzero(ids[tops] != queries.ids[low:high, None])
                query, row = low + own[0], tops[own]
                best.add(query, queries.resolve(query, rows[row]), ids[row])
            yield best.result(queries)

    return run


def _last_phases(base: str, blocks: int, k: int, counts: Counts | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, queries, pieces in _pieces(base, blocks, batches):
            best, cutoffs = _Best(k), _cutoffs(base, block)
            # norms of what is left after each list, a little enlarged against rounding
            rest = [np.linalg.norm(queries.matrix[:, np.concatenate(queries.groups[n + 1 :])], axis=1) * (1 + 1e-9) if n + 1 < len(queries.groups) else np.zeros(len(queries.ids)) for n in range(len(queries.groups))]
            pairs = formed = 0
            for low, high, ids, rows in pieces:
                if not queries.fits(rows):
                    score = _exact_scores(queries, low, high, rows)
                    at = np.nonzero((score >= cutoffs[low:high, None]) & (ids[None, :] != queries.ids[low:high, None]))
                    best.add(low + at[0], score[at], ids[at[1]])
                    continue
                own = cutoffs[low:high].astype(float)
                pairs += (high - low) * len(ids)
                # dense: some of the queries with some of the rows; sparse: pairs of their own
                dense_q, dense_r = np.arange(high - low), np.arange(len(ids))
                total = np.zeros((high - low, len(ids)))
                at, score = (np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0)
                for n, group in enumerate(queries.groups):
                    q, r = queries.matrix[low:high][:, group], rows[:, group]
                    more_q = rest[n][low:high]
                    more_r = np.linalg.norm(rows[:, np.concatenate(queries.groups[n + 1 :])], axis=1) if n + 1 < len(queries.groups) else np.zeros(len(rows))
                    if len(at[0]):
                        score = score + np.einsum("ij,ij->i", q[at[0]], r[at[1]])
                        formed += len(score)
                        stays = score + more_q[at[0]] * more_r[at[1]] >= own[at[0]] - 1e-6
                        at, score = (at[0][stays], at[1][stays]), score[stays]
                    if len(dense_q):
                        total = total + q[dense_q] @ r[dense_r].T
                        formed += total.size
                        stays = total + more_q[dense_q, None] * more_r[dense_r] >= own[dense_q, None] - 1e-6
                        few = np.count_nonzero(stays, axis=1) <= FEW * len(ids)
                        if n + 1 == len(queries.groups):
                            few[:] = True
                        x, y = np.nonzero(stays & few[:, None])
                        at, score = (np.append(at[0], dense_q[x]), np.append(at[1], dense_r[y])), np.append(score, total[x, y])
                        some = stays[~few].any(0)
                        dense_q, dense_r, total = dense_q[~few], dense_r[some], total[~few][:, some]
                kept = (score >= own[at[0]]) & (ids[at[1]] != queries.ids[low + at[0]])
                best.add(low + at[0][kept], score[kept], ids[at[1][kept]])
            if counts is not None:
                counts.pairs.add(pairs)
                counts.formed.add(formed)
            yield best.result(queries)

    return run


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, counts: Counts | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best candidates (columns ``vec_id`` and ``embedding``)."""
    spark = vectors.sparkSession
    rows = common.written(quantised(vectors), "vectors")
    asked = rows.where(F.col("id") % step == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-rows.where(F.col("id") % step == 0).count() // QUERY_BLOCK))
    base = common.new_path(spark, "queries")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")

    def stored(df: DataFrame, kind: str, value: str) -> None:
        dealt = df.select(block, "id", value).repartition(min(blocks, 1 << 14), "block").sortWithinPartitions("block", "id")
        dealt.mapInArrow(_stored(base, kind, value), "block long").count()

    stored(asked, "q", "v")
    best_first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    gathered = rows.mapInArrow(_first_phase(base, blocks, k), _ROW).withColumn("r", F.row_number().over(best_first))
    stored(gathered.where(F.col("r") == k).select(F.col("query_id").alias("id"), "score"), "c", "score")
    entries = rows.mapInArrow(_last_phases(base, blocks, k, counts), _ROW)
    ranked = entries.withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
