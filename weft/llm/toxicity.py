"""Toxicity by maximum-scoring segment search.

Every word gets a log-odds score: how much likelier toxic than clean documents are to
hold it, under Beta (two-cell Dirichlet) priors that back off from the word to its
first six bytes, to its first four bytes, to the overall share.  A linear-time scan
finds *all* maximal-scoring segments of the word scores (Ruzzo and Tompa 1999).
Their scores are judged against the extreme-value law of the best segment in clean
text (Karlin and Altschul 1990): E = K n exp(-lambda S).  The evidence of a document
is the sum of -log E over its significant segments; a logistic curve fitted on the
learning rows turns it into a probability.

Nulls and edge cases: a null or empty text, or one of white space, has no segment and
gets the score of no evidence; a row with a null id is scored and gives a null id;
labels that are null, or whose document is missing, teach nothing; repeated ids give
one row each.  Words are learned from three quarters of the labelled documents and the
calibration from the rest; where either part lacks a class, all of them teach both.  With
no labels of one class every score is the (Laplace) share of toxic labels, one half where
there are none at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import common

#: Learning rows at most (about); bounds the vocabulary sent to the driver too.
FIT_ROWS = 20_000
#: Words and stems seen less often than this in the learning rows back off.
MIN_COUNT = 4
#: Weight of the prior, in documents, at each step from stem to word.
PRIOR = 5.0
#: Standard deviations by which each log-odds is drawn back towards nought.
CAUTION = 3.0
#: Taken off each word's log-odds, so that clean text drifts down.
DRIFT = 0.2
#: Segments with an E-value above this are not reported and not counted.
MAX_E = 1.0
STEMS = (4, 6)
#: Words (one a document) that a counting task holds.
COUNTED = 500_000
SEGMENT = "struct<first_word:int,last_word:int,score:double,e_value:double>"
SCHEMA = f"id long, n_words long, evidence double, score double, segments array<{SEGMENT}>"


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of words
    scores: np.ndarray
    stem_keys: np.ndarray  # sorted hashes of stems, both lengths together
    stem_scores: np.ndarray
    scale: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0


def _stem_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    # the first n bytes of each word, hashed by a seed of their own
    out = np.zeros(len(starts), np.uint64)
    table = common._place_table(n)
    for i in range(n):
        at = np.minimum(starts + i, len(data) - 1)
        out += np.where(starts + i < ends, table[(i << 8) + data[at].astype(np.int64)], 0).astype(np.uint64)
    return common.mix(out)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    found = keys[at] == wanted
    return found, values[at]


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-odds of each word less the drift."""
    found, out = _look_up(model.keys, model.scores, common.hash_words(data, starts, ends))
    rest = np.flatnonzero(~found)
    out[rest] = 0.0
    for n in STEMS:  # the longer stem, where known, overrides
        known, score = _look_up(model.stem_keys, model.stem_scores, _stem_hash(data, starts[rest], ends[rest], n))
        out[rest[known]] = score[known]
    return out - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)``, left to right, in linear time."""
    signs = scores > 0
    if not signs.any():
        return []
    cuts = np.flatnonzero(np.diff(signs, prepend=~signs[0]))
    sums = np.add.reduceat(scores, cuts)
    totals = np.concatenate(([0.0], np.cumsum(sums)))
    lasts = np.append(cuts[1:], len(scores)) - 1
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    link: list[int] = []  # nearest earlier candidate whose left total is smaller
    for run in np.flatnonzero(sums > 0).tolist():
        low, high, begin, end = float(totals[run]), float(totals[run + 1]), int(cuts[run]), int(lasts[run])
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            low, begin = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], link[j:]
        left.append(low)
        right.append(high)
        first.append(begin)
        last.append(end)
        link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(first, last, left, right, strict=True)]


def _judged(model: Model, scores: np.ndarray) -> tuple[float, list[dict]]:
    """Evidence of one document and its significant segments."""
    space = model.k * max(len(scores), 1)
    kept, evidence = [], 0.0
    for a, b, s in maximal_segments(scores):
        e = space * float(np.exp(-model.scale * s))
        if e <= MAX_E:
            evidence -= np.log(max(e, 1e-300))
            kept.append({"first_word": a, "last_word": b, "score": s, "e_value": e})
    return float(evidence), kept


def _scored(model: Model, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Word scores of each text of a block."""
    starts, ends, rows = common.find_words(data, bounds)
    scores = word_scores(model, data, starts, ends) if len(starts) else np.zeros(0)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        yield scores[a:b]


def _documents(model: Model, column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, bounds in common.blocks(column):
        yield from _scored(model, data, bounds)


def probability(model: Model, evidence: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(model.slope * np.log1p(evidence) + model.offset)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems with the documents that hold them, by label; passed on whenever ``COUNTED`` words are held."""
    parts: dict[int, list[np.ndarray]] = {0: [], 4: [], 6: []}
    toxic: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        flags = np.concatenate(toxic) == 1
        stems = {n: np.concatenate(found) for n, found in parts.items()}
        toxic.clear()
        for n, found in stems.items():
            parts[n].clear()
            keys, first, place = np.unique(found, return_index=True, return_inverse=True)
            hit = np.bincount(place, flags, len(keys)).astype(np.int64)
            total = np.bincount(place, minlength=len(keys))
            above = [pa.array(stems[m][first].view(np.int64)) for m in STEMS]
            yield pa.record_batch(
                [pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), *above, pa.array(hit), pa.array(total - hit)],
                ["stem", "key", "stem4", "stem6", "toxic", "clean"],
            )

    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for a, b, data, bounds in common.blocks(batch.column("text")):
            starts, ends, rows = common.find_words(data, bounds)
            if not len(starts):
                continue
            hashes = common.hash_words(data, starts, ends)
            text = np.repeat(np.arange(b - a), np.diff(rows))
            order = np.lexsort((hashes, text))  # each word once a document: repeats inside one are no evidence
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
            own = order[new]
            toxic.append(labels[a:b][text[own]])
            parts[0].append(hashes[own])
            for n in STEMS:
                parts[n].append(_stem_hash(data, starts[own], ends[own], n))
            if sum(map(len, toxic)) > COUNTED:
                yield from flush()
    if toxic:
        yield from flush()


def _prior_scores(table, share: float) -> Model:
    """Log-odds of words and stems, each shrunk towards what it backs off to."""
    stem, key = table["stem"].to_numpy(), table["key"].to_numpy().view(np.uint64)
    hit, miss = table["toxic"].to_numpy().astype(float), table["clean"].to_numpy().astype(float)
    base = np.log(share / (1 - share))
    prior = {n: np.full(len(key), share) for n in (0, *STEMS)}
    lookup: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n, above in ((4, None), (6, "stem4"), (0, "stem6")):  # each level's posterior share is the next one's prior
        own = np.flatnonzero(stem == n)
        if above:
            keys, shares = lookup[int(above[-1])]
            found, values = _look_up(keys, shares, table[above].to_numpy().view(np.uint64)[own]) if len(keys) else (np.zeros(len(own), bool), np.zeros(len(own)))
            prior[n][own[found]] = values[found]
        own = own[np.argsort(key[own], kind="stable")]
        lookup[n] = key[own], (hit[own] + PRIOR * prior[n][own]) / (hit[own] + miss[own] + PRIOR)
        prior[0][own] = prior[n][own]
    a, b = hit + PRIOR * prior[0], miss + PRIOR * (1 - prior[0])
    odds = np.log(a / b) - base
    spread = np.sqrt(1 / (hit + PRIOR * share) + 1 / (miss + PRIOR * (1 - share)))  # as if it had no stem
    scores = np.sign(odds) * np.maximum(np.abs(odds) - CAUTION * spread, 0)
    out = []
    for mask in (stem == 0, stem != 0):
        order = np.argsort(key[mask], kind="stable")
        out += [key[mask][order], scores[mask][order]]
    for i in (0, 2):  # never empty, so that look-ups need no special case
        if not len(out[i]):
            out[i], out[i + 1] = np.zeros(1, np.uint64), np.zeros(1)
    return Model(*out)


def _solve_scale(scores: np.ndarray) -> float:
    """The positive root of mean(exp(x s)) = 1, for scores with a negative mean."""
    values, counts = np.unique(np.round(scores, 2), return_counts=True)
    share = counts / counts.sum()
    if not len(values) or values.max() <= 0 or (values * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 0.1
    while (share * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull towards a slope of nought."""
    w = np.array([0.0, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + 1e-2 * w * [1, 0]
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, keep=None, rows: int = FIT_ROWS) -> Model:
    """Learn from about ``rows`` labelled documents; ``keep`` is a condition on the id (``_id``)."""
    spark = docs.sparkSession
    sample = common.labelled(docs, labels, "toxic", F.lit(True) if keep is None else keep, rows, "toxic-fit")
    # three quarters teach the words, the rest the scale, so that the scale isn't judged on what it was learnt from
    rest = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    seen = {(r.label, r.rest): r["n"] for r in sample.groupBy("label", rest.alias("rest")).agg(F.count("*").alias("n")).collect()}
    parts = [[seen.get((label, own), 0) for label in (0, 1)] for own in (False, True)]
    clean, toxic = (sum(x) for x in zip(*parts, strict=True))
    if not toxic or not clean:  # nothing to tell apart
        empty = pa.table({c: pa.array([], t) for c, t in (("stem", pa.int32()), ("key", pa.int64()), ("stem4", pa.int64()), ("stem6", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64()))}).to_pandas()
        model = _prior_scores(empty, 0.5)
        model.offset = float(np.log((toxic + 1) / (clean + 1)))
        return model
    taught = sample
    if all(map(all, parts)):
        taught, sample = sample.where(~rest), sample.where(rest)
    counts = common.written(
        taught.select("text", "label").mapInArrow(_count, "stem int, key long, stem4 long, stem6 long, toxic long, clean long")
        .groupBy("stem", "key")
        .agg(F.min("stem4").alias("stem4"), F.min("stem6").alias("stem6"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "toxic-counts",
    )
    totals = counts.where("stem = 0").agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = (totals[0] or 0) + 0.5, (totals[1] or 0) + 0.5  # documents of a class may all be empty
    model = _prior_scores(counts.where(F.col("toxic") + F.col("clean") >= MIN_COUNT).toPandas(), toxic / (toxic + clean))
    sent = spark.sparkContext.broadcast(model)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best segment of each document, and a histogram of the clean documents' word scores."""
        for batch in batches:
            seen = []
            best, words = [], []
            for flag, scores in zip(batch.column("label").to_pylist(), _documents(sent.value, batch.column("text")), strict=True):
                best.append(max((s for *_, s in maximal_segments(scores)), default=0.0))
                words.append(len(scores))
                if not flag:
                    seen.append(scores)
            values, n = np.unique(np.round(np.concatenate(seen) if seen else np.zeros(0), 2), return_counts=True)
            yield pa.record_batch(
                [pa.array(batch.column("label").to_pylist() + [-1] * len(values), pa.int32()), pa.array(best + values.tolist(), pa.float64()), pa.array(words + n.tolist(), pa.int64())],
                ["label", "value", "n"],
            )

    seen = sample.select("text", "label").mapInArrow(first_pass, "label int, value double, n long").toPandas()
    histogram = seen[seen.label == -1]
    model.scale = _solve_scale(np.repeat(histogram.value.to_numpy(), np.maximum(histogram.n.to_numpy() * 1_000_000 // max(histogram.n.sum(), 1), 1)))
    best = seen[seen.label == 0]
    model.k = float(len(best) / max((best.n * np.exp(-model.scale * best.value)).sum(), 1e-9)) if len(best) else 1.0
    sent.destroy()
    sent = spark.sparkContext.broadcast(model)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_judged(sent.value, s)[0] for s in _documents(sent.value, batch.column("text"))]
            yield pa.record_batch([batch.column("label"), pa.array(found, pa.float64())], ["label", "evidence"])

    seen = sample.select("text", "label").mapInArrow(second_pass, "label int, evidence double").toPandas()
    model.slope, model.offset = _logistic(np.log1p(seen.evidence.to_numpy()), seen.label.to_numpy().astype(float))
    sent.destroy()
    pa.default_memory_pool().release_unused()  # what came as tables is arrays by now
    return model


def score(docs: DataFrame, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """``id, n_words, evidence, score, segments`` of every row of ``docs`` (columns ``doc_id`` and ``text``), and the columns ``carry`` as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            for at, end, data, bounds in common.blocks(batch.column("text")):
                found = [(len(s), *_judged(sent.value, s)) for s in _scored(sent.value, data, bounds)]
                evidence = np.array([x[1] for x in found], float)
                part = batch.slice(at, end - at)
                yield pa.record_batch(
                    [part.column("id"), pa.array([x[0] for x in found], pa.int64()), pa.array(evidence), pa.array(probability(sent.value, evidence)), pa.array([x[2] for x in found], kind), *map(part.column, held)],
                    ["id", "n_words", "evidence", "score", "segments", *held],
                )

    held = [f"carry_{c}" for c in carry]
    carried = [F.col(c).alias(h) for c, h in zip(carry, held, strict=True)]
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*carried).schema) if carried else ""
    found = common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), *carried], run, SCHEMA + kinds)
    return found.select("id", "n_words", "evidence", "score", "segments", *[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), common.fold("_id", 3) != 1)
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        (common.fold("id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("segments").cast("long").alias("n_segments"),
    )
