"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words.  Each passage is described by the
shares of its byte classes, its word lengths and repetitions, and the shares of its words
that fall into each of ``LEXICAL`` hashed cells; a learned layer encodes it, gated attention (Ilse, Tomczak and Welling 2018) weighs the passages of a bag, and a
logistic unit scores the weighted sum.  All weights are learned together from document
labels by Adam, in numpy on the driver, on a bounded sample.

Nulls and edge cases: a null or empty text, or one of white space, is a bag of one
passage without words; null labels and labels without a document teach nothing; with
labels of one class alone every score is near that class; null and repeated ids give
one row each.  Passage descriptions don't depend on neighbouring rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import common

#: Learning rows at most (about); every passage of theirs teaches.
FIT_ROWS = 4_000
WORDS = 48
HIDDEN = 24
STEPS = 200
#: Learning stops early at this mean log-loss.
GOOD_LOSS = 0.005
SEED = 5

_CLASS_OF = np.full(256, 15, np.uint8)
for _n, _set in enumerate(
    [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"#$%&*", b"|", b"<>{}[]()", b"/\\@_=+~^`", b"'\"-:;"]
):
    _CLASS_OF[np.frombuffer(_set, np.uint8)] = _n
_CLASS_OF[128:192] = 13  # continuation bytes
_CLASS_OF[192:] = 14  # first bytes of characters beyond ASCII
#: Cells that words are hashed into.
LEXICAL = 32
N_FEATURES = 16 + 10 + LEXICAL


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of a block, and each text's first passage (one more entry than texts)."""
    starts, ends, rows = common.find_words(data, bounds)
    words = np.diff(rows)
    n = np.maximum(-(-words // WORDS), 1)
    first = np.concatenate(([0], np.cumsum(n)))
    total = int(first[-1])
    out = np.zeros((total, N_FEATURES))
    text_of = np.repeat(np.arange(len(words)), words)
    nth = np.arange(len(starts)) - rows[text_of]
    owner = first[text_of] + nth // WORDS
    # a text's bytes belong to its first passage, and from the first word of a later one on to that
    later = np.flatnonzero((nth % WORDS == 0) & (nth > 0))
    begins, which = np.concatenate((bounds[:-1], starts[later])), np.concatenate((first[:-1], owner[later]))
    order = np.lexsort((which, begins))
    passage = np.repeat(which[order], np.diff(np.append(begins[order], len(data))))
    classes = np.bincount(passage * 16 + _CLASS_OF[data], minlength=total * 16).reshape(total, 16)
    size = np.maximum(classes.sum(1), 1)
    out[:, :16] = classes / size[:, None]
    hashes = common.hash_words(data, starts, ends)
    held = np.bincount(owner, minlength=total)
    count = np.maximum(held, 1)
    lengths = ends - starts

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, x, total) / count

    def repeats(step: int) -> np.ndarray:
        same = np.zeros(len(hashes))
        same[step:] = (hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])
        return same

    order = np.lexsort((hashes, owner))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    upper = (_CLASS_OF[data[starts]] == 1) & (_CLASS_OF[data[np.minimum(starts + 1, ends - 1)]] == 1)
    last = _CLASS_OF[data[ends - 1]]
    mean = per_word(lengths)
    out[:, 16] = mean / 10
    out[:, 17] = np.sqrt(np.maximum(per_word(lengths.astype(float) ** 2) - mean**2, 0)) / 10
    out[:, 18] = np.bincount(owner[order], new, total) / count
    out[:, 19] = per_word(repeats(1))
    out[:, 20] = per_word(repeats(2))
    out[:, 21] = per_word(upper)
    out[:, 22] = per_word(last == 7)
    out[:, 23] = per_word((last == 8) | (last == 11))
    out[:, 24] = per_word(lengths == 1)
    out[:, 25] = np.log1p(held) / np.log1p(WORDS)
    cell = (hashes % np.uint64(LEXICAL)).astype(np.int64)
    out[:, 26:] = np.bincount(owner * LEXICAL + cell, minlength=total * LEXICAL).reshape(total, LEXICAL) / count[:, None]
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (t * g) @ w["a"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / _sums(e, first)[bag]
    z = _sums(a[:, None] * h, first)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "bag": bag}


def _slopes(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Derivatives of the mean log-loss by each weight, from a forward pass."""
    h, t, g, a, z, bag = (f[k] for k in ("h", "t", "g", "a", "z", "bag"))
    d = (f["p"] - y) / len(y)
    into = (d[:, None] * w["c"])[bag]
    da = (into * h).sum(1)
    de = a * (da - _sums(a * da, first)[bag])
    dt, dg = de[:, None] * w["a"] * g * (1 - t**2), de[:, None] * w["a"] * t * g * (1 - g)
    dh = (a[:, None] * into + dt @ w["v"].T + dg @ w["u"].T) * (1 - h**2)
    return {"encode": x.T @ dh, "encode0": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ d, "c0": d.sum()}


def score_bags(model: Model, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 for each bag, and the attention on each passage."""
    f = _forward(model.weights, (x - model.mean) / model.spread, first)
    return f["p"], f["a"]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model:
    """Learn encoder, attention and classifier together; plain full-batch Adam, so reruns agree."""
    mean, spread = x.mean(0), x.std(0) + 0.05
    x = (x - mean) / spread
    rng = np.random.default_rng(seed)

    def drawn(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w = {
        "encode": drawn(x.shape[1], HIDDEN), "encode0": np.zeros(HIDDEN), "v": drawn(HIDDEN, HIDDEN), "u": drawn(HIDDEN, HIDDEN),
        "a": drawn(HIDDEN), "c": drawn(HIDDEN), "c0": np.array(np.log(share / (1 - share))),
    }
    slow, fast = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        f = _forward(w, x, first)
        if -np.log(np.where(y > 0.5, f["p"], 1 - f["p"]) + 1e-9).mean() < GOOD_LOSS:
            break
        for k, slope in _slopes(w, x, first, y, f).items():
            slope = slope + (1e-4 * w[k] if k != "c0" else 0)
            slow[k] = 0.9 * slow[k] + 0.1 * slope
            fast[k] = 0.99 * fast[k] + 0.01 * slope**2
            w[k] = w[k] - 0.02 * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.99**step)) + 1e-8)
    return Model(mean, spread, w)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature rows of each learning document's passages, as float32 bytes."""
    for batch in batches:
        out = []
        for _, _, data, bounds in common.blocks(batch.column("text")):
            x, first = passages(data, bounds)
            out += [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, keep=None, rows: int = FIT_ROWS) -> Model:
    """Learn from about ``rows`` labelled documents; ``keep`` is a condition on the id (``_id``)."""
    sample = common.labelled(docs, labels, "quality", F.lit(True) if keep is None else keep, rows, "quality-fit")
    seen = sample.mapInArrow(_describe, "id long, label int, features binary").toPandas().sort_values(["id", "label"], kind="stable")
    if not len(seen):  # nothing to learn: every score is one half
        x, first = np.zeros((1, N_FEATURES)), np.array([0, 1])
        return train(x, first, np.array([0.5]), steps=1)
    bags = [np.frombuffer(b, "<f4").reshape(-1, N_FEATURES) for b in seen.features]
    first = np.cumsum([0, *map(len, bags)])
    return train(np.concatenate(bags).astype(np.float64), first, seen.label.to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``id, score, n_passages, best_passage`` of every row (columns ``doc_id`` and ``text``).

    ``best_passage`` is the number (from 0) of the passage with the most attention.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, best = [], [], []
            for _, _, data, bounds in common.blocks(batch.column("text")):
                x, first = passages(data, bounds)
                p, a = score_bags(sent.value, x, first)
                scores.append(p)
                counts.append(np.diff(first))
                best += [int(a[i:j].argmax()) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            p = np.concatenate(scores) if scores else np.zeros(0)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column("id"), pa.array(p), pa.array(n, pa.int64()), pa.array(best, pa.int64())], ["id", "score", "n_passages", "best_passage"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")], run, "id long, score double, n_passages long, best_passage long")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), common.fold("_id", 3) != 1)
    return score(docs, model).select(
        F.col("id").alias("doc_id"), (common.fold("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages"
    )
