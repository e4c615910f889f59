"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a space, and each run of one, two and three
characters is hashed into ``BUCKETS`` cells.  Learning counts cells per language;
prediction adds log-probabilities, gathered from a broadcast matrix for a whole block
of texts at once.

Nulls and edge cases: a text that is null or has no letter gets ``und`` and score 0;
a null language teaches nothing; with nothing to learn from every prediction is
``und``.  Ties go to the language that sorts first.  The matrix has one row per cell
and one column per language; its size doesn't depend on the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import common

#: Learning rows at most (about).
FIT_ROWS = 20_000
BUCKETS = 1 << 16
#: Added to every cell's count.
SMOOTHING = 0.1
UNKNOWN = "und"
_PLAIN_LETTER = re.compile("[A-Za-z]")
_ROW_END = "  "  # n-grams of one row never reach the next row's letters


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # BUCKETS x languages
    prior: np.ndarray


def has_letter(text: str) -> bool:
    """Whether any character is a letter (numerals such as Roman ones or fractions are none)."""
    return _PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text))


@cache
def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to a space."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams of ``texts``, in order of their first character, three per character; and each row's first character."""
    low = [t.lower() + _ROW_END for t in texts]
    first = np.cumsum([0, *map(len, low)])
    codes = _letters()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    second, third = np.append(codes[1:], 32).astype(np.uint32), np.append(codes[2:], [32, 32]).astype(np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one ^ (second * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two ^ (third * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    out = np.stack([one >> 16, two >> 16, three >> 16], 1)
    out[(codes == 32) & (second == 32)] = 0  # runs of spaces say nothing; cell 0 weighs nothing
    out[first[1:] - 1] = 0  # nor does a row's last space, which the next row's letters follow
    return out.astype(np.int32), first


def _text_runs(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for a, b in _text_runs(texts, 1 << 18):
            found, first = cells(texts[a:b])
            for i, lang in enumerate(langs[a:b]):
                own = np.bincount(found[first[i] : first[i + 1]].ravel(), minlength=BUCKETS)
                counts[lang] = counts[lang] + own if lang in counts else own
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))], ["lang", "cell", "n"])


def fit(docs: DataFrame, keep=None, rows: int = FIT_ROWS) -> Model:
    """Learn from about ``rows`` documents with a language; ``keep`` is a condition on ``doc_id``."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = common.sample_rows(known if keep is None else known.where(keep), ["doc_id", "text"], rows, seed=10)
    found = known.select("text", "lang").mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found.lang.unique())
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        own = found[found.lang == lang]
        matrix[own.cell.to_numpy(), k] += own.n.to_numpy()
    matrix[0] = 0
    total = matrix.sum(0)
    matrix[0] = 1
    matrix = np.log(matrix) - np.log(total)
    matrix[0] = 0
    return Model(languages, matrix, np.log(total / total.sum()) if len(languages) else np.zeros(0))


def posteriors(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of each language for each text; one text's sums don't depend on its neighbours."""
    out = np.zeros((len(texts), len(model.languages)))
    size = max(1 << 12, (1 << 18) // max(1, len(model.languages) // 4))
    for a, b in _text_runs(texts, size):
        found, first = cells(texts[a:b])
        for low in range(0, len(found), size * 4):  # one text longer than the block
            part = found[low : low + size * 4]
            sums = model.matrix[part[:, 0]] + model.matrix[part[:, 1]] + model.matrix[part[:, 2]]
            rows = np.flatnonzero((first[1:] > low) & (first[:-1] < low + len(part)))
            out[a + rows] += np.add.reduceat(sums, np.maximum(first[rows] - low, 0))
    out += model.prior
    out -= out.max(1, keepdims=True)
    out = np.exp(out)
    return out / out.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``id, lang_pred, score`` of every row (columns ``doc_id`` and ``text``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = [i for i, t in enumerate(texts) if sent.value.languages and has_letter(t)]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                found = posteriors(sent.value, [texts[i] for i in known])
                best = found.argmax(1)
                scores[known] = np.round(found[np.arange(len(known)), best], 9)
                for i, k in zip(known, best.tolist(), strict=True):
                    langs[i] = sent.value.languages[k]
            yield pa.record_batch([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")], run, "id long, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.fold("doc_id", 4) != 2)
    return predict(docs, model).select(F.col("id").alias("doc_id"), (common.fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")
