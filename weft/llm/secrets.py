"""Secret scanning with inferred grammars.

Three base patterns give labelled credentials: assignments, access keys and long
hexadecimal runs.  For each kind a prefix tree of a bounded sample of them is folded
into a probabilistic automaton by merging states whose futures don't differ
significantly (ALERGIA: Carrasco and Oncina 1994).  Candidates are the base spans'
credentials and what lies outside them of every run of credential characters, where 16
or more are left; a candidate's score is the log-likelihood of its format under the best
automaton less that under a first-order model of ordinary runs.  Candidates whose score
is above ``MARGIN`` are reported beside the base spans, which always stay and carry
their own credential's score.

Unlabelled candidates may be credentials, so they don't set the threshold, nor are they
all taken for ordinary.  Ordinary runs are the shorter ones, and those candidates that
are not above the margin against a model of the shorter ones alone.

Characters are seen as classes (digit, a-f, g-z, A-F, G-Z, each mark), since inside a
class a credential's letters are as good as random; class members are equally likely in
both models and cancel out.

Nulls and edge cases: a null or empty text has no span; offsets are code points, ends
exclusive; with no labelled credential (an empty table) only the base patterns act;
repeated and null ids give one row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import common

KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Documents that the grammars learn from, at most (about).
FIT_ROWS = 20_000
#: Distinct formats of each kind that an automaton learns from (those with the smallest hashes), and how often it is shown them in all.
FIT_VALUES = 1_500
FIT_DRAWS = 4 * FIT_VALUES
#: Distinct formats of unlabelled candidates that the model of ordinary runs learns from.
FIT_ORDINARY = 20 * FIT_VALUES
#: Confidence of the merge test.
ALPHA = 0.05
#: Least advantage, in nats, of a format over ordinary text.
MARGIN = 8.0
CANDIDATE = 16

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer than 24 is never a match, so runs need no filter
_WORDS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE)
_ANY = re.compile(r"[A-Za-z0-9+/_.=-]+")
_CLASSES = str.maketrans(
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 10 + "a" * 6 + "g" * 20 + "A" * 6 + "G" * 20
)

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """``(start, kind, end, credential)`` of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), "assign", m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str, spans: list[tuple[int, str, int, str]], short: bool = False) -> Iterator[tuple[int, int, str]]:
    """What lies outside base spans of each run of credential characters, if it is long enough to be a candidate (``short``: if it isn't)."""
    for m in (_ANY if short else _RUN).finditer(text):
        pieces = [m.span()]
        for x, _, y, _ in spans:
            pieces = [p for a, b in pieces for p in ((a, min(b, x)), (max(a, y), b)) if p[0] < p[1]] if any(a < y and x < b for a, b in pieces) else pieces
        for a, b in pieces:
            if (b - a < CANDIDATE) == short:
                yield a, b, text[a:b].translate(_CLASSES)


class Automaton:
    """A probabilistic automaton over character classes, folded from a prefix tree."""

    def __init__(self, values: list[str]) -> None:
        self.seen, self.ends, self.next, self.moves = [0], [0], [{}], [{}]
        for value in values:
            state = 0
            self.seen[0] += 1
            for c in value:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.moves.append({})
                self.moves[state][c] = self.moves[state].get(c, 0) + 1
                state = self.next[state][c]
                self.seen[state] += 1
            self.ends[state] += 1
        self._fold_all()

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states' futures agree within the Hoeffding bound, state by state."""
        width = math.sqrt(0.5 * math.log(2 / ALPHA))
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.seen[x], self.seen[y]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > bound:
                return False
            for c in self.moves[x].keys() | self.moves[y].keys():
                if abs(self.moves[x].get(c, 0) / n - self.moves[y].get(c, 0) / m) > bound:
                    return False
                if c in self.next[x] and c in self.next[y]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, parent: int, c: str, into: int) -> None:
        """Point a transition at ``into`` and add the tree that hung there to it."""
        tree, self.next[parent][c] = self.next[parent][c], into
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.seen[x] += self.seen[y]
            self.ends[x] += self.ends[y]
            for k, n in self.moves[y].items():
                self.moves[x][k] = self.moves[x].get(k, 0) + n
                if k in self.next[x]:
                    todo.append((self.next[x][k], self.next[y][k]))
                else:
                    self.next[x][k] = self.next[y][k]

    def _fold_all(self) -> None:
        kept = [0]
        while True:
            border = [(self.seen[t], s, c, t) for s in kept for c, t in self.next[s].items() if t not in kept]
            if not border:
                break
            _, parent, c, state = max(border, key=lambda x: (x[0], -x[3]))
            for into in kept:
                if self._alike(into, state):
                    self._fold(parent, c, into)
                    break
            else:
                kept.append(state)
        number = {s: i for i, s in enumerate(kept)}
        self.states = [
            {c: (math.log((self.moves[s][c] + 0.01) / (self.seen[s] + 0.1)), number[t]) for c, t in self.next[s].items()} for s in kept
        ]
        self.stop = [math.log((self.ends[s] + 0.01) / (self.seen[s] + 0.1)) for s in kept]
        self.miss = [math.log(0.01 / (self.seen[s] + 0.1)) for s in kept]
        del self.seen, self.ends, self.next, self.moves

    def score(self, value: str) -> float:
        state, total = 0, 0.0
        for c in value:
            step = self.states[state].get(c)
            if step is None:  # a class never seen here: the state stays
                total += self.miss[state]
            else:
                total += step[0]
                state = step[1]
        return total + self.stop[state]


class Ordinary:
    """First-order model of the class runs of ordinary text: of counted pairs, and of whole candidates.

    Shorter runs say nothing of where a candidate ends, so its length has a model of its own.
    """

    def __init__(self, short: Counter, values: Counter) -> None:
        pairs, firsts = defaultdict(float), defaultdict(float)
        for (a, b), n in short.items():
            pairs[a, b] += n
            firsts[a] += n
        for value, n in values.items():
            for a, b in zip("^" + value, value, strict=False):
                pairs[a, b] += n
                firsts[a] += n
        self.pairs = {k: math.log((v + 0.5) / (firsts[k[0]] + 8)) for k, v in pairs.items()}
        self.rest = {a: math.log(0.5 / (n + 8)) for a, n in firsts.items()}
        self.new = math.log(1 / 16)
        ends = values.total() + 1
        more = sum((len(v) - CANDIDATE) * n for v, n in values.items()) + CANDIDATE
        self.stop, self.go = math.log(ends / (ends + more)), math.log(more / (ends + more))

    def score(self, value: str) -> float:
        pairs, rest = self.pairs, self.rest
        inside = sum(pairs[a, b] if (a, b) in pairs else rest.get(a, self.new) for a, b in zip("^" + value, value, strict=False))
        return inside + self.go * max(len(value) - CANDIDATE, 0) + self.stop


@dataclass
class Model:
    automata: dict[str, Automaton]
    ordinary: Ordinary
    threshold: float

    def score(self, value: str) -> float:
        return max((a.score(value) for a in self.automata.values()), default=-math.inf) - self.ordinary.score(value)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class runs of each kind's credentials and of candidates, and pairs of classes in shorter runs, counted by partition."""
    found: dict[str, Counter] = defaultdict(Counter)
    short: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for _, kind, _, value in spans:
                found[kind][value.translate(_CLASSES)] += 1
            found[""].update(v for _, _, v in candidates(text or "", spans))
            short.update(v for _, _, v in candidates(text or "", spans, True))
    for value, n in short.items():
        for a, b in zip("^" + value, value, strict=False):
            found["short"][a + b] += n
    rows = [(k, v, n) for k, own in found.items() for v, n in own.items()]
    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "n"])


def _drawn(counts: Counter, values: int) -> list[str]:
    """Each of at most ``values`` formats at least once and at most ``values`` times, ``FIT_DRAWS`` in all; counts are scaled down to that."""
    counts = {v: min(n, values) for v, n in sorted(counts.items())}
    more, room = sum(counts.values()) - len(counts), max(FIT_DRAWS, len(counts)) - len(counts)
    return [v for v, n in counts.items() for _ in range(n if more <= room else 1 + (n - 1) * room // more)]


def fit(docs: DataFrame, rows: int = FIT_ROWS, values: int = FIT_VALUES) -> Model:
    """Infer the grammars from the credentials of about ``rows`` documents."""
    sample = common.sample_rows(docs.select("doc_id", "text"), ["doc_id", "text"], rows, seed=8)
    counted = sample.select("text").mapInArrow(_learn, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    # the smallest hashes: a bounded sample of distinct formats for each kind
    counted = common.written(counted, "formats")
    by_kind: dict[str, Counter] = defaultdict(Counter)
    for kind in (*KINDS, "", "short"):
        bound = {"": FIT_ORDINARY, "short": 256 * 256}.get(kind, values)  # pairs of classes are few
        for r in counted.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(bound).collect():
            by_kind[kind][r.value] = r.n
    automata = {}
    for kind in KINDS:
        drawn = _drawn(by_kind[kind], values)
        if drawn:
            automata[kind] = Automaton(drawn)
    model = Model(automata, Ordinary(by_kind["short"], Counter()), MARGIN)
    ordinary = Counter({v: n for v, n in by_kind[""].items() if model.score(v) <= MARGIN})
    model.ordinary = Ordinary(by_kind["short"], ordinary)
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``id, spans`` of every row (columns ``doc_id`` and ``text``); ``spans`` in order of start, then kind."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}

        def scored(value: str) -> float | None:
            if not model.automata:
                return None
            score = known.get(value)
            if score is None:
                score = model.score(value)
                if len(known) < 200_000 and len(value) <= 64:
                    known[value] = score
            return score

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                found = [(a, KINDS.index(k), k, b, scored(value.translate(_CLASSES))) for a, k, b, value in spans]
                if model.automata:
                    for a, b, value in candidates(text or "", spans):
                        score = scored(value)
                        if score > model.threshold:
                            found.append((a, len(KINDS), ADDED, b, score))
                out.append([{"kind": k, "start": a, "end": b, "score": s} for a, _, k, b, s in sorted(found, key=lambda x: x[:2])])
            yield pa.record_batch([batch.column("id"), pa.array(out, kind)], ["id", "spans"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")], run, f"id long, spans array<{SPAN}>")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = scan(docs, fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(of_kind(*KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
