"""Language-model scoring with an Elias-Fano n-gram trie.

A text is its lower-cased words and one end; the end also stands before its first word.
Every n-gram of the learning texts is kept, at three levels cut into shards; each shard
is a file or two in the shared folder that Python workers map into memory.

* Level 1, sharded by hash: the words' 64-bit hashes in order (a word's id is its rank
  over all shards), a second hash that tells apart words that share the first, and the
  counts as running sums.
* Level 2: for each word a monotone pointer to its successors, the successors' ids
  (made monotone by adding the last value of the range before), counts as running sums,
  quantised log-probabilities, and quantised back-off weights.
* Level 3: the same for pairs, except that a successor w of (u, v) is stored as its rank
  among the successors of v: an id relative to its context, which is a small number.

Look-ups are successor searches in a context's range, made for all distinct n-grams of a
block of texts at once.

Shards of levels 2 and 3 are equal stretches of the corpus's tokens in the order of
their n-grams: the n-gram (context, w) lies at the occurrences of all earlier contexts
plus its own context's times w / words.  A context that holds a third of all tokens is
thus cut by its successors into as many shards as it fills, and no shard's building
takes more memory than ``shard_tokens`` occurrences need, whatever the corpus.  Tasks
take their shards in order and hold one at a time.

Smoothing is interpolated absolute discounting over the add-one unigram base.  A level's
discount comes from its counts of counts over all shards, and logarithms are rounded to
one grid, so scores don't depend on how the levels are cut.  Hence two steps a level:
the first merges counts and writes pointers, ids and running sums; the second, when the
counts of counts are known, adds probabilities and weights.

Nulls and edge cases: a null or empty text is one end; with no learning texts every token
has probability one; null and repeated ids give one row each.  More than 2^32 distinct
words raise an error, as do two words of the corpus that share their first hash (the
chance of it is n^2 / 2^65; fit again with another ``seed``).
"""

from __future__ import annotations

import os
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import common
from weft.llm.eliasfano import EliasFano, pack, unpack

#: Tokens of the corpus that one shard holds.
SHARD_TOKENS = 3_000_000
#: Bytes of text whose n-grams are counted, or looked up, at once.
TEXT_BYTES = 12 << 20
#: Distinct words that a counting task holds before it passes them on.
HELD = 2_000_000
#: Shard files that one worker keeps mapped.
MAPPED = 512
#: Log-probabilities are rounded to this part of a decade.
GRID = 2048
_LAST = (1 << 16) - 1
_U = np.uint64
_END = _U(0x51ED270B7F4A7C15)  # the hash that stands for the end
_LOW32 = _U(0xFFFFFFFF)
_NONE = -1


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Model:
    """Where the trie lies and what is known of its shards: a few numbers a shard."""

    base: str
    limit: int  # occurrences a shard
    bits: int  # level 1 is sharded by the hash's first bits
    seed: int
    words: np.ndarray = field(default_factory=_none)  # first word id of each shard of level 1, and their number
    running: np.ndarray = field(default_factory=_none)  # tokens before each shard of level 1, and their number
    pair_sizes: np.ndarray = field(default_factory=_none)  # pairs of each shard of level 2
    pair_first: np.ndarray = field(default_factory=_none)  # the word that its first pair begins with
    pair_skip: np.ndarray = field(default_factory=_none)  # successors of that word in earlier shards
    triple_start: np.ndarray = field(default_factory=_none)  # first shard of level 3 of each shard of level 2, and their number
    triple_sizes: np.ndarray = field(default_factory=_none)
    discounts: tuple[float, float] = (0.5, 0.5)

    @property
    def n_words(self) -> int:
        return int(self.words[-1])

    @property
    def tokens(self) -> int:
        return int(self.running[-1])

    @property
    def everything(self) -> int:
        return self.tokens + self.n_words + 1

    def word_shards(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def cut(self, shard: int) -> bool:
        """Whether a shard of level 2 has words enough behind its pairs for several shards of level 3."""
        return bool(self.triple_start[shard + 1] - self.triple_start[shard] > 1)

    def place(self, before: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where among its level's occurrences an n-gram lies: after its context's earlier ones, by its last word."""
        return before + (word / max(self.n_words, 1) * count).astype(np.int64)


# ---- files -------------------------------------------------------------------


def write_file(base: str, name: str, raw: bytes) -> None:
    """Write a file of the model from wherever this task runs; a reader sees all of it or nothing."""
    fs, path = pafs.FileSystem.from_uri(base)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as out:
        out.write(raw)
    fs.move(part, f"{path}/{name}")


def _exists(base: str, name: str) -> bool:
    fs, path = pafs.FileSystem.from_uri(base)
    return fs.get_file_info(f"{path}/{name}").type != pafs.FileType.NotFound


def _remove(base: str, name: str) -> None:
    fs, path = pafs.FileSystem.from_uri(base)
    if fs.get_file_info(f"{path}/{name}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{path}/{name}")


_mapped: OrderedDict[tuple[str, str], dict] = OrderedDict()


def read_file(base: str, name: str) -> np.ndarray | None:
    """A file's bytes as a memory map (from a remote store by way of an unlinked local copy), or None if there is none."""
    fs, path = pafs.FileSystem.from_uri(base)
    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(f"{path}/{name}") as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r")


def _load(base: str, name: str) -> dict:
    """A file of the model as memory-mapped views."""
    found = _mapped.get((base, name))
    if found is None:
        found = _mapped[base, name] = unpack(read_file(base, name))
        while len(_mapped) > MAPPED:
            _mapped.popitem(last=False)
    else:
        _mapped.move_to_end((base, name))
    return found


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(shard, first, end)`` of the runs of equal values in order."""
    if len(shards):
        cuts = np.flatnonzero(np.diff(shards)) + 1
        yield from zip(shards[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True)


# ---- quantising ----------------------------------------------------------------


def _codes(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logs * -GRID), 0, _LAST).astype(np.uint16)


def _logs(codes: np.ndarray) -> np.ndarray:
    return codes / -float(GRID)


# ---- looking up --------------------------------------------------------------


def _children(level: dict, parent: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted parents (numbered from the shard's first): the position of the child ``value`` (or -1) and its rank in its context.

    Pointers are read once for each run of one parent.
    """
    new = np.diff(parent, prepend=-1) != 0
    context, run = parent[new], np.cumsum(new) - 1
    inside = context < level["pointers"].n - 1
    low, high = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
    low[inside], high[inside] = level["pointers"].get_two(context[inside])
    base = np.zeros(len(low), np.uint64)
    later = np.flatnonzero(low > 0)
    base[later] = level["ids"].get(low[later] - 1)
    out = np.full(len(parent), _NONE, np.int64)
    some = np.flatnonzero((low < high)[run])
    at = run[some]
    out[some] = level["ids"].find(base[at] + value[some].astype(np.uint64), low[at], high[at])
    return out, out - low[run]


class _Block:
    """A block of texts as token ids: each text is an end, its words, an end.

    Distinct words, pairs and triples are looked up once.  ``token`` is each token's
    distinct word, ``pair`` the distinct known pair that ends at it (or -1).
    """

    def __init__(self, model: Model, data: np.ndarray, bounds: np.ndarray, checks: bool = True) -> None:
        self.model = model
        starts, ends, rows = common.find_words(data, bounds)
        n = np.diff(rows)
        self.first = np.concatenate(([0], np.cumsum(n + 2)))
        size = int(self.first[-1])
        hashes = np.full(size, _END, np.uint64)
        self.opens = np.zeros(size, bool)  # the end before a text, which is context only
        self.opens[self.first[:-1]] = True
        inside = ~self.opens
        inside[self.first[1:] - 1] = False
        words = np.flatnonzero(inside)
        hashes[words] = common.hash_words(data, starts, ends, model.seed)
        self.distinct, self.token = np.unique(hashes, return_inverse=True)
        self.check = None
        if not checks:  # for texts whose every word is known
            return
        # any one occurrence of each distinct word gives its second hash
        seen = np.full(len(self.distinct), _NONE, np.int64)
        seen[self.token[words]] = np.arange(len(words))
        some = np.flatnonzero(seen >= 0)
        self.check = np.zeros(len(self.distinct), np.uint32)
        if len(some):
            self.check[some] = common.hash_words(*_gathered(data, starts[seen[some]], ends[seen[some]]), model.seed + 1000) >> _U(32)

    def identify(self) -> None:
        """``id`` (or -1), ``count`` and the occurrences of all earlier words, of each distinct word."""
        model, hashes = self.model, self.distinct
        n = len(hashes)
        self.id, self.count, self.before = np.full(n, _NONE, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for shard, a, b in _runs(model.word_shards(hashes)):
            if model.words[shard] == model.words[shard + 1]:
                continue
            level = _load(model.base, f"1-{shard}")
            at = level["keys"].find(hashes[a:b] - (_U(shard) << _U(64 - model.bits) if model.bits else _U(0)))
            hit = np.flatnonzero(at >= 0)
            if self.check is not None:
                hit = hit[level["checks"][at[hit]] == self.check[a + hit]]
            at = at[hit]
            sums, more = (x.astype(np.int64) for x in level["counts"].get_two(at))
            self.id[a + hit] = at + model.words[shard]
            self.before[a + hit] = sums + model.running[shard]
            self.count[a + hit] = more - sums
        self.base = np.log10((self.count + 1) / model.everything)

    def find_pairs(self) -> None:
        """Distinct pairs of known words as two distinct words each, and where they end."""
        known = (self.id >= 0)[self.token]
        self.pair_at = np.flatnonzero(known[1:] & known[:-1] & ~self.opens[1:]) + 1
        keys = (self.token[self.pair_at - 1].astype(np.uint64) << _U(32)) | self.token[self.pair_at].astype(np.uint64)
        keys, self.pair_which = np.unique(keys, return_inverse=True)
        self.pair_u, self.pair_w = (keys >> _U(32)).astype(np.int64), (keys & _LOW32).astype(np.int64)

    def pair_shards(self) -> np.ndarray:
        u = self.pair_u
        return self.model.place(self.before[u], self.count[u], self.id[self.pair_w]) // self.model.limit

    def look_up_pairs(self) -> None:
        """Of each distinct pair: its shard, number and code, its rank among its first word's successors, and (in shards that are cut at level 3) its occurrences and those of earlier pairs of the shard."""
        model, n = self.model, len(self.pair_u)
        self.pair_shard = self.pair_shards()
        self.number, self.rank = np.full(n, _NONE, np.int64), np.full(n, _NONE, np.int64)
        self.pair_count, self.pair_before, self.code = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint16)
        u, w = self.id[self.pair_u], self.id[self.pair_w]
        for shard, a, b in _runs(self.pair_shard):
            if not model.pair_sizes[shard]:
                continue
            level = _load(model.base, f"2-{shard}")
            first = model.pair_first[shard]
            parent = u[a:b] - first
            some = np.flatnonzero(parent >= 0)
            at, nth = _children(level, parent[some], w[a:b][some])
            hit = np.flatnonzero(at >= 0)
            own, at = a + some[hit], at[hit]
            self.number[own] = at
            self.rank[own] = nth[hit] + np.where(u[own] == first, model.pair_skip[shard], 0)
            self.code[own] = _load(model.base, f"2p-{shard}")["codes"][at]
            if model.cut(shard):
                counts = _load(model.base, f"2c-{shard}")["counts"]
                sums = counts.get(at).astype(np.int64)
                self.pair_before[own] = sums
                self.pair_count[own] = counts.get(at + 1).astype(np.int64) - sums

    def find_triples(self) -> None:
        """Distinct triples of known pairs as two distinct pairs each, where they end, and the shards they'd lie in."""
        model = self.model
        pair = np.full(len(self.token), _NONE, np.int64)
        pair[self.pair_at] = np.where(self.number >= 0, np.arange(len(self.number)), _NONE)[self.pair_which]
        self.pair = pair
        self.triple_at = np.flatnonzero((pair[2:] >= 0) & (pair[1:-1] >= 0) & ~self.opens[1:-1] & ~self.opens[2:]) + 2
        keys = (pair[self.triple_at - 1].astype(np.uint64) << _U(32)) | pair[self.triple_at].astype(np.uint64)
        keys, self.triple_which = np.unique(keys, return_inverse=True)
        self.triple_a, self.triple_b = a, b = (keys >> _U(32)).astype(np.int64), (keys & _LOW32).astype(np.int64)
        self.triple_shard = model.triple_start[self.pair_shard[a]]
        if self.pair_count.any():  # some lie in shards that are cut
            place = model.place(self.pair_before[a], self.pair_count[a], self.id[self.pair_w[b]])
            self.triple_shard = self.triple_shard + place // model.limit

    def word_weights(self) -> np.ndarray:
        """Logarithm of the weight that each distinct word leaves to shorter contexts; 0 for unknown words."""
        out = np.zeros(len(self.id))
        known = np.flatnonzero(self.id >= 0)
        for shard, a, b in _runs(self.before[known] // self.model.limit):
            level, own = _load(self.model.base, f"2p-{shard}"), known[a:b]
            out[own] = _logs(level["weights"][self.id[own] - level["home"][0]])
        return out

    def pair_weights(self) -> np.ndarray:
        out = np.zeros(len(self.number))
        known = np.flatnonzero(self.number >= 0)
        for shard, a, b in _runs(self.model.triple_start[self.pair_shard[known]] + self.pair_before[known] // self.model.limit):
            level, own = _load(self.model.base, f"3p-{shard}"), known[a:b]
            out[own] = _logs(level["weights"][self.number[own] - level["home"][0]])
        return out

    def scores(self, total: np.ndarray) -> np.ndarray:
        """Log-probability of each token, in place of its base."""
        model = self.model
        total[1:] += self.word_weights()[self.token[:-1]]  # a known pair has its own probability; else its context's weight times the word's
        found = self.number >= 0
        hit = found[self.pair_which]
        total[self.pair_at[hit]] = _logs(self.code)[self.pair_which[hit]]
        before = np.flatnonzero((self.pair[1:-1] >= 0) & ~self.opens[1:-1])  # likewise for triples
        total[before + 2] += self.pair_weights()[self.pair[before + 1]]
        a, b = self.triple_a, self.triple_b
        logp, known = np.zeros(len(a)), np.zeros(len(a), bool)
        for shard, x, y in _runs(self.triple_shard):
            if not model.triple_sizes[shard]:
                continue
            level, codes = _load(model.base, f"3-{shard}"), _load(model.base, f"3p-{shard}")["codes"]
            parent = self.number[a[x:y]] - level["first"][0]
            some = np.flatnonzero(parent >= 0)
            at, _ = _children(level, parent[some], self.rank[b[x:y]][some])
            hit = np.flatnonzero(at >= 0)
            known[x + some[hit]] = True
            logp[x + some[hit]] = _logs(codes[at[hit]])
        hit = known[self.triple_which]
        total[self.triple_at[hit]] = logp[self.triple_which[hit]]
        return total


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some words of ``data`` as a text of their own, a space after each."""
    sizes = ends - starts + 1
    last = np.cumsum(sizes)
    at = np.arange(int(last[-1])) + np.repeat(starts - (last - sizes), sizes)
    out = data[np.minimum(at, len(data) - 1)]
    out[last - 1] = 32
    return out, last - sizes, last - 1


# ---- counting ------------------------------------------------------------------


def _packed(columns: list[np.ndarray]) -> bytes:
    """Sorted keys (as differences) and what goes with them, byte plane by byte plane, compressed."""
    keys, *rest = columns
    parts = [np.diff(keys, prepend=_U(0)), *rest]
    raw = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes() for p in parts)
    return len(keys).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes, kinds: list[type]) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    widths = [np.dtype(k).itemsize for k in kinds]
    plain = np.frombuffer(pa.decompress(raw[4:], sum(widths) * n, "zstd", asbytes=True), np.uint8)
    cuts = np.cumsum([0, *(w * n for w in widths)])
    out = [np.ascontiguousarray(plain[a:b].reshape(w, n).T).view(k).ravel() for a, b, w, k in zip(cuts[:-1], cuts[1:], widths, kinds, strict=True)]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


#: What a level's counts hold: the key, occurrences, and a second hash or the code of the shorter context's probability.
_KINDS = {1: [np.uint64, np.int64, np.uint32], 2: [np.uint64, np.int64, np.uint16], 3: [np.uint64, np.int64, np.uint16]}
_COUNTED = "shard long, part binary"


def _count(sent, level: int):
    """n-grams of each block, one row for each shard they meet."""

    def dealt(shard: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(s, _packed([c[x:y] for c in columns])) for s, x, y in _runs(shard)]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = sent.value, [], 0
        for batch in batches:
            for _, _, data, bounds in common.blocks(batch.column("text"), TEXT_BYTES):
                block = _Block(model, data, bounds, level == 1)
                if level == 1:
                    held.append([block.distinct, np.bincount(block.token, ~block.opens, len(block.distinct)).astype(np.int64), block.check])
                    size += len(block.distinct)
                    if size > HELD:
                        held = [_merged(held, 1)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield dealt(model.word_shards(held[0][0]), held.pop())
                            size = 0
                    continue
                block.identify()
                block.find_pairs()
                if level == 2:
                    w = block.pair_w
                    shard, parent, child = block.pair_shards(), block.id[block.pair_u], block.id[w]
                    n, extra = np.bincount(block.pair_which, minlength=len(w)), _codes(block.base)[w]
                else:
                    block.look_up_pairs()
                    block.find_triples()
                    b = block.triple_b
                    shard, parent, child = block.triple_shard, block.number[block.triple_a], block.rank[b]
                    n, extra = np.bincount(block.triple_which, minlength=len(b)), block.code[b]
                yield dealt(shard, [(parent.astype(np.uint64) << _U(32)) | child.astype(np.uint64), n, extra])
        if held:
            key, n, extra = _merged(held, 1)
            yield dealt(model.word_shards(key), [key, n, extra])

    return run


def _shards(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each shard of a partition sorted by shard, with its merged counts; one shard is held at a time."""
    held, parts = None, []
    for batch in batches:
        for shard, part in zip(batch.column("shard").to_pylist(), batch.column("part"), strict=True):
            if shard != held and parts:
                yield held, _merged(parts, level)
                parts = []
            held = shard
            parts.append(_unpacked(part.as_py(), _KINDS[level]))
    if parts:
        yield held, _merged(parts, level)


def _merged(parts: list[list[np.ndarray]], level: int) -> list[np.ndarray]:
    key, n, extra = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, n, extra = key[order], n[order], extra[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    if level == 1 and (np.maximum.reduceat(extra, first) != np.minimum.reduceat(extra, first)).any():
        raise ValueError("two words share a hash; fit with another seed")
    return [key[first], np.add.reduceat(n, first), extra[first]]


# ---- building ------------------------------------------------------------------

_REPORT = ["shard", "size", "total", "once", "twice", "first", "first_size", "first_total", "last", "last_size", "last_total"]


def _build(sent, level: int):
    """Merge a partition's counts shard by shard, write what needs no discount, and report what other shards must know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = sent.value, []
        for shard, (key, n, extra) in _shards(batches, level):
            total = int(n.sum())
            sums = EliasFano.build(np.concatenate(([0], np.cumsum(n))))
            if level == 1:
                start = _U(shard) << _U(64 - model.bits) if model.bits else _U(0)
                write_file(model.base, f"1-{shard}", pack({"keys": EliasFano.build(key - start), "checks": extra, "counts": sums}))
                out.append([shard, len(key), total, *[0] * 8])
                continue
            parent, child = (key >> _U(32)).astype(np.int64), (key & _LOW32).astype(np.int64)
            first, last = int(parent[0]), int(parent[-1])
            size = np.bincount(parent - first)
            pointers = np.concatenate(([0], np.cumsum(size)))
            # each range goes on from the last value of the one before
            lasts = np.where(size > 0, child[np.maximum(pointers[1:] - 1, 0)], 0)
            base = np.concatenate(([0], np.cumsum(lasts)))[:-1]
            main = {"pointers": EliasFano.build(pointers), "ids": EliasFano.build((child + base[parent - first]).astype(np.uint64)), "first": np.array([first])}
            write_file(model.base, f"{level}-{shard}", pack(main))
            write_file(model.base, f"{level}t-{shard}", pack({"lower": extra, "counts": sums}))
            if level == 2 and _parts(total, model.limit) > 1:
                write_file(model.base, f"2c-{shard}", pack({"counts": sums}))
            ends = [(first, size[0], n[: size[0]].sum()), (last, size[-1], n[-size[-1] :].sum())]
            out.append([shard, len(key), total, (n == 1).sum(), (n == 2).sum(), *ends[0], *ends[1]])
        yield pa.record_batch([pa.array([int(r[k]) for r in out], pa.int64()) for k in range(len(_REPORT))], _REPORT)

    return run


def _parts(total, limit: int):
    """How many shards of level 3 the pairs of a shard of level 2 take that have ``total`` occurrences (as a rule, about ``limit``)."""
    return np.where(total < 2 * limit, 1, total // limit + 1)


def _word_at(model: Model, place: int) -> int:
    """The first word with at least ``place`` occurrences of words before it."""
    if place >= model.tokens:
        return model.n_words
    shard = int(np.searchsorted(model.running, place, "right")) - 1
    sums = _load(model.base, f"1-{shard}")["counts"]
    low, high = 0, sums.n - 1
    while low < high:
        mid = (low + high) // 2
        if int(sums.get(np.array([mid]))[0]) + model.running[shard] < place:
            low = mid + 1
        else:
            high = mid
    return low + int(model.words[shard])


def _weigh(sent, level: int, sizes: np.ndarray, discount: float, cut: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
    """Add probabilities and back-off weights to a level's shards.

    ``cut`` has the whole sizes and totals of contexts that begin or end a shard, which
    may go on in others: level-2 shard (0 at level 2), context, size, total, in order.
    """

    def whole(group: int, context: int) -> tuple[int, int]:
        low, high = np.searchsorted(cut[0], [group, group + 1])
        at = low + int(np.searchsorted(cut[1][low:high], context))
        return (int(cut[2][at]), int(cut[3][at])) if at < high and cut[1][at] == context else (0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                if _exists(model.base, f"{level}p-{shard}"):  # this task was run before
                    continue
                group = 0
                if level == 2:
                    home = [_word_at(model, shard * model.limit), _word_at(model, (shard + 1) * model.limit)]
                else:
                    group = int(np.searchsorted(model.triple_start, shard, "right")) - 1
                    home = [0, int(model.pair_sizes[group])]
                    if model.cut(group):
                        above = _load(model.base, f"2c-{group}")["counts"]
                        start = (shard - int(model.triple_start[group])) * model.limit
                        home = np.searchsorted(above.get(np.arange(above.n - 1)).astype(np.int64), [start, start + model.limit]).tolist()
                size, total = np.zeros(home[1] - home[0], np.int64), np.zeros(home[1] - home[0], np.int64)
                codes = np.zeros(0, np.uint16)
                if sizes[shard]:
                    held, rest = _load(model.base, f"{level}-{shard}"), _load(model.base, f"{level}t-{shard}")
                    first, pointers = int(held["first"][0]), held["pointers"].get(np.arange(held["pointers"].n)).astype(np.int64)
                    counts = rest["counts"]
                    sums = counts.get(np.arange(counts.n)).astype(np.int64)
                    n, each, all_ = np.diff(sums), np.diff(pointers), np.diff(sums[pointers])
                    for at in {0, len(each) - 1}:
                        each[at], all_[at] = whole(group, first + at)
                    parent = np.repeat(np.arange(len(each)), np.diff(pointers))
                    left = discount * each / np.maximum(all_, 1)
                    codes = _codes(np.log10((n - discount) / all_[parent] + left[parent] * 10.0 ** _logs(rest["lower"])))
                    a, b = max(first, home[0]), min(first + len(each), home[1])
                    if a < b:
                        size[a - home[0] : b - home[0]], total[a - home[0] : b - home[0]] = each[a - first : b - first], all_[a - first : b - first]
                if len(size):
                    size[-1], total[-1] = max((size[-1], total[-1]), whole(group, home[1] - 1))
                weights = _codes(np.log10(np.maximum(discount * size, 1e-9) / np.maximum(total, 1)))
                weights[size == 0] = 0  # nothing ever follows
                write_file(model.base, f"{level}p-{shard}", pack({"codes": codes, "weights": weights, "home": np.array(home)}))
                _mapped.pop((model.base, f"{level}t-{shard}"), None)
                _remove(model.base, f"{level}t-{shard}")
        yield pa.record_batch([pa.array([], pa.int64())], ["id"])

    return run


def _cut_contexts(report, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole sizes and totals of the contexts that begin or end a shard."""
    other = report["first"] != report["last"]
    rows = [np.concatenate([group, group[other]])]
    rows += [np.concatenate([report[f"first{x}"], report[f"last{x}"][other]]) for x in ("", "_size", "_total")]
    order = np.lexsort((rows[1], rows[0]))
    rows = [r[order] for r in rows]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))) if len(order) else order
    return (rows[0][new], rows[1][new], *(np.add.reduceat(r, new) if len(new) else r for r in rows[2:]))


def fit(docs: DataFrame, keep=None, shard_tokens: int = SHARD_TOKENS, seed: int = 1) -> Model:
    """Build the trie from all texts (``keep``: a condition on ``doc_id``) in the shared folder."""
    spark = docs.sparkSession
    texts = (docs if keep is None else docs.where(keep)).select("text")
    # what Spark knows of the texts' size without reading them; it only says how finely level 1 is cut
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # nothing is known of rows that come from a computation
        size = texts.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = max(0, (size // 3 // shard_tokens).bit_length())
    model = Model(common.new_path(spark, "trie"), shard_tokens, bits, seed)

    def built(level: int, shards: int) -> dict[str, np.ndarray]:
        sent = spark.sparkContext.broadcast(model)
        counted = texts.mapInArrow(_count(sent, level), _COUNTED)
        dealt = counted.repartition(max(1, min(shards, 1 << 16)), "shard").sortWithinPartitions("shard")
        rows = dealt.mapInArrow(_build(sent, level), ", ".join(f"{c} long" for c in _REPORT)).toPandas().sort_values("shard")
        return {c: rows[c].to_numpy().astype(np.int64) for c in _REPORT}

    def spread(report: dict, name: str, shards: int) -> np.ndarray:
        out = np.zeros(shards, np.int64)
        out[report["shard"]] = report[name]
        return out

    def discount(report: dict) -> float:
        once, twice = int(report["once"].sum()), int(report["twice"].sum())
        return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

    def weighed(level: int, sizes: np.ndarray, d: float, cut) -> None:
        sent = spark.sparkContext.broadcast(model)
        spark.range(0, len(sizes), 1, max(1, min(len(sizes), 1 << 16))).mapInArrow(_weigh(sent, level, sizes, d, cut), "id long").count()

    report = built(1, 1 << bits)
    model.words = np.concatenate(([0], np.cumsum(spread(report, "size", 1 << bits))))
    model.running = np.concatenate(([0], np.cumsum(spread(report, "total", 1 << bits))))
    if model.n_words >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    shards = model.tokens // model.limit + 1

    report = built(2, shards)
    model.pair_sizes, model.pair_first = spread(report, "size", shards), spread(report, "first", shards)
    cut = _cut_contexts(report, np.zeros(len(report["shard"]), np.int64))
    ahead, skip = None, 0  # the context that ended the last shard, and its successors so far
    skips = []
    for first, last, n, m in zip(*(report[c].tolist() for c in ("first", "last", "first_size", "last_size")), strict=True):
        skips.append(skip if first == ahead else 0)
        skip = m + (skips[-1] if first == last else 0)
        ahead = last
    model.pair_skip = np.zeros(shards, np.int64)
    model.pair_skip[report["shard"]] = skips
    model.triple_start = np.concatenate(([0], np.cumsum(np.where(model.pair_sizes > 0, _parts(spread(report, "total", shards), model.limit), 1))))
    d2 = discount(report)
    weighed(2, model.pair_sizes, d2, cut)

    shards = int(model.triple_start[-1])
    report = built(3, shards)
    model.triple_sizes = spread(report, "size", shards)
    group = np.searchsorted(model.triple_start, report["shard"], "right") - 1
    d3 = discount(report)
    weighed(3, model.triple_sizes, d3, _cut_contexts(report, group))
    model.discounts = (d2, d3)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` (log10) of every row (columns ``doc_id`` and ``text``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, bounds in common.blocks(batch.column("text"), TEXT_BYTES):
                b = _Block(sent.value, data, bounds)
                b.identify()
                b.find_pairs()
                b.look_up_pairs()
                b.find_triples()
                base = b.base[b.token]
                values = ((b.count > 0).astype(np.int32)[b.token], base, b.scores(base.copy()))
                for x in values:
                    x[b.opens] = 0
                out.append([np.diff(b.first) - 1, *(np.add.reduceat(x, b.first[:-1]) for x in values)])
            n, known, base, total = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
            yield pa.record_batch([batch.column("id"), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")], run, "id long, n_tokens long, n_known long, base_score double, score double")


def op3_lm(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.fold("doc_id", 7) != 2)
    return score(docs, model).select(
        F.col("id").alias("doc_id"), (common.fold("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
