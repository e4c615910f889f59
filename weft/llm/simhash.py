"""Near duplicates by SimHash fingerprints, compared bit-sliced.

Two operators share the comparison.

``near_duplicates`` links fingerprints of 64 bits: bit i is one if more than half of the
document's word 3-shingles have bit i set in their XXH64 (seed 42).  Distinct
fingerprints are dealt into buckets so that any two within ``RADIUS`` bits share one: of
four 16-bit quarters two must agree, so each fingerprint goes to the six pairs of
quarters.  What a bucket holds beyond ``BUCKET`` fingerprints sends the whole bucket to a
second dealing by the same rule over its other 32 bits; the 48 bits then fixed leave at
most 65,536 different fingerprints, so no task ever gets an unbounded bucket and no
candidate is dropped.  A bucket yields a spanning forest of its links, never all pairs.

``similar`` links texts whose sets of word 5-shingles have a Jaccard similarity of 0.8 or
more.  Candidates come from wide fingerprints (256 bits over distinct shingles): texts
that agree in the 20 bits of one of 64 tables and differ in at most ``WIDE_RADIUS`` of
128 bits.  Pairs whose similarity a sketch proves to be below 0.8 go at once: of two sets
the sizes and the parities of the shingles in each of 256 bins differ by no more than
there are shingles in one of them alone, so no similar pair goes.  A pair counts in the
first table that it agrees in and in no other.  Each text's nearest candidate is proposed, the proposals are verified on the
texts' real shingles, and rounds go on, in which components propose ever more pairs with
others that no round has tried, until nothing is left to propose: so every candidate pair is verified or
inside one component already, though few pairs are ever written.  A text goes on only in
buckets where it had such a partner in the round before.  A bucket with many
members is cut into blocks; in the first round blocks are compared inside, in later ones
with each other, but for those of the bucket's largest component, whose members need no
more links among themselves.  At a similarity of 0.8 a pair is a candidate in some nine
of ten cases, at 0.85 in 98 of 100, at 0.9 nearly always.

The comparison: fingerprints of a bucket are stored vertically, one bit plane per bit, 64
fingerprints a machine word.  Eight planes at a time are compared with a value and added
to bitwise counters by carry-save adders, for many (value, word) pairs at once; a pair is
abandoned as soon as all its 64 lanes have more differing bits than the radius.

Nulls and edge cases: a null or empty text, or one of white space, has fingerprint zero
and links like any other (``similar``: all texts without words are alike); texts of fewer
words than a shingle are one shingle.  Null ids are never the smallest id unless a
component has no other.  Repeated ids give one row each; ``similar`` tells rows apart by
a key of their own.  Empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm import common
from weft.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints that one bucket holds before it is dealt again.
BUCKET = 2048
#: (value, word) pairs that are compared at once.
PAIRS = 1 << 15
#: Fingerprints whose buckets are compared at once.
GATHERED = 1 << 14

WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Longs of a wide fingerprint; the first two are compared, all are drawn from for the tables' keys.
WIDE = 4
COMPARED = 2
#: Longs of a set's parities.
PARITY = 4
TABLES = 64
KEY_BITS = 20
#: Of 128 bits: 2.9 standard deviations above what a similarity of 0.8 makes differ.
WIDE_RADIUS = 31
#: Members of a bucket that are compared in one task.
BLOCK = 4096
#: A text proposes its nearest partner in the first round, a component so many times more pairs in each later one.
PROPOSED = 8
#: Pairs that are handed on at once.
HANDED = 1 << 18


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)  # fixed values: the primes of XXH64


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for many slices at once; slices of 32 bytes and more go to the library one by one."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(sizes >= 32)
    if len(long):
        raw = data.tobytes()
        digest = xxhash.xxh64_intdigest
        out[long] = np.array([digest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], np.uint64)
    short = np.flatnonzero(sizes < 32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each position on
    at, left = starts[short], sizes[short]
    h = (np.uint64(seed) + _P5) + left.astype(np.uint64)
    for k in range(3):
        own = np.flatnonzero(left >= 8 * (k + 1))
        lane = _rotated(eights[at[own] + 8 * k] * _P2, 31) * _P1
        h[own] = _rotated(h[own] ^ lane, 27) * _P1 + _P4
    at, left = at + (left & ~7), left & 7
    own = np.flatnonzero(left >= 4)
    h[own] = _rotated(h[own] ^ ((eights[at[own]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at, left = at + (left & 4), left & 3
    for k in range(3):
        own = np.flatnonzero(left > k)
        h[own] = _rotated(h[own] ^ (padded[at[own] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[short] = h ^ (h >> np.uint64(32))
    return out


#: Byte to eight lanes of a 64-bit word: lane i is bit i, so that sums of up to 255 rows stay inside their lanes.
_LANES = sum((((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i)) for i in range(8))


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for the runs of ``hashes`` that begin at ``first``."""
    sizes = np.diff(np.append(first, len(hashes)))
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lanes = np.add.reduceat(_LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], np.repeat(first, pieces) + 255 * nth, axis=0)
    counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 64).astype(np.int64)
    return np.add.reduceat(counts, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the word shingles of UTF-8 texts in order, the texts that have any, and where each of those begins."""
    plain = [b" ".join(t.lower().split()) for t in texts]  # bytes: A-Z only, and splits on \x20\x09-\x0D
    data = np.frombuffer(b" ".join(plain), np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in plain)])
    bounds[-1] = max(bounds[-1] - 1, 0)
    starts, ends, rows = common.find_words(data, bounds)
    words = np.diff(rows)
    some = np.flatnonzero(words)
    totals = np.maximum(words[some] - size + 1, 1)
    first = np.cumsum(totals) - totals
    opens = np.arange(totals.sum()) - np.repeat(first - rows[some], totals)
    closes = opens + np.repeat(np.minimum(words[some], size) - 1, totals)
    return hash_slices(data, starts[opens], ends[closes]), some, first


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    totals = np.diff(np.append(first, len(hashes)))
    return np.packbits(2 * bit_counts(hashes, first) > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(texts: list[bytes]) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts."""
    out = np.zeros(len(texts), np.uint64)
    hashes, some, first = _shingles(texts, SHINGLE)
    if len(some):
        out[some] = _majority(hashes, first)
    return out


def wide_fingerprint(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``WIDE`` longs a text, over its distinct shingles; each long sees the shingles' hashes scrambled anew.  And their parities in ``PARITY`` longs of bins, and their number."""
    out, parity, sizes = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), PARITY), np.uint64), np.zeros(len(texts), np.int64)
    hashes, some, first = _shingles(texts, WIDE_SHINGLE)
    if len(some):
        owner = np.repeat(np.arange(len(some)), np.diff(np.append(first, len(hashes))))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, first = hashes[new], np.searchsorted(owner[new], np.arange(len(some)))
        scrambled = lambda k: common.mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        for k in range(WIDE):
            out[some, k] = _majority(scrambled(k), first)
        places = scrambled(WIDE) % np.uint64(64 * PARITY)
        for k in range(PARITY):
            ones = np.where(places >> np.uint64(6) == k, np.uint64(1) << (places & np.uint64(63)), np.uint64(0))
            parity[some, k] = np.bitwise_xor.reduceat(ones, first)
        sizes[some] = np.diff(np.append(first, len(hashes)))
    return out, parity, sizes


def may_be_similar(parity: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs but those whose sets can't have a similarity of 0.8, that is no more than a ninth of both sizes' sum in one of them alone."""
    alone = np.maximum(np.bitwise_count(parity[i] ^ parity[j]).sum(1).astype(np.int64), np.abs(sizes[i] - sizes[j]))
    return 9 * alone <= sizes[i] + sizes[j]


@cache
def _key_places() -> np.ndarray:
    """The bits that make up each table's key."""
    return np.stack([np.random.default_rng(t).choice(64 * WIDE, KEY_BITS, replace=False) for t in range(TABLES)])


def table_keys(wide: np.ndarray) -> np.ndarray:
    """One number a table for each wide fingerprint."""
    bits = np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(wide), 8 * WIDE), axis=1, bitorder="little")
    keys = np.tile(np.arange(TABLES, dtype=np.int64) << KEY_BITS, (len(wide), 1))
    for k in range(KEY_BITS):  # a bit of all keys at a time
        keys += bits[:, _key_places()[:, k]].astype(np.int64) << k
    return keys


@cache
def _key_masks() -> np.ndarray:
    """The same as bits of the longs of a wide fingerprint."""
    out = np.zeros((TABLES, WIDE), np.uint64)
    for k in range(KEY_BITS):
        at = _key_places()[:, k]
        out[np.arange(TABLES), at >> 6] |= np.uint64(1) << (at & 63).astype(np.uint64)
    return out


def in_first_table(differing: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Pairs, by their ``differing`` bits (n x longs), that agree in no table before ``table``."""
    out = np.ones(len(table), bool)
    for t in range(int(table.max(initial=0))):
        at = np.flatnonzero(out & (table > t))
        out[at] = (differing[at] & _key_masks()[t]).any(1)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``id, fp`` (signed 64-bit) of every row of ``docs`` (columns ``doc_id`` and ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, bounds in common.blocks(batch.column("text")):
                raw = data.tobytes()
                found.append(fingerprint([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]))
            fps = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")], run, "id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """One row of packed bits for each bit of the ``values`` (n x longs): 64 values a word (padding is zero)."""
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: sum and carry of three bits in every lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above ``radius``; the last counter is the sticky overflow."""
    more, same = counters[-1].copy(), ~counters[-1]
    for k in range(len(counters) - 2, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def within(planes: np.ndarray, word: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of a word and a value (n x longs): packed flags of the word's lanes within ``radius`` bits of the value."""
    alive = np.arange(len(word))
    width = max(3, radius.bit_length())  # bits 0 to width - 1, and the overflow
    counters = [np.zeros(len(word), np.uint64) for _ in range(width + 1)]
    out = np.zeros(len(word), np.uint64)
    for at in range(0, len(planes), 8):
        own = value[alive, at >> 6]
        x = [planes[at + k, word[alive]] ^ (np.uint64(0) - ((own >> np.uint64((at + k) & 63)) & np.uint64(1))) for k in range(8)]
        ones, twos, fours = counters[:3]
        ones, a = _added(ones, x[0], x[1])
        ones, b = _added(ones, x[2], x[3])
        ones, c = _added(ones, x[4], x[5])
        ones, d = _added(ones, x[6], x[7])
        twos, a = _added(twos, a, b)
        twos, b = _added(twos, c, d)
        fours, carry = _added(fours, a, b)
        counters[:3] = ones, twos, fours
        for k in range(3, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        counters[width] |= carry
        past = _beyond(counters, radius)
        keep = past != _FULL
        if not keep.all():
            alive, past, counters = alive[keep], past[keep], [c[keep] for c in counters]
            if not len(alive):
                return out
    out[alive] = ~past
    return out


def neighbours(values: np.ndarray, cuts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(i, j)``, i < j, of ``values`` (n x longs) within ``radius`` bits, inside each of the buckets that begin at ``cuts``.

    Every bucket takes whole words of the planes.  Pairs come in pieces of bounded size, in order of i.
    """
    sizes = np.diff(np.append(cuts, len(values)))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))  # what is alone in its bucket has no pair
    if not len(several):
        return
    values, sizes = values[several], sizes[sizes > 1]
    cuts, n = np.cumsum(sizes) - sizes, len(values)
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    bucket = np.repeat(np.arange(len(cuts)), sizes)
    place = np.arange(n) - cuts[bucket]
    padded = np.zeros((int(words.sum()) * 64, values.shape[1]), np.uint64)
    slot = first_word[bucket] * 64 + place
    padded[slot] = values
    owner = np.full(len(padded), -1, np.int64)
    owner[slot] = np.arange(n)
    planes = bit_planes(padded)
    each = words[bucket] - place // 64  # a value meets the words from its own on
    ends = np.cumsum(each)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(at, end), each[at:end])
        word = first_word[bucket[i]] + place[i] // 64 + np.arange(len(i)) - np.repeat(ends[at:end] - each[at:end] - (ends[at - 1] if at else 0), each[at:end])
        flags = within(planes, word, values[i], radius)
        some = np.flatnonzero(flags)
        lanes = np.cumsum(np.bitwise_count(flags[some]).astype(np.int64))
        low = 0
        while low < len(some):  # a dense bucket has many pairs a word
            high = max(low + 1, int(np.searchsorted(lanes, (lanes[low - 1] if low else 0) + HANDED, "right")))
            own = some[low:high]
            row, lane = np.nonzero(np.unpackbits(flags[own].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            left, right = i[own[row]], owner[word[own[row]] * 64 + lane]
            later = right > left
            yield several[left[later]], several[right[later]]
            low = high
        at = end


def forests(values: np.ndarray, cuts: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Index pairs (m x 2) that span the components of each bucket's ``values`` (n x longs) under distance <= ``radius``."""
    parent, out = np.arange(len(values)), [np.zeros((0, 2), np.int64)]
    for i, j in neighbours(values, cuts, radius):
        while len(i):
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            high, first = np.unique(high, return_index=True)  # each root is hooked to one smaller root
            parent[high] = low[first]
            out.append(np.stack([i[first], j[first]], 1))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return np.concatenate(out)


def _quarter_pairs(fp, quarters: list[tuple[int, int]]):
    """Keys of every pair of ``quarters`` (offset, width): at most two differing bits leave two of four whole."""
    keys = []
    for n, ((a, w), (b, v)) in enumerate(combinations(quarters, 2)):
        part = lambda at, width: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.shiftleft(F.lit(n).cast("long"), w + v) + F.shiftleft(part(a, w), v) + part(b, v))
    return F.explode(F.array(*keys))


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str], limit: int | None = None) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]]:
    """Whole buckets of rows sorted by ``key``, many at a time: ``(cuts, columns, over)``.

    With ``limit`` no more of a bucket is gathered than just beyond it; the rest of its
    rows come as they are read, marked in ``over`` like those before them.
    """
    held: list[dict[str, np.ndarray]] = []
    current, passed = None, 0  # the last key, and how many of its rows are gone

    def close(columns: dict[str, np.ndarray], whole: bool):
        nonlocal current, passed
        key = columns["key"]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        sizes = np.diff(np.append(cuts, len(key)))
        seen = sizes.copy()
        if key[0] == current:
            seen[0] += passed
        end = len(key) if whole or (limit and seen[-1] > limit) else int(cuts[-1])
        rest = {n: c[end:] for n, c in columns.items()}
        over = np.repeat(seen > limit, sizes)[:end] if limit else np.zeros(end, bool)
        if end == len(key):
            current, passed = key[-1], int(seen[-1])
        return cuts[cuts < end], {n: c[:end] for n, c in columns.items()}, over, rest

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in names})
            rows += batch.num_rows
        if rows >= GATHERED:
            cuts, columns, over, rest = close({n: np.concatenate([h[n] for h in held]) for n in names}, False)
            held, rows = [rest], len(rest["key"])
            if len(cuts):
                yield cuts, columns, over
    if rows:
        cuts, columns, over, _ = close({n: np.concatenate([h[n] for h in held]) for n in names}, True)
        yield cuts, columns, over


def _spanned(dealt: DataFrame, limit: int | None) -> DataFrame:
    """``a, b, key``: spanning edges of the buckets of ``(key, fp)``; rows of buckets beyond ``limit`` come back with a null ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cuts, columns, over in _buckets(batches, ["key", "fp"], limit):
            fp, key = columns["fp"].astype(np.int64), columns["key"].astype(np.int64)
            kept = np.flatnonzero(~over)
            new = np.diff(key[kept], prepend=key[kept[:1]] - 1) != 0 if len(kept) else kept
            pairs = fp[kept][forests(fp[kept].view(np.uint64).reshape(-1, 1), np.flatnonzero(new))] if len(kept) else np.zeros((0, 2), np.int64)
            yield pa.record_batch(
                [pa.array(np.concatenate([pairs[:, 0], fp[over]])), pa.array(np.concatenate([pairs[:, 1], fp[over]]), mask=np.concatenate([np.zeros(len(pairs), bool), np.ones(int(over.sum()), bool)])), pa.array(np.concatenate([np.zeros(len(pairs), np.int64), key[over]]))],
                ["a", "b", "key"],
            )

    return dealt.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def links(fps: DataFrame) -> DataFrame:
    """Spanning edges ``(a, b)`` between distinct fingerprints ``fp`` within ``RADIUS`` bits of each other."""
    quarters = [(0, 16), (16, 16), (32, 16), (48, 16)]
    found = common.written(_spanned(fps.select("fp", _quarter_pairs(F.col("fp"), quarters).alias("key")), BUCKET), "links")
    edges, large = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL")
    # buckets that were passed on in part: the rows gathered before the bound was reached are dealt again too
    if large.head(1):
        for n, held in enumerate(combinations(quarters, 2)):
            eighths = [(at + k, 8) for at, _ in quarters if (at, 16) not in held for k in (0, 8)]
            again = large.where(F.shiftright("key", 32) == n).select(F.col("a").alias("fp"), F.col("key").alias("key1"), _quarter_pairs(F.col("a"), eighths).alias("key2"))
            # two buckets whose hashes meet are compared as one, which adds no link
            edges = edges.union(_spanned(again.select("fp", F.xxhash64("key1", "key2").alias("key")), None).select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``id, fp`` (signed) and ``component_id``, the smallest id reachable."""
    marked = common.written(fingerprints(docs), "fingerprints")
    fps = common.written(marked.groupBy("fp").agg(F.min("id").alias("smallest")), "distinct-fps")
    roots = components(links(fps))
    named = fps.join(roots, fps.fp == roots.id, "left").select("fp", F.coalesce("root", "fp").alias("root"), "smallest")
    named = common.written(named, "fp-roots")
    least = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("id", "fp", "component_id")


# ---- by similarity -------------------------------------------------------------


_LONGS = [f"f{k}" for k in range(WIDE)]
_PARITIES = [f"p{k}" for k in range(PARITY)]
_SKETCH = [*_LONGS, *_PARITIES, "shingles"]
_PROPOSAL = "j long, i long, d int, key long, label long"


def _wide(docs: DataFrame) -> DataFrame:
    """``row``, its sketch and ``keys`` of every row of ``docs`` (columns ``row`` and ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in common.blocks(batch.column("text")):
                raw = data.tobytes()
                wide, parity, sizes = wide_fingerprint([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(wide) * TABLES + 1, TABLES), pa.int32()), pa.array(table_keys(wide).astype(np.int32).ravel()))
                longs = [pa.array(np.ascontiguousarray(x[:, k]).view(np.int64)) for x in (wide, parity) for k in range(x.shape[1])]
                yield pa.record_batch([batch.column("row").slice(at, end - at), *longs, pa.array(sizes.astype(np.int32)), keys], ["row", *_SKETCH, "keys"])

    longs = ", ".join(f"{c} long" for c in [*_LONGS, *_PARITIES])
    return common.map_texts(docs, [F.col("row"), F.col("text")], run, f"row long, {longs}, shingles int, keys array<int>")


def _nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray, row: np.ndarray, columns: dict, at_once: int, one_sided: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """In each cell the ``at_once`` nearest pairs of each component (a row is its own in the first round) on either end of the pairs (indices); ties are broken at random, but alike every time."""
    left, right, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
    if one_sided is not None:
        own = one_sided[left]
        left, right, d = left[own], right[own], d[own]
    label = columns.get("label", row)
    cell = columns["key"]
    order = np.lexsort((common.mix(row[left].astype(np.uint64) ^ common.mix(row[right].astype(np.uint64))), d, label[left], cell[left]))
    left, right, d = left[order], right[order], d[order]
    group = np.cumsum((np.diff(label[left], prepend=0) != 0) | (np.diff(cell[left], prepend=0) != 0))
    first = np.flatnonzero(np.arange(len(left)) - np.searchsorted(group, group) < at_once)
    left, right = left[first], right[first]
    yield pa.record_batch([pa.array(row[left]), pa.array(row[right]), pa.array(d[first].astype(np.int32)), pa.array(columns["bucket"][left]), pa.array(label[left])], ["j", "i", "d", "key", "label"])


def _distances(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[i] ^ values[j]).sum(1).astype(np.int64)


def _tried(row: np.ndarray, partners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of a block's rows stands among its distinct ones, and the pairs with the ``partners`` of each (arrays or None) among those as sorted numbers."""
    distinct, place = np.unique(row, return_inverse=True)
    some = [k for k, p in enumerate(partners) if p is not None]
    if not some:
        return place, place[:0]
    other = np.concatenate([partners[k] for k in some])
    own = np.repeat(place[some], [len(partners[k]) for k in some])
    found = np.minimum(np.searchsorted(distinct, other), len(distinct) - 1)
    here = distinct[found] == other
    return place, np.unique((np.minimum(own, found) << 32 | np.maximum(own, found))[here])


def _candidates(cells: DataFrame, at_once: int, apart: bool) -> DataFrame:
    """Proposals ``(j, i, d, key, label)``: the ``at_once`` nearest of each row, in each cell (``key``) of rows ``(key, bucket, row)`` and their sketches.

    With ``apart`` they are those of each component; rows carry ``label``, ``rest`` (whether they propose) and ``tried``: partners of
    the same label and those tried before don't count.  All rows that have a partner come once more, as ``j`` of a null ``i``.
    """
    names = ["key", "bucket", "row", *_SKETCH, *(["label", "rest", "tried"] if apart else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cuts, columns, _ in _buckets(batches, names):
            columns = {n: c if c.dtype in (bool, object) else c.astype(np.int64) for n, c in columns.items()}
            row, bucket, sizes = columns["row"], columns["bucket"], columns["shingles"]
            values, parity = (np.stack([columns[c].view(np.uint64) for c in names], 1) for names in (_LONGS, _PARITIES))
            place, codes = _tried(row, columns["tried"]) if apart else (row, row[:0])
            for i, j in neighbours(values[:, :COMPARED], cuts, WIDE_RADIUS):
                if apart:
                    own = columns["label"][i] != columns["label"][j]
                    i, j = i[own], j[own]
                    if len(codes):
                        a, b = place[i], place[j]
                        pair = (np.minimum(a, b) << 32) | np.maximum(a, b)
                        own = codes[np.minimum(np.searchsorted(codes, pair), len(codes) - 1)] != pair
                        i, j = i[own], j[own]
                own = may_be_similar(parity, sizes, i, j)
                i, j = i[own], j[own]
                own = in_first_table(values[i] ^ values[j], bucket[i] >> KEY_BITS)
                i, j = i[own], j[own]
                if len(i):
                    yield from _nearest(i, j, _distances(values[:, :COMPARED], i, j), row, columns, at_once, columns["rest"] if apart else None)
                    if apart:
                        live = np.unique(np.stack([np.concatenate([bucket[i], bucket[j]]), np.concatenate([row[i], row[j]])], 1), axis=0)
                        none = [pa.nulls(len(live), t) for t in (pa.int64(), pa.int32(), pa.int64())]
                        yield pa.record_batch([pa.array(live[:, 1]), none[0], none[1], pa.array(live[:, 0]), none[2]], ["j", "i", "d", "key", "label"])

    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(run, _PROPOSAL)


def _first_round(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals of all buckets, blocks compared inside; and the sizes of buckets of more than one block."""
    dealt = wide.select("row", *_SKETCH, F.explode(F.col("keys").cast("array<long>")).alias("bucket"))
    large = common.written(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large-buckets")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))
    cells = dealt.join(common.if_small(large), "bucket", "left").withColumn("key", F.shiftleft(F.col("bucket"), 32) + F.pmod(F.xxhash64("row", "bucket"), blocks))
    return _candidates(cells.select("key", "bucket", "row", *_SKETCH), 1, False), large


def _later_round(members: DataFrame, live: DataFrame, labels: DataFrame, tried: DataFrame, at_once: int) -> DataFrame:
    """Proposals between different components of each bucket, among its ``live`` rows ``(row, bucket)``; ``members`` have the rows' sketches."""
    live = common.written(live.join(labels, "row", "left").select("row", "bucket", F.coalesce("label", "row").alias("label")), "live")
    sizes = live.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).where("n > top.n")
    mixed = common.written(mixed.select("bucket", F.col("top.label").alias("top"), F.ceil(F.col("top.n") / BLOCK).alias("tops"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("rests")), "mixed-buckets")
    before = tried.groupBy(F.col("j").alias("row"), F.col("key").alias("bucket")).agg(F.collect_set("i").alias("tried"))
    live = live.join(mixed, "bucket").withColumn("rest", F.col("label") != F.col("top"))
    members = live.join(before, ["row", "bucket"], "left").join(members, "row")
    own = F.pmod(F.xxhash64("row", "bucket"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("tops")))
    members = members.withColumn("own", own)
    # cells: a block of the largest component with one of the rest, and every two blocks of the rest; one of each is one cell
    alone = F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    cells = F.when((F.col("tops") == 1) & (F.col("rests") == 1), alone).when(
        F.col("rest"),
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("tops") - 1), lambda a: F.struct(F.lit(0).alias("kind"), a.alias("a"), F.col("own").alias("b"))),
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda b: F.struct(F.lit(1).alias("kind"), F.least("own", b).alias("a"), F.greatest("own", b).alias("b"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda b: F.struct(F.lit(0).alias("kind"), F.col("own").alias("a"), b.alias("b"))))
    cells = members.withColumn("cell", F.explode(cells))
    return _candidates(cells.select(F.xxhash64("bucket", "cell").alias("key"), "bucket", "row", *_SKETCH, "label", "rest", "tried"), at_once, True)


def jaccard(a: bytes, b: bytes, size: int = WIDE_SHINGLE) -> float:
    """Similarity of two texts' sets of word shingles; texts without words are alike."""

    def shingles(text: bytes) -> set[tuple[bytes, ...]]:
        words = text.lower().split()
        return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)}

    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``j, i, key, alike`` of each pair, from their whole texts.  Texts that many pairs ask for are sent along several lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [jaccard(a.as_py().encode(), b.as_py().encode()) >= SIMILARITY for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]  # two texts at a time
            yield pa.record_batch([batch.column("j"), batch.column("i"), batch.column("key"), pa.array(alike, pa.bool_())], ["j", "i", "key", "alike"])

    lane = F.pmod(F.xxhash64("i", "j"), F.lit(64))
    for end, name in (("j", "a"), ("i", "b")):
        pairs = pairs.withColumn("lane", lane)
        wanted = pairs.select(F.col(end).alias("row"), "lane").distinct().join(texts.select("row", F.col("text").alias(name)), "row")
        pairs = pairs.join(wanted.withColumnRenamed("row", end), [end, "lane"])
    return pairs.select("j", "i", "key", "a", "b").mapInArrow(run, "j long, i long, key long, alike boolean")


def similar(docs: DataFrame) -> DataFrame:
    """``row, label`` of the rows of ``docs`` (a unique ``row`` and ``text``) that another is similar to; a component's rows share a label."""
    texts = docs.select("row", F.coalesce("text", F.lit("")).alias("text"))
    wide = common.written(_wide(texts), "wide-fingerprints")
    proposals, large = _first_round(wide)
    proposals = common.written(proposals, "proposals")
    # who goes on: rows with a partner in the bucket, and all of a bucket that was cut
    live = proposals.select(F.col("j").alias("row"), F.col("key").alias("bucket"))
    if large.head(1):
        dealt = wide.select("row", F.explode(F.col("keys").cast("array<long>")).alias("bucket"))
        live = live.union(dealt.join(large.select("bucket"), "bucket").select("row", "bucket"))
    live = live.distinct()
    members = common.written(wide.select("row", *_SKETCH).join(live.select("row").distinct(), "row", "left_semi"), "members")
    spark = docs.sparkSession
    verified = spark.createDataFrame([], "j long, i long, key long, alike boolean")
    labels = spark.createDataFrame([], "row long, label long")
    at_once = 1
    while True:
        best = proposals.where("i IS NOT NULL").groupBy("label", "j", "i").agg(F.min("d").alias("d"), F.min("key").alias("key")).withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("d", F.xxhash64("i", "j"))))
        pairs = best.where(F.col("nth") <= at_once).select(F.greatest("j", "i").alias("j"), F.least("j", "i").alias("i"), "key").distinct()
        fresh = common.written(_verified(pairs, texts), "verified")
        found = fresh.agg(F.max("alike")).first()[0]
        if found is None:  # nothing was proposed
            break
        verified = verified.union(fresh)
        if found:
            labels = common.written(components(verified.where("alike").select(F.col("j").alias("a"), F.col("i").alias("b"))).select(F.col("id").alias("row"), F.col("root").alias("label")), "labels")
        at_once *= PROPOSED
        proposals = common.written(_later_round(members, live, labels, verified.where("NOT alike"), at_once), "proposals")
        live = proposals.select(F.col("j").alias("row"), F.col("key").alias("bucket")).distinct()
        common.release(spark)
    return labels


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
