"""Elias-Fano coded monotone sequences over memory-mapped arrays, read many at a time.

A non-decreasing sequence of n values keeps the low bits of each value packed and the
high parts in unary: value i sets bit (value >> low) + i.  Directories hold, for each
64-bit word, the ones and the zeros before it.
"""

from __future__ import annotations

import json

import numpy as np

#: Position of the r-th one of a byte.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _IN_BYTE[_b, _r] = _i
_U = np.uint64


_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the ``rank``-th one of each word, all eight bytes of a word at a time."""
    x = words - ((words >> _U(1)) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
    upto = ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte i: ones of bytes 0 to i
    rank = rank.astype(np.uint64)
    at = np.bitwise_count((((rank * _ONES) | _TOPS) - upto) & _TOPS).astype(np.uint64) << _U(3)  # bytes whose ones are all before
    before = ((upto << _U(8)) >> at) & _U(255)
    octet = (words >> at) & _U(255)
    return at.astype(np.int64) + _IN_BYTE[octet, rank - before]


class EliasFano:
    """``arrays`` holds ``low`` (bytes), ``high`` (words), ``ones`` and ``zeros`` (directories)."""

    def __init__(self, n: int, bits: int, arrays: dict[str, np.ndarray]) -> None:
        self.n, self.bits, self.a = n, bits, arrays

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
        octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]  # the bytes that hold low bits
        parts = [  # bounded pieces, each a whole number of bytes
            np.packbits(np.unpackbits(octets[k : k + 65536], axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little") for k in range(0, n, 65536)
        ]
        low = np.concatenate([*parts, np.zeros(8, np.uint8)])
        place = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 1
        high = np.zeros(size // 64 + 1, np.uint64)
        word, first = np.unique(place // 64, return_index=True)
        if n:
            high[word] = np.bitwise_or.reduceat(_U(1) << (place % 64).astype(np.uint64), first)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))[:-1]
        kind = np.uint32 if 64 * len(high) < 1 << 32 else np.int64
        return cls(n, bits, {"low": low, "high": high, "ones": ones.astype(kind), "zeros": (64 * np.arange(len(high)) - ones).astype(kind)})

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        raw = self.a["low"]
        words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))[at >> 3]
        return (words >> (at & 7).astype(np.uint64)) & _U((1 << self.bits) - 1)

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        directory = self.a["ones" if ones else "zeros"]
        word = np.searchsorted(directory, rank.astype(directory.dtype), "right") - 1
        held = self.a["high"][word]
        return word * 64 + _in_word(held if ones else ~held, rank - directory[word].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        if not len(i):
            return np.zeros(0, np.uint64)
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << _U(self.bits)) | self._low(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions ``i`` and ``i + 1``, the second by the next one of the same word wherever there is one."""
        place = self._select(i, True)
        after = (place & 63) + 1
        held = self.a["high"][place >> 6] >> np.minimum(after, 63).astype(np.uint64)
        held[after == 64] = 0
        following = place + 1 + np.bitwise_count((held & (_U(0) - held)) - _U(1)).astype(np.int64)
        rest = np.flatnonzero(held == 0)
        following[rest] = self._select(i[rest] + 1, True)
        bits = _U(self.bits)
        return ((place - i).astype(np.uint64) << bits) | self._low(i), ((following - i - 1).astype(np.uint64) << bits) | self._low(i + 1)

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Position of each value between positions ``low`` and ``high``, or -1: successor search in the value's bucket."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        bucket = (values >> _U(self.bits)).astype(np.int64)
        last = 64 * len(self.a["high"]) - self.n - 1  # the last zero
        own = np.flatnonzero(bucket <= last)
        bucket, wanted = bucket[own], values[own] & _U((1 << self.bits) - 1)
        place = np.zeros(len(own), np.int64)  # the bit at which the bucket's ones begin
        some = bucket > 0
        place[some] = self._select(bucket[some] - 1, False) + 1
        begin = place - bucket
        inside = place & 63
        rest = self.a["high"][place >> 6] >> inside.astype(np.uint64)
        ones = np.bitwise_count(rest & ~(rest + _U(1))).astype(np.int64)  # as many as follow one another
        end = begin + ones
        cut = np.flatnonzero(ones == 64 - inside)  # they may go on in the next word
        end[cut] = self._select(bucket[cut], False) - bucket[cut]
        if low is not None:
            begin, end = np.maximum(begin, low[own]), np.minimum(end, high[own])
        top = end.copy()
        todo = np.flatnonzero(end - begin > 1)  # one alone is just compared below
        while len(todo):
            mid = (begin[todo] + end[todo]) // 2
            less = self._low(mid) < wanted[todo]
            begin[todo[less]] = mid[less] + 1
            end[todo[~less]] = mid[~less]
            todo = todo[begin[todo] < end[todo]]
        hit = np.flatnonzero(begin < top)
        hit = hit[self._low(begin[hit]) == wanted[hit]]
        out[own[hit]] = begin[hit]
        return out


def pack(parts: dict[str, EliasFano | np.ndarray]) -> bytes:
    """Sequences and plain arrays as one file: a header, then every array at a multiple of eight bytes."""
    header, blobs, at = {}, [], 0
    for name, part in parts.items():
        arrays = part.a if isinstance(part, EliasFano) else {"": part}
        entry = {"n": part.n, "bits": part.bits} if isinstance(part, EliasFano) else {}
        for key, array in arrays.items():
            raw = np.ascontiguousarray(array).tobytes()
            entry[f"@{key}"] = [at, len(array), array.dtype.str]
            blobs.append(raw + bytes(-len(raw) % 8))
            at += len(blobs[-1])
        header[name] = entry
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(blobs)


def unpack(raw: np.ndarray) -> dict[str, EliasFano | np.ndarray]:
    """The parts of ``pack`` as views of ``raw`` (bytes, usually a memory map)."""
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out: dict[str, EliasFano | np.ndarray] = {}
    for name, entry in json.loads(raw[8 : 8 + size].tobytes()).items():
        arrays = {}
        for key, value in entry.items():
            if key[0] == "@":
                at, n, kind = value
                arrays[key[1:]] = np.ndarray((n,), kind, raw, 8 + size + at)
        out[name] = EliasFano(entry["n"], entry["bits"], arrays) if "n" in entry else arrays[""]
    return out
