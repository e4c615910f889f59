"""Encoding and decoding with a SentencePiece BPE model by a table of last tokens.

For every prefix of a text the table holds the one token that ends the prefix's
encoding.  An automaton over the pieces gives the tokens that end at a position; the
last token is the one that starts at the text's start, or whose predecessor (the last
token of the prefix before it) is compatible with it: the pair, encoded on its own,
stays that pair.  Ids are recovered from the end backwards.  Time is linear in the
text, whatever it holds.

No piece of such models has a white-space mark after another character, so a text
falls into chunks (marks, then other characters) that are encoded one by one; whether
this holds is checked when the model is read.  Encoded chunks and tested pairs are
kept in bounded dictionaries.  Characters outside the vocabulary
become byte pieces (or the unknown piece).

Nulls and edge cases: a null or empty text has no ids and decodes to the empty text;
the mark U+2581 in a text is a space, as in the library; null and repeated ids are kept.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import common

MARK = "▁"
#: Chunks in one generation of the cache, and tested pairs kept.
CACHE = 250_000
PAIRS = 400_000
#: Longer chunks are encoded but not kept.
CACHED_CHARS = 64
#: Characters encoded at once; texts are cut where a chunk begins.
PART_CHARS = 1 << 18
#: Piece types and the surface of the unknown piece in the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_SURFACE = " ⁇ "

codecs.register_error("weft-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool
    trees: dict[str, tuple[str, str] | None]  # the pieces that merges can make, with the two parts of the last merge


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        elif key & 7 == 5:
            yield key >> 3, raw[at : at + 4]
            at += 4
        elif key & 7 == 1:
            yield key >> 3, raw[at : at + 8]
            at += 8
        else:
            raise ValueError("not a SentencePiece model")


def merged(symbols: list[str], rank: dict[str, float], made: dict | None = None) -> list[str]:
    """Plain BPE: again and again the best-scored adjacent pair, the leftmost of equals, becomes one.

    ``made``, if given, gets the two parts of the last merge.
    """
    symbols = list(symbols)
    while len(symbols) > 1:
        best, where = None, -1
        for i in range(len(symbols) - 1):
            score = rank.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, where = score, i
        if where < 0:
            break
        if made is not None:
            made["last"] = symbols[where], symbols[where + 1]
        symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
    return symbols


def read_model(path: str) -> Model:
    """Read a model file on the driver; raises for what this encoder doesn't do."""
    pieces, scores, types = [], [], []
    bpe, charsmap, dummy, extra, escape = 1, b"", 1, 1, 1
    with open(path, "rb") as file:
        raw = file.read()
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            types.append(own.get(3, NORMAL))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1)
        elif number == 3:
            own = dict(_fields(value))
            charsmap, dummy, extra, escape = own.get(2, b""), own.get(3, 1), own.get(4, 1), own.get(5, 1)
    if bpe != 2 or charsmap or extra or not escape or USER in types or UNUSED in types:
        raise ValueError("only BPE models without normalisation or user-defined pieces are supported")
    rank = {p: s for p, s, t in zip(pieces, scores, types, strict=True) if t == NORMAL}
    trees: dict[str, tuple[str, str] | None] = {}
    for piece in rank:
        made: dict = {}
        if merged(list(piece), rank, made) == [piece]:
            trees[piece] = made.get("last")
    return Model(pieces, scores, types, bool(dummy), trees)


class _Cache:
    """A dictionary that forgets what wasn't used for a generation."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    def __init__(self, model: Model) -> None:
        self.model = model
        normal = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        self.id = {p: normal[p] for p in model.trees}
        # when a piece is made: a single character is there from the start, a better score is earlier
        self.time = {p: -model.scores[i] for p, i in normal.items()}
        # pieces that score above a part they are made of: their pairs are tested by plain encoding
        self.odd: set[str] = set()
        for p in sorted(model.trees, key=len):
            if (tree := model.trees[p]) and any(x in self.odd or model.trees[x] and self.time[x] >= self.time[p] for x in tree):
                self.odd.add(p)
        self.rank = {p: model.scores[i] for p, i in normal.items()}
        self.spines: dict[tuple[int, int], list[tuple[str, float, float]]] = {}
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.unknown = model.types.index(UNKNOWN)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.alone = {p for p in self.id if len(p) == 1}
        self.length = {i: len(p) for p, i in self.id.items()}
        inner = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if a != MARK}
        joined = {c for p in self.id if len(p) > 1 for c in p}
        if MARK in inner:
            self.chunk = re.compile(r"(?s).+")
        else:  # line ends that no longer piece holds part chunks as well
            ends = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
            self.chunk = re.compile(f"{MARK}+[^{MARK}{ends}]*|[^{MARK}{ends}]+|[{ends}]" if ends else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cut = None if MARK in inner else re.compile(f"[^{MARK}](?={MARK})")
        self.chunks, self.pairs = _Cache(CACHE), {}
        self.base = len(model.pieces)
        self.surface = [
            p.replace(MARK, " ").encode() if t == NORMAL else bytes([int(p[1:-1], 16)]) if t == BYTE else UNKNOWN_SURFACE.encode() if t == UNKNOWN else b""
            for p, t in zip(model.pieces, model.types, strict=True)
        ]

    def _spine(self, token: int, side: int) -> list[tuple[str, float, float]]:
        """The token and its last (side 1) or first (side 0) parts, downwards: each with the times it is made and used up."""
        found = self.spines.get((token, side))
        if found is None:
            found, piece, end = [], self.model.pieces[token], float("inf")
            while True:
                tree = self.model.trees[piece]
                born = self.time[piece] if tree else -1.0
                found.append((piece, born, end))
                if not tree:
                    break
                piece, end = tree[side], born
            self.spines[token, side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's text and b's text together is a, b.

        It is unless some merge crosses the border: of a part x that ends a and a part y
        that begins b, both there at a time, whose joint piece comes before x or y is
        used up.  Of merges of one piece the leftmost is first: inside a, then across,
        then inside b.
        """
        left, right, time = self.model.pieces[a], self.model.pieces[b], self.time
        if left in self.odd or right in self.odd:
            return merged(list(left + right), self.rank) == [left, right]
        for x, x_born, x_end in self._spine(a, 1):
            for y, y_born, y_end in self._spine(b, 0):
                if y_born < x_end and x_born <= y_end and (t := time.get(x + y)) is not None and t < x_end and t <= y_end:
                    return False
        return True

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        base, pairs, tested = self.base, self.pairs, self.pairs.get
        if len(pairs) > PAIRS:
            pairs.clear()
        last = [0] * len(text)
        at = -1
        for end, (size, token) in self.automaton.iter(text):
            if end == at:
                continue  # this prefix has its last token
            start = end - size
            if start >= 0:
                key = last[start] * base + token
                fits = tested(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(last[start], token)
                if not fits:
                    continue
            last[end] = token
            at = end
        length = self.length
        out = []
        end = len(text)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= length[token]
        out.reverse()
        return out

    def _encoded(self, chunk: str) -> list[int]:
        if chunk in self.id:
            return [self.id[chunk]]
        if self.alone.issuperset(chunk):
            return self._known(chunk)
        out: list[int] = []
        run = 0
        for i, c in enumerate(chunk):
            if c not in self.alone:
                if run < i:
                    out += self._known(chunk[run:i])
                out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                run = i + 1
        if run < len(chunk):
            out += self._known(chunk[run:])
        return out

    def parts(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str]]]:
        """Runs of chunks, each with its ids and the ids as text."""
        if not text:
            return
        text = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        at = 0
        while at < len(text):
            cut = self.cut.search(text, at + PART_CHARS) if self.cut and len(text) - at > PART_CHARS else None
            end = cut.end() if cut else len(text)
            out = []
            for chunk in self.chunk.findall(text, at, end):
                found = self.chunks.young.get(chunk) or self.chunks.get(chunk)
                if found is None:
                    ids = self._encoded(chunk)
                    found = tuple(ids), ",".join(map(str, ids))
                    if len(chunk) <= CACHED_CHARS:
                        self.chunks.put(chunk, found)
                out.append(found)
            yield out
            at = end

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for ids, _ in part for i in ids]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Surface bytes, with the space of the dummy prefix still in front."""
        surface = self.surface
        return b"".join([surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        text = self.decode_bytes(ids).decode("utf-8", "weft-each-byte")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        n, of_ids, of_text, first = 0, hashlib.sha256(), hashlib.sha256(), True
        for part in self.parts(text):
            ids = [i for own, _ in part for i in own]
            n += len(ids)
            of_ids.update((("" if first else ",") + ",".join([s for _, s in part])).encode())
            surface = self.decode_bytes(ids)
            if first and self.model.dummy_prefix and surface.startswith(b" "):
                surface = surface[1:]
            # a part ends before a mark, so no character is split between parts
            of_text.update(surface.decode("utf-8", "weft-each-byte").encode("utf-8", "surrogatepass"))
            first = False
        return n, of_ids.hexdigest(), of_text.hexdigest()


_here: dict[int, Codec] = {}


def _codec_here(sent) -> Codec:
    """One codec for each Python worker and model; its caches live as long as the worker."""
    key = id(sent.value)  # a worker reads a broadcast value once
    if key not in _here:
        _here.clear()
        _here[key] = Codec(sent.value)
    return _here[key]


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """``id, ids`` of every row (columns ``doc_id`` and ``text``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_here(sent)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")], run, "id long, ids array<int>")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """``id, text`` of rows ``(id, ids)``; null ids decode to the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_here(sent)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return common.map_texts(encoded, [F.col("id").cast("long").alias("id"), F.col("ids").alias("ids")], run, "id long, text string")


def round_trip(docs: DataFrame, model: Model) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, and decoded from its ids, where it is."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_here(sent)
        for batch in batches:
            found = [codec.digests(t or "") for t in batch.column("text").to_pylist()]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")], run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> Model:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir), default_model()).withColumnRenamed("id", "doc_id")
