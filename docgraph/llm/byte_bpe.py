"""Byte-level BPE: texts to token ids and back, by the ranks of a public vocabulary.

A text is split by a pattern, and each distinct piece of a batch is encoded once. Pieces go into padded matrices by length. In each
round every row merges its leftmost pair of the least rank, the matrix loses one column, and rows without a pair left go out. What a
pair merges to is found in a hash table of all pairs whose bytes together are a token. A piece longer than ``WIDEST`` is a matrix of
its own: a round merges all places of its pair, from the left, until a pair with a new token comes before them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

#: Bytes of the widest padded matrix, and cells of a matrix.
WIDEST, CELLS = 512, 1 << 19
#: Pieces that are encoded together, and distinct ones that a worker remembers (none of them longer than LONGEST_KEPT characters).
TOGETHER, KEPT, LONGEST_KEPT = 1 << 18, 1 << 18, 64
#: The rank of a pair that does not merge.
NEVER = np.int32(2**31 - 1)
_FREE = np.int64(-1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The tokens of a rank file, their ids (the ranks), and the table of pairs that merge."""

    def __init__(self, file: bytes):
        self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the vocabulary must hold all single bytes")
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, k in self.ids.items():
            self.tokens[k] = token
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(left, right, rank) for token, rank in self.ids.items() for left, right in self._halves(token)]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self._fill(left * len(self.tokens) + right, rank.astype(np.int32))

    def _halves(self, token: bytes) -> Iterator[tuple[int, int]]:
        for k in range(1, len(token)):
            left, right = self.ids.get(token[:k]), self.ids.get(token[k:])
            if left is not None and right is not None:
                yield left, right

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open table at most a quarter full; a key stands in the first free slot from its own on."""
        bits = max(10, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, _FREE), np.full(1 << bits, NEVER, np.int32)
        rest, slots = np.arange(len(keys)), self._slots(keys)
        while len(rest):
            free = rest[self.keys[slots[rest]] == _FREE]
            self.keys[slots[free]] = keys[free]  # of several the last one gets the slot
            own = self.keys[slots[rest]] == keys[rest]
            self.ranks[slots[rest[own]]] = ranks[rest[own]]
            rest = rest[~own]
            slots[rest] = (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER where it does not merge or an end is padding (-1)."""
        keys = left.astype(np.int64) * len(self.tokens) + right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], NEVER)
        rest = np.flatnonzero((held != keys) & (held != _FREE) & (keys >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            held = self.keys[slots[rest]]
            own = held == keys[rest]
            out[rest[own]] = self.ranks[slots[rest[own]]]
            rest = rest[~own & (held != _FREE)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > WIDEST:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                self._matrix([pieces[i] for i in rows[k : k + step]], rows[k : k + step], width, out)
        return out

    def _matrix(self, pieces: list[bytes], places: list[int], width: int, out: list[bytes]) -> None:
        """Writes the ids of ``pieces``, none longer than ``width``, to their places of ``out``."""
        length = np.array([len(p) for p in pieces])
        filled = np.arange(width) < length[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[filled] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        place = np.array(places)
        while len(ids):
            row = np.arange(len(ids))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            least = ranks[row, at] if ranks.shape[1] else np.full(len(ids), NEVER)
            done = least == NEVER
            if done.any():
                over = ids[done]
                for i, own, n in zip(place[done], over.astype("<u4"), (over >= 0).sum(axis=1)):
                    out[i] = own[:n].tobytes()
                ids, ranks, place, at, least = ids[~done], ranks[~done], place[~done], at[~done], least[~done]
                row = np.arange(len(ids))
            if not len(ids):
                return
            width = ids.shape[1]
            ids[row, at] = least
            stays = np.ones(ids.shape, bool)
            stays[row, at + 1] = False
            ids = ids[stays].reshape(-1, width - 1)
            stays = np.ones(ranks.shape, bool)
            stays[row, at] = False
            ranks = ranks[stays].reshape(-1, width - 2)
            for first in (at - 1, at):  # the pairs that end and begin with the new token
                inside = (first >= 0) & (first < width - 2)
                r, c = row[inside], first[inside]
                ranks[r, c] = self.merged(ids[r, c], ids[r, c + 1])

    def _long(self, piece: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.merged(ids[:-1], ids[1:])
        while len(ranks):
            least = ranks.min()
            if least == NEVER:
                break
            at = np.flatnonzero(ranks == least)
            # In a run of places that overlap, every other one merges, from the left.
            starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            run = np.repeat(starts, np.diff(starts, append=len(at)))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            # All merge at once, up to the first whose new pairs have a lower rank: that one is next.
            ends = np.concatenate([[-1], ids, [-1, -1]])
            before = np.where(np.diff(at, prepend=-9) == 2, least, ends[at])
            new = np.full(len(at), least)
            lower = np.flatnonzero(np.minimum(self.merged(before, new), self.merged(new, ends[at + 3])) < least)
            at = at[: lower[0] + 1] if len(lower) else at
            ids[at] = least
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            new = at - np.arange(len(at))
            near = np.union1d(new, new - 1)
            near = near[(near >= 0) & (near < len(ids) - 1)]
            ranks[near] = self.merged(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    def encode(self, texts: Iterable[str], pattern: regex.Pattern, kept: dict[str, bytes]) -> list[bytes]:
        """The packed ids of each text. ``kept`` remembers pieces from call to call; a long text is split part by part."""
        out: list[bytearray] = []
        parts: list[tuple[int, list[str]]] = []
        count = 0
        for i, text in enumerate(texts):
            out.append(bytearray())
            found = iter(pattern.findall(text)) if len(text) <= TOGETHER else (m.group() for m in pattern.finditer(text))
            while part := list(islice(found, TOGETHER)):
                parts.append((i, part))
                count += len(part)
                if count >= TOGETHER:
                    self._join(parts, kept, out)
                    parts, count = [], 0
        self._join(parts, kept, out)
        return [bytes(x) for x in out]

    def _join(self, parts: list[tuple[int, list[str]]], kept: dict[str, bytes], out: list[bytearray]) -> None:
        if len(kept) > KEPT:
            kept.clear()
        new = list({piece for _, part in parts for piece in part}.difference(kept))
        kept.update(zip(new, self.encode_pieces([piece.encode() for piece in new])))
        for i, part in parts:
            out[i] += b"".join(map(kept.__getitem__, part))
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del kept[piece]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _mapped(df: DataFrame, column: str, name: str, kind: pa.DataType, schema: str, of_slice) -> DataFrame:
    """``df`` with a column of what ``of_slice`` makes of ``column``, in slices of some megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                made = pa.array(of_slice(batch.column(column).to_pylist()), kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text, ...): the token ids of the whole text as packed little-endian 32-bit integers.

    ``path`` is a rank file (base64 of a token's bytes, and its rank, a line each); it is read once, by the driver, and sent along
    (some hundred kilobytes). ``pattern`` splits a text; each match is encoded by itself, without special tokens. Null text counts as empty and gives
    no ids. Bytes that are not UTF-8 are encoded as U+FFFD. Null ids are passed through, rows that repeat an id each give
    a row, other columns are ignored, and an empty table gives an empty result.
    """
    file, kept = _read(path), {}

    def of_slice(texts: list[bytes]) -> list[bytes]:
        return _vocabulary(file).encode([t.decode("utf-8", "replace") for t in texts], regex.compile(pattern), kept)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    out = _mapped(rows, "text", "ids", pa.binary(), f"doc_id {key}, text binary, ids binary", of_slice)
    return out.select("doc_id", "ids")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """The rows of (doc_id, ids) with ``decoded``, the bytes that the packed ids stand for; null ids count as none."""
    file = _read(path)

    def of_slice(ids: list[bytes]) -> list[bytes]:
        return list(map(_vocabulary(file).decode, ids))

    rows = coded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    key = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, "ids", "decoded", pa.binary(), f"doc_id {key}, ids binary, decoded binary", of_slice)


def token_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: the ids of the whole text, and what they decode to."""
    return decode(encode(docs, path, pattern), path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
