"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go.

Two lines are within one edit exactly if they are equal, or one without one character is the other,
or both without the character at the same place are equal. So a line's variants are itself and itself
without each of its characters. Variants travel as hashes; within a group of equal variants each line
meets only the earliest one that can be within an edit, never all of them, and the edit distance of
what meets is verified on the texts.

A variant for each character of a corpus would be many times its size, so two filters, which lose no
pair, come first. Of two lines within one edit, the first or the last h characters agree, where h is the
power of two up to half of the shorter length m: lines that share neither half with another line are
done (lines of one or two characters never are). The others are cut into 16 to 31 steps of equal length from either end; for an edit in some step, the
steps before it and those after it agree but for two. Only lines that share all but two steps with another
line emit variants, and only for the characters in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, join_groups
from .shingles import mix64, slices

#: Hashes that may be broadcast (16 MB); beyond that the lines are shuffled to them.
_BROADCAST_ROWS = 1_000_000
#: Bytes of text that are hashed at once: few enough that the arrays of their characters stay in the processor's cache.
_SLICE = 1 << 18
_HEAD, _TAIL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SALT = np.arange(1, 9, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)


class Lines:
    """The normalised non-blank lines of many texts, and hashes of any of their parts.

    A-Z is lower-cased, white space in a row becomes one space, and lines are trimmed. The hash of a part is the sum of its
    characters, each mixed with its place: counted from the start of the line (``head``), from its end (``tail``), or from the
    start with one character before it taken out (``moved``).
    """

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le"), np.uint32).copy()
        points += ((points >= 65) & (points <= 90)) * np.uint32(32)
        space = (points == 32) | ((points >= 9) & (points <= 13) & (points != 10))
        points[space] = 32
        # The first space of a run stays, unless the line begins or ends with it.
        keep = ~space
        keep[1:] |= ~space[:-1] & (points[:-1] != 10)
        points = points[keep]
        last = np.flatnonzero((points[:-1] == 32) & (points[1:] == 10))
        self.points = np.delete(points, last) if len(last) else points
        stop = np.flatnonzero(self.points == 10)
        start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
        n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
        doc = np.repeat(np.arange(len(texts)), n_lines)
        number = np.arange(len(stop)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
        self._lines, self._sums = (start, stop), {}
        full = stop > start
        self.start, self.stop, self.doc, self.number = start[full], stop[full], doc[full], number[full]

    def sums(self, kind: str) -> np.ndarray:
        """The sums of all prefixes of all lines together."""
        if kind not in self._sums:
            start, stop = self._lines
            from_end, at = kind == "tail", np.arange(len(self.points))
            line = np.repeat(stop if from_end else start + (kind == "moved"), stop - start + 1)
            code = np.subtract(line, at, out=at) if from_end else np.subtract(at, line, out=at)
            code = code.view(np.uint64)
            code *= _TAIL if from_end else _HEAD
            code += _codes()[self.points]
            sums = self._sums[kind] = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(mix64(code), out=sums[1:])
        return self._sums[kind]

    def hash(self, kind: str, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.sums(kind)[stop] - self.sums(kind)[start]

    def ids(self) -> np.ndarray:
        """A hash that tells lines apart."""
        n = (self.stop - self.start).astype(np.uint64)
        return mix64(self.hash("head", self.start, self.stop) + n * _SALT[0])

    def digests(self) -> np.ndarray:
        """BLAKE2b of each line in 128 bits, as two longs: equal digests, equal lines."""
        cuts = zip(self.start.tolist(), self.stop.tolist(), strict=True)
        own = b"".join(hashlib.blake2b(self.points[a:b].tobytes(), digest_size=16).digest() for a, b in cuts)
        return np.frombuffer(own, np.int64).reshape(-1, 2)

    def texts(self) -> pa.Array:
        body = self.points[self.points != 10]
        size = np.ones(len(body), np.int64)
        for more in (0x80, 0x800, 0x10000):
            size += body >= more
        at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(self.stop - self.start)))]
        data = body.tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(self.start), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


@cache
def _codes() -> np.ndarray:
    """All code points, mixed."""
    return mix64(np.arange(1, 0x110001, dtype=np.uint64))


def _log2(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


def _halves(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the first and last h characters, for the lengths m that a pair may have; h is 0 where m is 1."""
    n = lines.stop - lines.start
    rows, keys = [], []
    for m in (n, n - 1):
        own = np.flatnonzero((m > 0) & ((m == n) | (_log2(m) != _log2(n))))
        h = (np.int64(1) << _log2(m[own])) // 2
        first = lines.hash("head", lines.start[own], lines.start[own] + h)
        last = lines.hash("tail", lines.stop[own] - h, lines.stop[own])
        for salt, part in ((2, first), (3, last)):
            rows.append(own)
            keys.append(mix64(part + h.astype(np.uint64) * _SALT[salt]))
    return np.concatenate(rows), np.concatenate(keys)


def _steps(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash, from, to): for each length m that a pair may have and each step, the hash of all that lies before and after,
    and the characters in between."""
    n = lines.stop - lines.start
    parts = []
    for m in (n, n - 1):
        h_n, h = np.int64(1) << np.maximum(_log2(n) - 4, 0), np.int64(1) << np.maximum(_log2(m) - 4, 0)
        own = np.flatnonzero((m > 0) & ((m == n) | (h != h_n) | (m // h != n // h)))
        count = np.maximum(m[own] // h[own] - 1, 1)
        row = np.repeat(own, count)
        a = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        step = h[row]
        low, high = a * step, n[row] - (np.repeat(count, count) - 1 - a) * step
        head = lines.hash("head", lines.start[row], lines.start[row] + low)
        tail = lines.hash("tail", lines.start[row] + high, lines.stop[row])
        shape = (a + step * 64 + np.repeat(count, count) * (1 << 40)).astype(np.uint64)
        parts.append((row, mix64(mix64(head + shape * _SALT[4]) + tail), low, high))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _each(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for whole in batches:
        for batch in slices(whole, column, most):
            yield batch, Lines(batch.column(column).to_pylist())


def _emit_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, lines in _each(batches, "text", _SLICE):
        row, key = _halves(lines)
        yield _table({"half": pa.array(key.view(np.int64)), "id_lo": pa.array(lines.ids()[row].view(np.int64))})


def _emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lines in _each(batches, "text", _SLICE):
        digest = lines.digests()
        yield _table(
            {
                "id_lo": pa.array(digest[:, 0]), "id_hi": pa.array(digest[:, 1]),
                "doc_id": batch.column("doc_id").take(pa.array(lines.doc)), "line_no": pa.array(lines.number.astype(np.int32)),
            }
        )


def _emit_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lines in _each(batches, "text", _SLICE):
        row, key = _halves(lines)
        lo = lines.ids()
        own = pa.array(row)
        yield _table(
            {
                "half": pa.array(key.view(np.int64)), "id_lo": pa.array(lo[row].view(np.int64)), "line": lines.texts().take(own),
                "doc_id": batch.column("doc_id").take(pa.array(lines.doc[row])), "line_no": pa.array(lines.number[row].astype(np.int32)),
            }
        )


def _emit_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lines in _each(batches, "line", _SLICE):
        row, key, low, high = _steps(lines)
        own = pa.array(lines.doc[row])
        yield _table(
            {
                "step": pa.array(key.view(np.int64)), "doc_id": batch.column("doc_id").take(own), "line_no": batch.column("line_no").take(own),
                "id_lo": batch.column("id_lo").take(own), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32)),
            }
        )


def _emit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, ...): the line itself (at -1) and the line without each character of its ranges."""
    for batch, lines in _each(batches, "line", 1 << 17):
        rows, spots = [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            spot = np.unique(np.concatenate([np.arange(r["low"], r["high"]) for r in ranges]))
            spots += [np.array([-1]), spot]
            rows.append(np.full(len(spot) + 1, i))
        if not rows:
            continue
        row, spot = np.concatenate(rows), np.concatenate(spots)
        start, stop = lines.start[row], lines.stop[row]
        whole = spot < 0
        n = (stop - start - ~whole).astype(np.uint64)
        head = lines.hash("head", start, np.where(whole, stop, start + spot))
        tail = lines.hash("moved", np.where(whole, stop, start + spot + 1), stop)  # one place to the front
        key = mix64(head + tail + n * _SALT[5])
        own = pa.array(row)
        yield _table(
            {
                "key": pa.array(key.view(np.int64)), "spot": pa.array(spot.astype(np.int32)),
                "doc_id": batch.column("doc_id").take(own), "line_no": batch.column("line_no").take(own),
            }
        )


def _partners(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, to): each line's earliest line within one edit, if earlier than it; lines by their first places."""
    lo_hi = (F.min("id_lo").alias("lo"), F.max("id_lo").alias("hi"))
    halves = docs.select("text").mapInArrow(_emit_halves, "half long, id_lo long")
    shared = cut(halves.groupBy("half").agg(*lo_hi).where("lo <> hi").select("half"))
    lines = docs.mapInArrow(_emit_lines, "half long, id_lo long, line string, doc_id long, line_no int")
    lines = lines.join(broadcast_if_small(shared, _BROADCAST_ROWS), "half")
    lines = cut(lines.groupBy("id_lo", "line").agg(F.min(F.struct("doc_id", "line_no")).alias("at")).select("id_lo", "line", "at.doc_id", "at.line_no"))

    steps = lines.mapInArrow(_emit_steps, "step long, doc_id long, line_no int, id_lo long, low int, high int")
    both = cut(steps.groupBy("step").agg(*lo_hi).where("lo <> hi").select("step"))
    ranges = steps.join(broadcast_if_small(both, _BROADCAST_ROWS), "step").groupBy("doc_id", "line_no")
    ranges = ranges.agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    narrowed = lines.select("doc_id", "line_no", "line").join(ranges, ["doc_id", "line_no"])
    variants = narrowed.mapInArrow(_emit_variants, "key long, spot int, doc_id long, line_no int")

    # Distinct lines that share a variant differ in one character at most, so these groups are small.
    at, whole = F.struct("doc_id", "line_no"), F.col("spot") < 0
    same, same_spot = Window.partitionBy("key"), Window.partitionBy("key", "spot")
    met = variants.select(
        at.alias("at"),
        F.when(whole, F.min(F.when(~whole, at)).over(same)).otherwise(F.min(F.when(whole, at)).over(same)).alias("added"),
        F.when(~whole, F.min(at).over(same_spot)).alias("changed"),
    )
    pairs = met.select("at", F.explode(F.array("added", "changed")).alias("to")).where("to < at").distinct()
    pairs = pairs.select("at.doc_id", "at.line_no", F.col("to.doc_id").alias("to_doc"), F.col("to.line_no").alias("to_line"))
    other = lines.select(F.col("line").alias("to_text"), F.col("doc_id").alias("to_doc"), F.col("line_no").alias("to_line"))
    checked = pairs.join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"]).join(other, ["to_doc", "to_line"])
    checked = checked.where(F.levenshtein("line", "to_text", 1) == 1)
    return checked.groupBy("doc_id", "line_no").agg(F.min(F.struct("to_doc", "to_line")).alias("to"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """The lines of (doc_id, text, ...) that go, each with the earliest line within the edit bound.

    Rows: doc_id, line_no (from 0), keep_doc_id, keep_line_no, distance (0 or 1). A line goes if an earlier
    line (by doc_id, then line_no) is equal to it or within one edit, however short they are; keep_* is the earliest
    such line, whether or not that one goes itself. Blank lines never go. Lines are compared after white space is
    collapsed and A-Z lower-cased; equal means equal in the 128 bits of BLAKE2b. Null text has
    no lines; rows with a null doc_id are left alone. Rows that repeat a doc_id stay or go line by line with their like, and
    never on each other's account. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    partners = cut(_partners(docs))
    places = cut(docs.mapInArrow(_emit_places, "id_lo long, id_hi long, doc_id long, line_no int"))
    line_id = ["id_lo", "id_hi"]
    firsts = places.groupBy(*line_id).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.select(*line_id, "first.doc_id", "first.line_no", "n")
    keep = firsts.join(broadcast_if_small(partners, _BROADCAST_ROWS // 4), ["doc_id", "line_no"], "left").where("n > 1 or to is not null")
    keep = keep.select(
        *line_id,
        "n",
        F.coalesce("to.to_doc", "doc_id").alias("keep_doc_id"),
        F.coalesce("to.to_line", "line_no").alias("keep_line_no"),
        F.when(F.col("to").isNull(), 0).otherwise(1).alias("distance"),
    )
    met = join_groups(places, cut(keep), line_id, "n", F.xxhash64("doc_id", "line_no"))
    dropped = met.where("doc_id <> keep_doc_id or line_no <> keep_line_no")
    return dropped.select(
        "doc_id", F.col("line_no").cast("long"), "keep_doc_id", F.col("keep_line_no").cast("long").alias("keep_line_no"), "distance"
    )


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``duplicate_lines`` taken out of their texts; the other lines stay as they are."""
    gone = duplicate_lines(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("gone", i.cast("long")))
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    joined = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left")
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
