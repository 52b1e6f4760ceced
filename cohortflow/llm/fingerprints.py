"""Document fingerprints from prefix polynomial hashes, and the likeness of fingerprints.

The texts of a batch are laid end to end, and two modular arrays hold the
polynomial hash of every prefix. The hash of any span is the difference of
two prefixes, brought to a common power; so two spans anywhere in the batch
are compared in constant time, and a longest common extension is found by
binary search over its length.

A fingerprint holds the length, the hash of the whole text, the hashes of
its prefixes and of its suffixes at up to 16 lengths (multiples of the
least power of two that does not give more), and 64 minima over the hashes of
all its spans of 24 code points. Likeness is the greater of two readings: the part of
the longer text that the longest common extensions from both ends cover,
found by binary search over the prefix and suffix hashes, and the share of
equal minima, which estimates the Jaccard index of the spans and finds texts
that differ in many places. Both are 0 for texts with nothing in common.

Neighbours by key are found without gathering: the keys alone are numbered
globally, every bucket of consecutive rows is told the first row of the next
bucket, and one shuffle of the texts brings each row and its successor
together. Tasks read their rows as a stream.

Defined results: a null text is empty; an empty text has likeness 1 to an
empty one, else 0. Equal texts have equal fingerprints and likeness 1.
Descending keys, null keys last, rows of one key by their text's digest;
equal rows are each other's neighbours, the last of them has the next key's
row. The row after the last is the first; a single row is its own next. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import few, settled, ship

P = np.uint64((1 << 31) - 1)
BITS = np.uint64(31)
# two bases of the one Mersenne prime: together 62 bits
BASES = (1_103_515_245, 1_540_483_477)
SPAN, MINIMA, LANDMARKS = 24, 64, 16
# code points in a batch (a longer text is one of its own), and those computed on at once
BATCH_POINTS, PART = 1 << 20, 1 << 18


def _reduce(x: np.ndarray) -> np.ndarray:
    """``x mod P`` for x below 2^62."""
    x = (x & P) + (x >> BITS)
    return np.minimum(x, x - P)  # below P the difference wraps around to a large number


def _mul(a, b) -> np.ndarray:
    return _reduce(a * b)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), by doubling; they fit in 32 bits."""
    out = np.ones(max(n, 1), np.uint32)
    done = 1
    while done < n:
        more = min(done, n - done)
        for at in range(0, more, PART):
            part = out[at:min(at + PART, more)].astype(np.uint64)
            out[done + at:done + at + len(part)] = _mul(part, np.uint64(pow(base, done, int(P))))
        done += more
    return out


class Powers:
    """Powers of the bases and of their inverses; those for usual batches are kept by the worker."""

    held: list = []

    @classmethod
    def up_to(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not cls.held or len(cls.held[0][0]) < n:
            size = max(n, 2 * BATCH_POINTS)
            made = [(_powers(b, size), _powers(pow(b, -1, int(P)), size)) for b in BASES]
            if n > 4 * BATCH_POINTS:
                return made  # for one very long text
            cls.held = made
        return cls.held


class Prefixes:
    """Prefix hashes of an array of code points under both bases: 8 bytes a point, beside 16 for the powers."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.powers = Powers.up_to(n + 1)
        self.sums = []
        for up, _ in self.powers:
            s, carry = np.zeros(n + 1, np.uint32), np.uint64(0)
            for at in range(0, n, PART):
                # every point counts as one more than its code, so that runs of zeros differ in length
                part = _mul(points[at:at + PART].astype(np.uint64) + np.uint64(1), up[at:min(at + PART, n)])
                part = _reduce(np.cumsum(part, dtype=np.uint64) + carry)
                s[at + 1:at + 1 + len(part)] = part
                carry = part[-1]
            self.sums.append(s)

    def spans(self, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
        """Hashes of the spans [start, end), independent of where they stand."""
        s, (_, down) = self.sums[base], self.powers[base]
        return _mul(_reduce(s[end] + (P - s[start])), down[start])

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are the spans of ``length`` at i and j equal (up to hash collisions)?"""
        same = np.ones(len(i), bool)
        for b in range(len(BASES)):
            same &= self.spans(i, i + length, b) == self.spans(j, j + length, b)
        return same

    def common_extension(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Greatest length, at most ``limit``, with equal spans at i and j; all pairs in one binary search."""
        low, high = np.zeros(len(i), np.int64), limit.astype(np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over 64 bits (the finaliser of splitmix)."""
    x = h + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points end to end, and the texts' borders."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def step_of(n: int) -> int:
    """Distance of the landmarks: the least power of two that gives at most ``LANDMARKS``."""
    step = 1
    while n > step * LANDMARKS:
        step *= 2
    return step


class Fingerprints:
    """Fingerprints of a batch of texts as rows of arrays."""

    def __init__(self, points: np.ndarray, borders: np.ndarray, prefixes: Prefixes | None = None):
        self.prefixes = prefixes or Prefixes(points)
        start, end = borders[:-1], borders[1:]
        n = self.n = end - start
        whole = [self.prefixes.spans(start, end, b) for b in range(len(BASES))]
        self.whole = (whole[0] << BITS) | whole[1]
        step = np.ones(len(n), np.int64)
        while (n > step * LANDMARKS).any():
            step = np.where(n > step * LANDMARKS, step * 2, step)
        self.step = step
        marks = np.minimum(np.arange(1, LANDMARKS + 1) * step[:, None], n[:, None])
        self.head = self._both(np.repeat(start, LANDMARKS), (start[:, None] + marks).ravel()).reshape(marks.shape)
        self.tail = self._both((end[:, None] - marks).ravel(), np.repeat(end, LANDMARKS)).reshape(marks.shape)
        self.minima = self._minima(start, n)

    def _both(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = self.prefixes.spans(start, end, 0), self.prefixes.spans(start, end, 1)
        return ((a * np.uint64(0x9E3779B1)) ^ b) & np.uint64(0xFFFFFFFF)

    def _minima(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per text the least of 16 bits in each of 64 bins over its spans; a text shorter than a span is one span."""
        count = np.where(n > 0, np.maximum(n - SPAN + 1, 1), 0)
        before = np.cumsum(count) - count
        # the upper value of the 16 bits stays free for an empty bin
        least = np.full(len(n) * MINIMA, 0xFFFF, np.uint16)
        for at in range(0, int(count.sum()), PART):
            i = np.arange(at, min(at + PART, int(count.sum())))
            owner = np.searchsorted(before + count, i, side="right")
            first = i - before[owner] + start[owner]
            h = _mixed(self.prefixes.spans(first, first + np.minimum(n, SPAN)[owner]))
            value = np.minimum((h >> np.uint64(20)) & np.uint64(0xFFFF), np.uint64(0xFFFE)).astype(np.uint16)
            np.minimum.at(least, owner * MINIMA + (h >> np.uint64(58)).astype(np.int64), value)
        return least.reshape(len(n), MINIMA)

    def text(self) -> list[str]:
        """Length, whole hash, landmarks and minima in fixed-width hexadecimal."""
        cols = [self.n.astype(">u8")[:, None].view(np.uint8), self.whole.astype(">u8")[:, None].view(np.uint8)]
        cols += [m.astype(">u4").view(np.uint8).reshape(len(self.n), -1) for m in (self.head, self.tail)]
        cols.append(self.minima.astype(">u2").view(np.uint8).reshape(len(self.n), -1))
        rows = np.ascontiguousarray(np.hstack(cols))
        return [r.tobytes().hex() for r in rows]

    def take(self, i: np.ndarray) -> "Fingerprints":
        out = object.__new__(Fingerprints)
        for name in ("n", "whole", "step", "head", "tail", "minima"):
            setattr(out, name, getattr(self, name)[i])
        return out


def parsed(texts: list[str]) -> Fingerprints:
    """Fingerprints read back from their strings."""
    out = object.__new__(Fingerprints)
    raw = np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), -1).copy()
    cut = [8, 16, 16 + 4 * LANDMARKS, 16 + 8 * LANDMARKS]
    n, whole, head, tail, minima = np.split(raw, cut, axis=1)
    as_type = lambda a, kind: np.ascontiguousarray(a).view(kind)
    out.n = as_type(n, ">u8").ravel().astype(np.int64)
    out.whole = as_type(whole, ">u8").ravel().astype(np.uint64)
    out.head, out.tail = as_type(head, ">u4").astype(np.uint64), as_type(tail, ">u4").astype(np.uint64)
    out.minima = as_type(minima, ">u2").astype(np.uint16)
    out.step = np.array([step_of(k) for k in out.n], np.int64)
    return out


def _covered(a: Fingerprints, b: Fingerprints, side: str) -> np.ndarray:
    """Longest common extension from one end, as far as the landmarks tell, by binary search over them."""
    step, shorter = np.maximum(a.step, b.step), np.minimum(a.n, b.n)
    rows = np.arange(len(step))
    low, high = np.zeros(len(step), np.int64), shorter // step

    def mark(f: Fingerprints, k: np.ndarray) -> np.ndarray:
        return getattr(f, side)[rows, np.clip(k * (step // f.step) - 1, 0, LANDMARKS - 1)]

    while (low < high).any():
        mid = (low + high + 1) // 2
        same = mark(a, mid) == mark(b, mid)
        open_ = low < high
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low * step


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """0 to 1 per pair of rows; 1 for equal whole hashes and lengths."""
    longer, shorter = np.maximum(a.n, b.n), np.minimum(a.n, b.n)
    ends = np.minimum(_covered(a, b, "head") + _covered(a, b, "tail"), shorter) / np.maximum(longer, 1)
    empty = 0xFFFF
    used = ((a.minima != empty) | (b.minima != empty)).sum(axis=1)
    same = ((a.minima == b.minima) & (a.minima != empty)).sum(axis=1)
    near = np.maximum(ends, same / np.maximum(used, 1))
    # differing texts are never quite alike
    near = np.minimum(near, 1 - 1 / np.maximum(longer + 1.0, 2.0))
    return np.where((a.n == b.n) & (a.whole == b.whole), 1.0, near)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


# ------------------------------------------------------------------ on Spark

OUT = ("key {key}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, next_prefix bigint")


def _batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """(key, text, copies, ahead) in order -> runs of rows of bounded size; a run's last row is the next one's first."""
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += len(row[1])
        if len(run) > 1 and size >= BATCH_POINTS:
            yield run
            run, size = [row], len(row[1])
    if len(run) > 1:
        yield run


def _compare(run: list[tuple]) -> list[tuple]:
    """All rows of a run but the last, each against its edited text and the next row."""
    texts = [r[1] for r in run]
    points, borders = code_points(texts)
    own = Fingerprints(points, borders)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    new = Fingerprints(*code_points(changed))
    here = np.arange(len(changed))
    left, right = own.take(here), own.take(here + 1)
    near_edited, near_next = likeness(left, new), likeness(left, right)
    common = own.prefixes.common_extension(borders[:-2], borders[1:-1], np.minimum(left.n, right.n))
    marks, new_marks, out = left.text(), new.text(), []
    for i, (key, text, copies, bucket, ahead) in enumerate(run[:-1]):
        if run[i + 1][3] != bucket or ahead:
            continue  # the next bucket begins: this row was only here to be looked at
        sha = hashlib.sha256(changed[i].encode()).hexdigest()
        out.append((key, len(text), sha, marks[i], new_marks[i], near_edited[i], near_next[i], int(common[i]), 1))
        if copies > 1:  # all copies but one are followed by their like
            twin = edited(text, text)
            mark = Fingerprints(*code_points([twin]))
            out.append((key, len(text), hashlib.sha256(twin.encode()).hexdigest(), marks[i], mark.text()[0],
                        likeness(left.take(np.array([i])), mark)[0], 1.0, len(text), copies - 1))
    return out


def _follow(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    yield from zip(*[part.column(c).to_pylist() for c in ("key", "text", "copies", "bucket", "ahead")])
        for part in _batches(rows()):
            out = _compare(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _bucket_of(bounds: list[tuple]):
    """(key, digest) -> its bucket: the last one whose first row is not after it."""
    order = [(k is None, -k if k is not None else 0, d) for k, d in bounds]

    @F.pandas_udf("struct<bucket:int,first:boolean>")
    def place(key, digest):
        import pandas as pd
        at, first = [], []
        for k, d in zip(key, digest):
            item = (k is None, 0 if k is None else -int(k), d)
            b = bisect.bisect_right(order, item) - 1
            at.append(b)
            first.append(order[b] == item)
        return pd.DataFrame({"bucket": at, "first": first})

    return place


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, fingerprint, and what the row's edited text and the next row by descending key give.

    next_prefix is the exact length of the prefix shared with the next text.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), body.alias("text"), F.sha2(body, 256).alias("digest"))
    kind = docs.schema[key].dataType.simpleString()
    groups = settled(rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies")))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n = groups.count()
    placed = numbered(groups.withColumn("all", F.lit(0)), ["all"], [F.desc_nulls_last("key"), F.col("digest")],
                      before="pos")
    size = max(1, -(-n // buckets))
    # the first row of every bucket of equally many rows: as many as there are shuffle partitions
    bounds = [(r.key, r.digest) for r in placed.where(F.col("pos") % size == 0).orderBy("pos").select("key", "digest").collect()]
    out = OUT.format(key="bigint")
    if not bounds:
        return spark.createDataFrame([], out).withColumnRenamed("key", key)
    again = settled(groups.where("copies > 1").select(F.col("key").alias("k2"), F.col("digest").alias("d2"), "copies"))
    if again.isEmpty():
        each = rows.withColumn("copies", F.lit(1).cast("long"))
    else:  # rows that occur once go as they are; of equal rows one goes, with their number
        twins, match = few(again), [F.col("key").eqNullSafe(F.col("k2")), F.col("digest") == F.col("d2")]
        each = rows.join(twins, match, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(
            rows.join(twins, match).groupBy("key", "digest").agg(F.first("text").alias("text"),
                                                                 F.first("copies").alias("copies")))
    each = each.withColumn("at", _bucket_of(bounds)(F.col("key").cast("string"), "digest"))
    previous = F.pmod(F.col("at.bucket") - 1, F.lit(len(bounds)))
    seat = lambda b, ahead: F.struct(b.alias("bucket"), F.lit(ahead).alias("ahead"))
    seats = F.when(F.col("at.first"), F.array(seat(F.col("at.bucket"), False), seat(previous, True))).otherwise(
        F.array(seat(F.col("at.bucket"), False)))
    sent = each.select("key", "digest", "text", "copies", F.explode_outer(seats).alias("seat")).select(
        "key", "digest", "text", "copies", "seat.bucket", "seat.ahead")
    sent = sent.repartitionById(len(bounds), "bucket").sortWithinPartitions(
        "bucket", "ahead", F.desc_nulls_last("key"), "digest")
    schema = pa.schema([("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64()), ("next_prefix", pa.int64()), ("copies", pa.int64())])
    done = sent.select("key", "text", "copies", "bucket", "ahead").mapInArrow(_follow(schema), out + ", copies bigint")
    return done.select(F.col("key").cast(kind).alias(key), "n_chars", "edited_sha256", "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next", "next_prefix",
                       F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


ship(__name__)
