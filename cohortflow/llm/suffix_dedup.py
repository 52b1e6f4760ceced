"""Removal of repeated 200-byte strings by deep-shallow suffix sorting.

Distribution. A 200-byte window always holds at least one *anchor*: the
40-byte string of least hash among those inside it (a minimizer), chosen by
content, so two equal windows have equal anchors at equal places. All windows
that share an anchor form a span of text of at most 360 bytes. Windows can
only be equal if their anchors are, so suffixes are compared per anchor:

1. anchors that occur once anywhere are done: nothing in them repeats;
2. spans that occur twice or more as a whole repeat as a whole;
3. the remaining spans, and one of each kind of repeated span, are fetched
   from the texts, and the suffixes at their window starts are sorted:
   multikey quicksort on 8-byte characters to a depth of ``SHALLOW`` bytes,
   then a blind trie for each group that still has a long common prefix.
   Suffixes that agree on 200 bytes are repeats.

Steps 1 and 2 are counts and joins whose hot keys are partially aggregated
or can be split. An anchor with more than ``MAX_SPANS`` different spans (a
passage inside very many documents) is not gathered in one task: its windows
are counted by two 64-bit hashes instead, which gives the same result.

Documents are named by two 64-bit hashes of their text, since equal texts
have equal results.

Defined results: null and empty texts have no bytes; texts shorter than the
window lose nothing; equal rows repeat each other; ids may be null or
repeated; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, settled, ship

WINDOW, GRAM = 200, 40
SHALLOW, CHAR = 32, 8
MAX_SPANS = 4096
_PART = 1 << 22  # bytes of a text that are hashed at a time

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        ones = np.full(max(n, 4096), 1, np.uint64)
        for name, base in (("up", _ODD), ("down", _INV)):
            p = ones.copy()
            p[1:] = base
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Rolling:
    """Hashes of any substring of a part of text, by prefix sums modulo 2^64."""

    def __init__(self, a: np.ndarray, salt: int = 0):
        up, self.down = _powers(len(a) + 1)
        # bytes become scattered 64-bit values first: plain polynomial hashes modulo 2^64 are weak
        values = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * salt)) * _ODD)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(values[a] * up[:len(a)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (the leftmost of equal ones) in every window of ``width`` values."""
    least, off, reach = h, np.zeros(len(h), np.int16), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = least[:len(least) - step], least[step:]
        off = np.where(b < a, off[step:] + np.int16(step), off[:len(off) - step])
        least = np.minimum(a, b)
        reach += step
    return np.arange(len(off)) + off


def anchors(raw: bytes):
    """Arrays (anchor hash, span hash, first and last window start, anchor place) of a text's anchors."""
    out = []
    for at in range(0, max(1, len(raw) - WINDOW + 1), _PART):
        part = np.frombuffer(raw, np.uint8)[at:at + _PART + WINDOW - 1]
        if len(part) < WINDOW:
            break
        roll = Rolling(part)
        grams = roll.of(np.arange(len(part) - GRAM + 1), GRAM)
        low = _sliding_argmin(grams, WINDOW - GRAM + 1)  # one per window start
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        last = np.concatenate((first[1:], [len(low)])) - 1
        spans = roll.of(first, last - first + WINDOW) ^ _mix((last - first).astype(np.uint64))
        out.append((grams[low[first]], spans, at + first, at + last, at + low[first]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


_SHAPE = 1024  # a span's shape: its anchor's place in it, and its number of further window starts


def _emit_anchors(batches):
    for batch in batches:
        names, cols = ["a", "b", "anchor", "span", "at", "shape"], [[] for _ in range(6)]
        for a, b, text in zip(*(batch.column(k) for k in range(3))):
            h, s, first, last, place = anchors((text.as_py() or "").encode())
            for c, v in zip(cols, (np.full(len(h), a.as_py()), np.full(len(h), b.as_py()), h.view("i8"), s.view("i8"),
                                   first, _SHAPE * (place - first) + last - first)):
                c.append(v.astype(np.int64))
        for at in range(0, max(1, len(cols[0])), 1000):
            parts = [np.concatenate(c[at:at + 1000] or [np.zeros(0, np.int64)]) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit("suffix"), text).alias("b")]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = packed(docs.select(text_col), text_col).select(F.coalesce("_0", F.lit("")).alias("t"))
    return text.select(*_keys(F.col("t")), "t")


def _anchor_rows(texts: DataFrame) -> DataFrame:
    return texts.filter(F.octet_length("t") >= WINDOW).select("a", "b", "t").mapInArrow(
        _emit_anchors, "a long, b long, anchor long, span long, at long, shape long")


# -- deep-shallow sorting ------------------------------------------------------------------------------------------

def shallow_groups(text: np.ndarray, start: np.ndarray, label: np.ndarray, depth: int = SHALLOW) -> list[np.ndarray]:
    """Groups of suffixes with equal labels and equal first ``depth`` bytes, by multikey quicksort.

    Ternary partitioning about a pivot character (8 bytes) of each group, all
    groups at once; a group moves on to its next character when its members
    equal the pivot. Groups of one are unique and dropped.
    """
    pad = np.concatenate([text, np.zeros(CHAR, np.uint8)])
    word = sum(pad[k:k + len(text)].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(CHAR))
    order = np.argsort(label, kind="stable")
    members = order
    bounds = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1]))) if len(order) else order
    depths, done = np.zeros(len(bounds), np.int64), []
    while len(members):
        sizes = np.diff(np.concatenate((bounds, [len(members)])))
        deep = (sizes > 1) & (depths >= depth)
        done += [members[b:b + n] for b, n in zip(bounds[deep], sizes[deep])]
        live = (sizes > 1) & ~deep
        keep = np.repeat(live, sizes)
        members, sizes, depths = members[keep], sizes[live], depths[live]
        if not len(members):
            break
        group = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        key = word[start[members] + depths[group]]
        pivot = key[begin + sizes // 2][group]
        side = (key > pivot).astype(np.int64) + (key >= pivot)  # 0 below, 1 equal, 2 above
        part = 3 * group + side
        order = np.argsort(part, kind="stable")
        members, part = members[order], part[order]
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        depths = depths[part[bounds] // 3] + CHAR * (part[bounds] % 3 == 1)
    return done


class BlindTrie:
    """Orders suffixes with a long common prefix; inner nodes keep only a depth and branching bytes.

    An insertion first descends blindly to a leaf, compares with that one
    suffix, and branches at the depth of the first difference.
    """

    def __init__(self, text: bytes, known: int, limit: int = WINDOW):
        self.text, self.known, self.limit, self.root = text, known, limit, None

    def _common(self, i: int, j: int) -> int:
        text, lo, hi = self.text, self.known, self.limit
        if text[i + lo:i + hi] == text[j + lo:j + hi]:
            return hi
        while lo < hi:  # first difference by halving
            mid = (lo + hi + 1) // 2
            if text[i + lo:i + mid] == text[j + lo:j + mid]:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def insert(self, at: int) -> None:
        """A leaf is a list of starts that agree on ``limit`` bytes; a node is (depth, {byte: child})."""
        if self.root is None:
            self.root = [at]
            return
        node = self.root
        while isinstance(node, tuple):
            child = node[1].get(self.text[at + node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        common = self._common(at, node[0])
        if common >= self.limit:
            node.append(at)
            return
        byte, other = self.text[at + common], self.text[node[0] + common]
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            above, node = (node, self.text[at + node[0]]), node[1][self.text[at + node[0]]]
        if isinstance(node, tuple) and node[0] == common:
            node[1][byte] = [at]
            return
        new = (common, {other: node, byte: [at]})
        if above is None:
            self.root = new
        else:
            above[0][1][above[1]] = new

    def leaves(self):
        """Leaves in suffix order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


def repeated(text: bytes, start: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Boolean per suffix: whether another one of the same label agrees on the whole window."""
    out = np.zeros(len(start), bool)
    if not len(start):
        return out
    where = np.full(len(text) + 1, -1, np.int64)
    for group in shallow_groups(np.frombuffer(text, np.uint8), start, label):
        trie = BlindTrie(text, SHALLOW)
        where[start[group]] = group
        for at in start[group].tolist():
            trie.insert(at)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                out[where[leaf]] = True
    return out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sort_spans(frames):
    """Rows (anchor, (a, b), at, place, s) come sorted by anchor; a part of the stream ends between anchors.

    Equal windows have their anchor at the same distance, so a suffix is
    labelled by its anchor and that distance.
    """
    for rows in frames:
        hits = {k: [] for k in ("a", "b", "first", "last")}
        text = b"".join(r[4] for r in rows)
        start, label, owner, base = [], [], [], 0
        keys: dict = {}
        for anchor, _, _, place, s in rows:
            n = len(s) - WINDOW + 1
            start.append(base + np.arange(n))
            label.append(keys.setdefault(anchor, len(keys)) * _SHAPE + place - np.arange(n) + WINDOW)
            owner.append(n)
            base += len(s)
        hit = repeated(text, np.concatenate(start), np.concatenate(label))
        done = 0
        for (_, key, at, _, _), n in zip(rows, owner):
            for lo, hi in _runs(hit[done:done + n]):
                for name, v in zip(hits, (*key, at + lo, at + hi - 1)):
                    hits[name].append(v)
            done += n
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in hits.values()], list(hits))


def _grouped(batches, most: int = 1 << 20):
    """Cuts the sorted stream into lists of whole anchor groups of about ``most`` bytes."""
    rows, size = [], 0
    for batch in batches:
        for anchor, a, b, at, place, s in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= most and rows[-1][0] != anchor:
                yield rows
                rows, size = [], 0
            rows.append((anchor, (a, b), at, place, s))
            size += len(s)
    if rows:
        yield rows


def _sorted_spans(batches):
    yield from _sort_spans(_grouped(batches))


def _emit_windows(batches):
    """Two hashes of every window of the spans of a hot anchor."""
    for batch in batches:
        for _, a, b, at, _, s in zip(*(c.to_pylist() for c in batch.columns)):
            arr = np.frombuffer(s, np.uint8)
            n = len(arr) - WINDOW + 1
            w = [Rolling(arr, salt).of(np.arange(n), WINDOW).view("i8") for salt in (1, 2)]
            full = [np.full(n, v, np.int64) for v in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*w, *full, at + np.arange(n, dtype=np.int64))],
                                             ["w1", "w2", "a", "b", "first"])


# -- the operator --------------------------------------------------------------------------------------------------

def repeated_windows(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts that may repeat, stored as (a, b, t), and (a, b, first, last) ranges of repeated window starts."""
    texts = _texts(docs, text_col)
    # settled first, so that the join has plain exchanges on both sides and a hot anchor can be split
    counts = settled(_anchor_rows(texts).select("anchor").groupBy("anchor").count().filter("count > 1").select("anchor"))
    found = settled(_anchor_rows(texts).join(counts, "anchor"))
    spans = settled(found.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "at", "shape")).alias("one")))
    kinds = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    whole = found.join(spans.filter("n > 1").select("anchor", "span"), ["anchor", "span"]).select(
        "a", "b", F.col("at").alias("first"), (F.col("at") + F.col("shape") % _SHAPE).alias("last"))
    # one of each kind of span, where there are several kinds
    fetch = spans.join(kinds.filter("kinds > 1"), "anchor").select("anchor", "kinds", "one.*").groupBy("a", "b").agg(
        F.collect_list(F.struct("anchor", "kinds", "at", "shape")).alias("need"))
    wanted = found.select("a", "b").distinct().join(fetch, ["a", "b"], "left")
    # equal texts meet once, before the join: copies are merged by each task already
    texts = settled(texts.dropDuplicates(["a", "b"]).join(wanted, ["a", "b"]))
    pieces = texts.select("a", "b", F.col("t").cast("binary").alias("t"), F.explode("need").alias("x"))
    pieces = settled(pieces.select("x.anchor", "a", "b", "x.at", F.floor(F.col("x.shape") / _SHAPE).alias("place"), F.expr(
        f"substring(t, cast(x.at + 1 as int), cast(x.shape % {_SHAPE} + {WINDOW} as int))").alias("s"), "x.kinds"))
    cool = pieces.filter(F.col("kinds") <= MAX_SPANS).select("anchor", "a", "b", "at", "place", "s")
    cool = cool.repartition("anchor").sortWithinPartitions("anchor", "a", "b", "at")
    sorted_ = cool.mapInArrow(_sorted_spans, "a long, b long, first long, last long")
    hot = pieces.filter(F.col("kinds") > MAX_SPANS).select("anchor", "a", "b", "at", "place", "s").mapInArrow(
        _emit_windows, "w1 long, w2 long, a long, b long, first long")
    twice = hot.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
    hot = hot.join(twice, ["w1", "w2"]).select("a", "b", "first", F.col("first").alias("last"))
    return texts.drop("need"), whole.union(sorted_).union(hot).distinct()


def removed_bytes(ranges: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of bytes covered by windows that start in ``ranges`` (rows first, last)."""
    out: list = []
    for first, last in ranges[np.argsort(ranges[:, 0], kind="stable")].tolist():
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + WINDOW)
        else:
            out.append([first, last + WINDOW])
    return [(a, min(b, size)) for a, b in out]


def _cut(batches):
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column(2), batch.column(3)):
            raw, r = text.as_py().encode(), ranges.as_py() or []
            runs = removed_bytes(np.array([(x["first"], x["last"]) for x in r], np.int64).reshape(-1, 2), len(raw))
            at, kept = 0, []
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            left = b"".join([*kept, raw[at:]])
            out.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), left,
                        [{"start": a, "end": b} for a, b in runs]))
        cols = list(zip(*out)) or [()] * 5
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pairs)],
            ["a", "b", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])


_CUT = ("a long, b long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
        "removed array<struct<start:long,end:long>>")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and removed byte runs of each document.

    keep_bytes: also ``kept``, the bytes that stay (they need not be valid UTF-8).
    """
    texts, ranges = repeated_windows(docs, text_col)
    each = ranges.groupBy("a", "b").agg(F.collect_list(F.struct("first", "last")).alias("r"))
    cut = texts.join(each, ["a", "b"]).mapInArrow(_cut, _CUT)
    cut = settled(cut if keep_bytes else cut.drop("kept"))
    df = packed(docs.select(id_col, text_col), id_col, text_col)
    text = F.coalesce("_1", F.lit(""))
    df = df.select("_0", *_keys(text), F.octet_length(text).cast("long").alias("n_bytes"),
                   F.sha2(text, 256).alias("_sha"), *([text.cast("binary").alias("_text")] if keep_bytes else []))
    df = df.join(cut, ["a", "b"], "left")
    none = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    return df.select(
        F.col("_0").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        F.coalesce("removed", F.array().cast(none)).alias("removed"),
        *([F.coalesce("kept", "_text").alias("kept")] if keep_bytes else []))


ship(__name__)
