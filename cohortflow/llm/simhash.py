"""SimHash near-duplicates with bit-sliced distance comparison.

Equal fingerprints are one class. Classes are compared in candidate blocks:
two fingerprints within two bits agree on at least six of their eight bytes,
so each class goes to 28 blocks, one per pair of bytes left out. A block
holds classes that agree on the other 48 bits, hence at most 2^16 of them
however large the corpus is, and no cap is needed. Within a block the
fingerprints are stored as vertical bit planes; a carry-save counter updates
the distances of all members at once, 64 a word, and a query is abandoned as
soon as every member is beyond the radius.

Defined results: null and empty texts have fingerprint zero and are linked
like any other; a null id is never a component's name (a component of null
ids only has a null name); repeated ids give one row each; an empty table
gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, packed, settled, ship, space_words
from .components import connected_components

SHINGLE, RADIUS, BYTES = 3, 2, 8

_BATCH = 256  # queries compared with one block at a time


PART = 1 << 16


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is set if more than half of the hashes set it."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):  # 64 bytes a shingle once unpacked: a long text goes in parts
        part = hashes[at:at + PART].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint(batches):
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out = [fingerprint_of(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        kept = batch.select(range(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.array(out, "u8").view("i8"))],
                                         [*kept.schema.names, "fp"])


def fingerprints(rows: DataFrame, text: str = "_0", shingle: int = SHINGLE) -> DataFrame:
    """The other columns of ``rows`` with ``fp``, the SimHash of ``text`` as a signed long."""
    kept = [c for c in rows.columns if c != text]
    df = rows.select(*kept, space_words(ascii_lower(text)).alias("_words"))
    n = F.size("_words")
    hashed = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(
        F.concat_ws(" ", *[F.get("_words", i + k) for k in range(shingle)])))
    whole = F.when(n > 0, F.array(F.xxhash64(F.array_join("_words", " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*kept, F.when(n >= shingle, hashed).otherwise(whole).alias("_hashes"))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("fp", T.LongType())])
    return df.mapInArrow(_fingerprint, schema)


def planes(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """Vertical layout: row p holds bit ``bits[p]`` of every fingerprint, 64 to a word."""
    pad = -len(fps) % 64
    f = np.concatenate([fps, np.zeros(pad, np.uint64)])
    return np.stack([np.packbits(((f >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
                     for p in bits])


def within(fps: np.ndarray, queries: np.ndarray, radius: int, vertical: np.ndarray, bits: list[int]) -> np.ndarray:
    """Boolean [query, member]: distance at most ``radius``, by carry-save counting over the planes."""
    words = vertical.shape[1]
    valid = np.zeros(words * 64, np.uint8)
    valid[:len(fps)] = 1
    over = np.repeat(~np.packbits(valid, bitorder="little").view("<u8")[None, :], len(queries), axis=0)
    counters = [np.zeros_like(over) for _ in range(max(1, (radius + 1).bit_length()))]
    alive = np.arange(len(queries))
    full = ~np.uint64(0)
    for k, p in enumerate(bits):
        flip = np.where((queries[alive] >> np.uint64(p)) & np.uint64(1), full, np.uint64(0))[:, None]
        carry = vertical[k][None, :] ^ flip  # members that differ from the query in this bit
        for c in counters:
            old = c[alive]
            c[alive], carry = old ^ carry, old & carry
        over[alive] |= carry
        if k >= radius:
            above = over[alive]
            at = _above([c[alive] for c in counters], radius)
            above |= at
            over[alive] = above
            alive = alive[(above != full).any(axis=1)]  # give up queries whose members are all too far
            if not len(alive):
                break
    near = ~over
    return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :len(fps)].astype(bool)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Mask of the members whose counter exceeds ``radius``."""
    greater, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            greater |= equal & counters[k]
            equal &= ~counters[k]
    return greater


def linked(fps: np.ndarray, radius: int = RADIUS, bits: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links of the components of one block (by index)."""
    bits = list(range(64)) if bits is None else bits
    vertical, todo, out = planes(fps, bits), np.ones(len(fps), bool), []
    while todo.any():
        root = int(np.argmax(todo))
        todo[root] = False
        front = np.array([root])
        while len(front) and todo.any():
            part, front = front[:_BATCH], front[_BATCH:]
            near = within(fps, fps[part], radius, vertical, bits) & todo
            new = np.flatnonzero(near.any(axis=0))
            todo[new] = False
            out += [(root, int(j)) for j in new]
            front = np.concatenate([front, new])
    return out


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            u, v = [], []
            for t, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                fps = members.values.to_numpy(zero_copy_only=False).view("u8")
                out = _left_out(t)
                for a, b in linked(fps, radius, [8 * byte + k for byte in out for k in range(8)]):
                    u.append(fps[a])
                    v.append(fps[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, "u8").view("i8")) for x in (u, v)], ["u", "v"])
    return run


def _left_out(t: int) -> tuple[int, ...]:
    return list(combinations(range(BYTES), RADIUS))[t]


def _rest(left: tuple[int, ...]) -> int:
    """Signed mask of the bytes that are not left out."""
    return int(np.array([~sum(255 << 8 * b for b in left) & (2**64 - 1)], "u8").view("i8")[0])


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints ``fp`` at ``radius`` bits or fewer (at most 2)."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_rest(left))).alias("key"))
                     for t, left in enumerate(combinations(range(BYTES), RADIUS))])
    blocks = (classes.select("fp", F.explode(keys).alias("k")).groupBy("k.t", "k.key")
              .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("t", "fps"))
    return blocks.mapInArrow(_compare(radius), "u bigint, v bigint").distinct()


def _rooted(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Each class with the root of its component, itself if it has no link."""
    return classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            radius: int = RADIUS) -> DataFrame:
    """id, ``fp`` and ``component_id`` (the smallest id reachable over links) of each document."""
    rows = packed(docs.select(id_col, text_col), id_col, text_col).select("_0", "_1")
    prints = settled(fingerprints(rows, "_1", shingle))
    classes = settled(prints.groupBy("fp").agg(F.min("_0").alias("low")))
    parts = connected_components(links(classes, radius))
    named = _rooted(classes, parts)
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = named.join(low, "root").select("fp", "component_id")
    return prints.join(label, "fp").select(F.col("_0").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest id (a null id last); columns unchanged.

    Ties between repeated ids are settled by a hash of the row, and of rows
    that are equal in every column one stays.
    """
    rows = packed(docs, id_col, text_col).withColumn("_h", F.xxhash64(*[F.col(f"_row.`{c}`") for c in docs.columns]))
    prints = settled(fingerprints(rows.select("_0", "_h", "_1"), "_1", shingle))
    order = F.struct(F.isnull("_0").alias("z"), F.col("_0").alias("id"), F.col("_h").alias("h"))
    classes = settled(prints.groupBy("fp").agg(F.min(order).alias("low")))
    parts = connected_components(links(classes, radius))
    keepers = (_rooted(classes, parts).groupBy("root").agg(F.min("low").alias("low"))
               .select(F.col("low.id").alias("_id"), F.col("low.h").alias("_k")))
    equal = prints.groupBy("_0", "_h").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_0").alias("_id0"), F.col("_h").alias("_h0"), "_n")
    keepers = keepers.join(equal, keepers["_id"].eqNullSafe(equal["_id0"]) & (keepers["_k"] == equal["_h0"])).select(
        "_id", "_k", "_n")
    kept = rows.select("_0", "_h", "_row").join(
        keepers, F.col("_0").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")))
    one, more = kept.filter("_n = 1").select("_row.*"), kept.filter("_n > 1").select("_row.*")
    return one.union(more.dropDuplicates())


ship(__name__)
