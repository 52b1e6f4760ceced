"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (13 consecutive words; a shorter item is
one window) form one automaton over normalised text. Each document is
normalised and scanned once; matches are mapped back to word numbers and to
character offsets of the original text.

The window table is collected to the driver in blocks whose size is checked:
``max_block_bytes`` of window text per block, with as many blocks as the
measured size asks for. Every block is scanned over all documents and the
hits are united, so a benchmark of any size gives the same result.

Defined results: null and empty texts have no words and no hits; an item
without words has no window; an item with a null id still marks words but is
not named; repeated item ids count once; document ids may be null or
repeated (one result row per input row); empty tables give no hits or rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLAIN_WORD, ascii_lower, opened, packed, settled, share, ship

WINDOW = 13
# the automaton takes some 27 bytes of a worker's memory for each byte of its windows: 216 MB a block
MAX_BLOCK_BYTES = 8 << 20

def _pairs(a: str, b: str) -> T.ArrayType:
    return T.ArrayType(T.StructType().add(a, "integer").add(b, "integer"))


_HITS = (T.StructType().add("n_words", "long").add("words", _pairs("first", "last"))
         .add("spans", _pairs("start", "end")).add("items", T.ArrayType(T.StringType())))
_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

# byte -> itself in lower case if it belongs to a word, else 0; every byte of
# a multi-byte character is 128 or more and belongs to a word
_FOLD = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32


class Windows:
    """Window texts with their item ids; the automaton is built once per worker."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.rows, self._found = rows, None

    def __getstate__(self):
        return {"rows": self.rows, "_found": None}

    def automaton(self):
        if self._found is None:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for k, (text, _) in enumerate(self.rows):
                # one character per UTF-8 byte, so match ends are byte offsets
                self._found.add_word(f" {text} ".encode().decode("latin-1"), (k, text.count(" ") + 1))
            if self.rows:
                self._found.make_automaton()
        return self._found

    def scan(self, raw: bytes):
        """Number of words, merged hit word ranges, their spans in characters, item ids."""
        a = np.frombuffer(raw, np.uint8)
        folded = _FOLD[a]
        word = folded != 0
        before = np.concatenate(([False], word[:-1]))
        starts = np.flatnonzero(word & ~before)
        if not len(starts) or not self.rows:
            return len(starts), [], [], []
        folded[~word] = 32
        text = folded[word | before].tobytes()  # a word's bytes and the separator after it
        text = b" " + (text if text.endswith(b" ") else text + b" ")
        found = list(self.automaton().iter(text.decode("latin-1")))
        if not found:
            return len(starts), [], [], []
        spaces = np.cumsum(np.frombuffer(text, np.uint8) == 32)
        items, ranges = set(), {}
        for end, (k, n) in found:
            last = int(spaces[end]) - 2
            ranges[last] = max(n, ranges.get(last, 0))
            items.add(k)
        merged = []
        for last, n in sorted((r, n) for r, n in ranges.items()):
            first = last - n + 1
            while merged and merged[-1][1] >= first:
                first = min(first, merged.pop()[0])
            merged.append((first, last))
        ends = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1
        chars = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
        spans = [(int(chars[starts[f]]), int(chars[ends[t]])) for f, t in merged]
        return len(starts), merged, spans, sorted({i for k in items for i in self.rows[k][1]})


def _scanner(shared, text_col: str, only_hits: bool = False):
    def scan(batches):
        windows = opened(shared)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)  # the text, or the row that holds it
            if pa.types.is_struct(texts.type):
                texts = texts.field(text_col)
            out = [windows.scan((t.as_py() or "").encode()) for t in texts]
            if only_hits:
                take = [k for k, r in enumerate(out) if r[1]]
                batch, out = batch.take(pa.array(take, pa.int64())), [out[k] for k in take]
            kept = batch.select([c for c in batch.schema.names if c != "_0"])
            cols = [pa.array([r[0] for r in out], pa.int64()),
                    pa.array([[{"first": f, "last": t} for f, t in r[1]] for r in out], _TYPE),
                    pa.array([[{"start": f, "end": t} for f, t in r[2]] for r in out], _SPAN),
                    pa.array([r[3] for r in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols],
                                             [*kept.schema.names, "n_words", "words", "spans", "items"])
    return scan


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """Distinct windows (words joined by a space) with the ids of their items."""
    df = packed(benchmark.select(id_col, text_col), id_col, text_col)
    words = F.regexp_extract_all(ascii_lower(F.coalesce("_1", F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))
    df = df.select(F.col("_0").cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))),
                       lambda i: F.array_join(F.slice("w", i + 1, window), " "))
    return (df.select("item", F.explode(each).alias("window"))
            .groupBy("window").agg(F.collect_set("item").alias("items")))


def _merge(lists: str, a: str, b: str, closed: int):
    """Sorted ranges, overlapping ones united, of an array of arrays of structs; closed: 1 if ``b`` belongs to its range."""
    flat = F.array_sort(F.flatten(lists))
    start = F.slice(flat, 1, 0)

    def step(done, r):
        top = F.get(done, F.size(done) - 1)
        joined = F.slice(done, 1, F.size(done) - 1)
        grown = F.struct(top[a].alias(a), F.greatest(top[b], r[b]).alias(b))
        return (F.when((F.size(done) > 0) & (r[a] < top[b] + closed), F.concat(joined, F.array(grown)))
                .otherwise(F.concat(done, F.array(r))))
    return F.aggregate(flat, start, step)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW,
                  max_block_bytes: int = MAX_BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Struct ``_row`` (the columns ``keep``, or all) of each document with its words, hit ranges, spans and item ids."""
    spark = docs.sparkSession
    wins = settled(item_windows(benchmark, item_col, item_text, window))
    size = wins.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // max_block_bytes))
    rows = packed(docs.select(*(keep or docs.columns), text_col) if keep else docs, text_col)
    if keep:  # the text goes beside the kept columns, not within the row
        rows = rows.select(F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in keep]).alias("_row"), "_0")
    else:
        rows = rows.select("_row")
    block_of = F.pmod(F.xxhash64("window"), F.lit(n_blocks))

    def scanned(df, b, only_hits=False):
        shared = share(spark, Windows([(r["window"], r["items"]) for r in wins.filter(block_of == b).collect()]))
        kept = [f for f in df.schema.fields if f.name != "_0"]
        return df.mapInArrow(_scanner(shared, text_col, only_hits), T.StructType([*kept, *_HITS.fields]))

    if n_blocks == 1:
        return scanned(rows, 0)
    # Hits depend on the text alone: later blocks are joined by its digest.
    text = F.coalesce("_0" if keep else F.col(f"_row.`{text_col}`"), F.lit(""))
    keyed = rows.select(F.sha2(text, 256).alias("_k"), text.alias("_0"), "_row").select("_k", "_row", "_0")
    base = scanned(keyed, 0)
    more = None
    for b in range(1, n_blocks):
        part = scanned(keyed.select("_k", "_0"), b, True).dropDuplicates(["_k"])
        more = part if more is None else more.unionByName(part)
    more = more.groupBy("_k").agg(*[F.collect_list(c).alias(f"_m{c}") for c in ("words", "spans", "items")])
    both = base.join(more, "_k", "left")
    add = lambda c: F.concat(F.array(c), F.coalesce(f"_m{c}", F.slice(F.array(c), 1, 0)))
    both = both.select("_row", "n_words", *[add(c).alias(c) for c in ("words", "spans", "items")])
    return both.select("_row", "n_words", _merge("words", "first", "last", 1).alias("words"),
                       _merge("spans", "start", "end", 0).alias("spans"),
                       F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def verdict(df: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated (at least one word in twenty is hit)."""
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    df = df.withColumn("n_hit", hit)
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """Per document: id, n_words, n_hit, contaminated, item ids, hit spans in the original text."""
    df = verdict(find_overlaps(docs, benchmark, text_col, keep=(id_col,), **options))
    return df.select(F.col(f"_row.`{id_col}`").alias(id_col), "n_words", "n_hit", "contaminated", "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their columns unchanged."""
    df = verdict(find_overlaps(docs, benchmark, text_col, **options))
    return df.filter(~F.col("contaminated")).select("_row.*")


ship(__name__)
