"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-level BPE text is first cut into pieces by the vocabulary's pattern;
tokens never cross pieces. Within a piece the encoding of every prefix is
found in one pass: its last token is the one token that ends there and is
*compatible* with the last token of the prefix before it (two tokens are
compatible if encoding their joined bytes gives the same two tokens). So

    count(prefix) = count(prefix without its last token) + 1

with pieces cut as in the whole text, and the counts of all prefixes of a
piece are kept. Totals, the count at any
byte, and the longest prefix within a token budget are read off those counts
without encoding again.

Pieces repeat, so their counts are kept per worker in a table of at most
``MEMO`` pieces of up to ``MEMO_PIECE`` bytes (older halves are dropped; it
only saves work).

Defined results: null and empty texts have no bytes and no tokens; strings
of special tokens in a text count as the tokenizer file says (one token);
ids may be null or repeated; an empty table gives an empty result; texts of
any length are read whole.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import opened, packed, share, ship

LIMIT = 512
# pieces kept, and the bytes of the longest one that is: at most some 200 MB a worker, some 100 in practice
MEMO, MEMO_PIECE = 1_000_000, 64
# Fixed value: the published split pattern of this byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies write their tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class PrefixCounter:
    """Prefix token counts for one tokenizer file (byte-level BPE without normaliser)."""

    def __init__(self, path: str, memo: int = MEMO):
        # the file is the driver's; its content travels to the workers
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        self.path, self.memo, self._ready = path, memo, False

    def __getstate__(self):
        return {"spec": self.spec, "memo": self.memo, "_ready": False}

    def prepare(self) -> PrefixCounter:
        if self._ready:
            return self
        import regex

        spec = json.loads(self.spec)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        letters = byte_alphabet()
        raw = lambda t: bytes(letters[c] for c in t)
        # numbered in merge order: the 256 bytes, then the token that each merge makes
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.number = {bytes([b]): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.joined = {}
        for a, b in pairs:
            if a + b in self.number:
                raise ValueError("a vocabulary in which two merges make the same token is not supported")
            self.joined[self.number[a], self.number[b]] = self.number[a + b] = len(self.parts)
            self.parts.append((self.number[a], self.number[b]))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) \
            if special else None
        self.split = regex.compile(PATTERN)
        self.longest = max(map(len, self.number))
        # tokens that the encoding of their own bytes reaches: all whose two parts stay apart until joined
        self.tokens = {t: k for t, k in self.number.items() if k < 256 or self._stable(*self.parts[k], k)}
        self.done, self.pairs = {}, {}
        self._ready = True
        return self

    def _stable(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge made before ``limit`` crosses the border of two adjacent tokens.

        The two tokens are taken apart in reverse merge order towards the
        border; an earlier merge of what meets there would have crossed it.
        """
        joined, parts = self.joined, self.parts
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, parts[a][1]
            else:  # of two equal merges the left one, across the border, comes first
                limit, b = b + 1, parts[b][0]

    def _fits(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > self.memo:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stable(a, b, 1 << 30)
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Token counts of the piece's prefixes of 1, 2, ... bytes."""
        last, counts, tokens, fits = [-1], [0], self.tokens, self._fits
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = tokens.get(piece[start:end])
                if token is not None and (not start or fits(last[start], token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        return counts[1:]

    def counts(self, piece: str) -> bytes | array:
        """Token counts of the prefixes of one piece, remembered; the last is the piece's count."""
        found = self.done.get(piece)
        if found is None:
            if len(self.done) >= self.memo:
                for old in list(self.done)[:self.memo // 2]:
                    del self.done[old]
            prefix = self.piece(piece.encode())
            found = bytes(prefix) if prefix[-1] < 256 else array("I", prefix)
            if len(prefix) <= MEMO_PIECE:
                self.done[piece] = found
        return found

    def pieces(self, text: str):
        """(piece, is special) of a text in order."""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                yield from ((p.group(), False) for p in self.split.finditer(text[at:m.start()]))
                yield m.group(), True
                at = m.end()
        yield from ((p.group(), False) for p in self.split.finditer(text[at:] if at else text))

    def total(self, text: str) -> int:
        done, n = self.done, 0
        if self.special is None or not self.special.search(text):
            for p in self.split.findall(text):
                found = done.get(p)
                n += found[-1] if found else self.counts(p)[-1]
            return n
        return sum(1 if s else self.counts(p)[-1] for p, s in self.pieces(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of the text's encoding cut at byte 0, 1, ... (a cut special token counts when complete)."""
        out, n = [np.zeros(1, np.int64)], 0
        for p, special in self.pieces(text):
            size = len(p.encode())
            part = np.zeros(size, np.int64) if special else np.array(list(self.counts(p)), np.int64)
            if special:
                part[-1] = 1
            out.append(n + part)
            n = int(out[-1][-1])
        return np.concatenate(out)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix with at most ``budget`` tokens, cut within the whole text's pieces."""
        n = at = 0
        for p, special in self.pieces(text):
            size = len(p.encode())
            prefix = (1,) if special else self.counts(p)
            if n + prefix[-1] > budget:
                return at + (0 if special else sum(c <= budget - n for c in prefix))
            n, at = n + prefix[-1], at + size
        return at


def _count(shared, budget: int | None, prefixes: bool):
    def run(batches):
        counter = opened(shared).prepare()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes, totals = [len(t.encode()) for t in texts], [counter.total(t) for t in texts]
            cols, names = [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["n_bytes", "n_tokens"]
            if budget is not None:
                # a text within the budget is its own prefix; another's pieces are read until the budget is spent
                cut = [size if n <= budget else counter.longest_prefix(t, budget) for t, size, n in zip(texts, sizes, totals)]
                cols.append(pa.array(cut, pa.int64()))
                names.append("budget_bytes")
            if prefixes:
                cols.append(pa.array([counter.prefix_counts(t).astype("<u4").tobytes() for t in texts], pa.binary()))
                names.append("prefix_counts")
            kept = batch.select(range(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*kept.schema.names, *names])
    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 budget: int | None = None, prefixes: bool = False) -> DataFrame:
    """id, n_bytes and n_tokens of each text.

    budget: also ``budget_bytes``, the bytes of the longest prefix of at most
    that many tokens. prefixes: also ``prefix_counts``, a
    little-endian uint32 array with the count at every byte offset.
    """
    df = packed(docs.select(id_col, text_col), id_col, text_col).select("_0", "_1")
    shared = share(docs.sparkSession, PrefixCounter(path))
    schema = T.StructType([df.schema["_0"]]).add("n_bytes", "long").add("n_tokens", "long")
    schema = schema.add("budget_bytes", "long") if budget is not None else schema
    schema = schema.add("prefix_counts", "binary") if prefixes else schema
    return df.mapInArrow(_count(shared, budget, prefixes), schema).withColumnRenamed("_0", id_col)


ship(__name__)
