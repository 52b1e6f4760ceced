"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document: the ledger keeps the measurements
and one failure bit per rule. Policies are named masks over those bits, so a
new policy version or an ablation re-reads the ledger and never the texts.

Defined results: a null text has no words, so it fails the word-count rule;
ids may be null or repeated (one ledger row per input row); an empty table
gives an empty ledger; texts of any length are read whole. Repeated 3-word
windows are recognised by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, packed, space_words, unpacked

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# rule -> predicate over the measurements; a rule's bit is its position.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 40 * n_words",
}
BASE = ("few_words", "repeated_words")
# policy version -> rules that reject
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "long_words"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _measured(df: DataFrame) -> DataFrame:
    """Measurements of column ``_0`` beside ``_row``."""
    text = F.coalesce("_0", F.lit(""))
    df = once(df, ["_row"], _t=text, _w=space_words("_0"))
    n = F.size("_w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    df = once(
        df, ["_row"], n_words=n.cast("long"), _g=grams,
        _l=F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        word_chars=F.char_length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long"),
        n_symbols=F.char_length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"))
    # windows found twice or more sit side by side once sorted by hash
    twice = F.size("_g") > F.size(F.array_distinct("_g"))
    found = F.when(twice, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    kept = ["_row", "n_words", "word_chars", "n_symbols"]
    df = once(df, kept, _s=found, n_lines=F.size("_l").cast("long"),
              n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    kept += ["n_lines", "n_dup_lines"]
    same = lambda a, b: F.coalesce(F.get("_s", a)["h"] == F.get("_s", b)["h"], F.lit(False))
    df = once(df, kept, _p=F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda j: same(j, j - 1) | same(j, j + 1)),
        lambda j: F.get("_s", j)["i"])))
    # each start covers three words, or as many as lie before the next start
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(
        F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return once(df, kept, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"))


def _bits() -> Column:
    out = F.lit(0).cast("long")
    for rule, failed in RULES.items():
        out = out.bitwiseOR(F.when(F.expr(failed), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``n_lines`` and ``failure_bits``."""
    df = _measured(packed(docs.select(id_col, text_col), text_col))
    return df.select(F.col(f"_row.`{id_col}`").alias(id_col), *MEASURES, "n_lines", _bits().alias("failure_bits"))


def passes(policy: str = "v1", bits: str = "failure_bits") -> Column:
    """Verdict of a policy version over stored bits."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, rejected by it alone, and kept if it were dropped.

    The ledger is first counted by bit pattern (at most 2^rules rows), so the
    rules are compared on that small table.
    """
    m = mask(policy)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit"))
                      for r in POLICIES[policy]])
    seen = (rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).count()
            .select("bits", "count", F.explode(rules).alias("r")))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias
    return seen.groupBy(F.col("r.rule").alias("rule")).agg(
        n(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)("n_failed"),
        n(F.col("bits") == F.col("r.bit"))("n_only"), n(rest == 0)("n_kept_without"))


def keep(docs: DataFrame, text_col: str = "text", policy: str = "v1") -> DataFrame:
    """The documents a policy keeps, with their columns unchanged."""
    df = once(_measured(packed(docs, text_col)), ["_row"], failure_bits=_bits())
    return unpacked(df.filter(passes(policy)))
