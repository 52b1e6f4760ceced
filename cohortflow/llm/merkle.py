"""Merkle manifest of a dataset: one root over all rows, one subroot per group, one proof per row.

A row's leaf hashes its fields. The leaves of a group, in key order, are
numbered by range partitions with offsets, so a group of any size is never
gathered. They are cut into aligned blocks of ``3 ** HEIGHT`` leaves. A block
keeps every level as one string of concatenated hex digests: a parent is the
hash of a fixed-width substring of the level below, and the substrings
flanking a node inside its run are the siblings of its proof. The blocks'
roots are the leaves of the next, far smaller tree, until each group is a
single node; the groups' subroots are then the leaves of one more such tree.
Proofs come back downwards, one keyed join per recursion.

Defined results: a null field counts as ``-``; a null source is a group of
its own, before all others; null keys come first in their group; rows equal
in their key are ordered by leaf, so rows equal in all fields are leaves
side by side. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import settled, ship

ARITY, HEIGHT, DIGEST = 3, 5, 64
BLOCK = ARITY ** HEIGHT
# copies of one row made by one explode
CHUNK = 10_000
RUN = ARITY * DIGEST
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "CAST(array() AS array<struct<l:string,r:string>>)"


def field(value: Column) -> Column:
    """A field with its UTF-8 length before it, so that neighbours can't run into one another; ``-`` for a null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _parents(level: Column) -> Column:
    """The next level of a block: the hash of every run of its string, concatenated."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / RUN).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * RUN + 1, F.lit(RUN)), 256)),
                        "").cast("binary")


def _levels(bottom: Column, height: Column) -> Column:
    """All levels of a block as strings, the given one first; each is made from the one before."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(HEIGHT)), lambda k: (k > 0) & (k <= height))
    return F.aggregate(steps, F.array(bottom), lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))


def _height(size: Column) -> Column:
    """Levels above a block's leaves: all of them in a group of several blocks, else up to the single node."""
    h = F.lit(0)
    for k in range(HEIGHT):
        h = F.when(size > ARITY ** k, F.lit(k + 1)).otherwise(h)
    return h


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, pos, size) nodes with a digest and an item -> settled blocks of at most ``BLOCK`` consecutive ones."""
    member = F.struct((F.col("pos") % BLOCK).cast("int").alias("i"), "digest", "item")
    blocks = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).cast("long").alias("b")).agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(member)).alias("nodes"))
    return settled(blocks)


def _with_levels(blocks: DataFrame) -> DataFrame:
    bottom = F.array_join(F.transform("nodes", lambda x: x.digest), "").cast("binary")
    made = F.struct(_levels(bottom, _height(F.col("size"))).alias("levels"))
    return blocks.select("*", F.inline(F.array(made)))


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every recursion, lowest first, and (g, digest): the root of each group."""
    stack = []
    while True:
        blocks = _blocks(nodes)
        stack.append(blocks)
        top = _with_levels(blocks).select(
            "g", F.col("b").alias("pos"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"),
            F.element_at("levels", -1).cast("string").alias("digest"), F.lit(None).cast("string").alias("item"))
        if (blocks.agg(F.max("size")).first()[0] or 0) <= BLOCK:
            return stack, top.select("g", "digest")
        nodes = top


def _siblings(levels: Column, i: Column) -> Column:
    """The flanking substrings of node ``i`` inside its run, level by level up to the block's root."""
    at = F.slice(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(ARITY ** k).alias("width")) for k in range(HEIGHT)]),
                 1, F.size(levels) - 1)

    def flank(step: Column) -> Column:
        level, node = F.element_at(levels, step.k + 1), F.floor(i / step.width).cast("int")
        run, place = F.floor(node / ARITY).cast("int"), node % ARITY
        return F.struct(
            F.substring(level, run * RUN + 1, place * DIGEST).cast("string").alias("l"),
            F.substring(level, run * RUN + 1 + (place + 1) * DIGEST, (ARITY - 1 - place) * DIGEST).cast("string")
            .alias("r"))

    return F.transform(at, flank)


def unfold(stack: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, pos, item, digest, path, top) of every lowest node.

    ``above`` has one row per group: the path of its root and what every
    node of the group is told (``top``). Each join meets a row once from
    above and at most ``BLOCK`` times from below, so no group is a hot key.
    """
    above = above.select("g", F.lit(0).cast("long").alias("b"), F.col("path").alias("up"), "top")
    for blocks in reversed(stack):
        rows = _with_levels(blocks).join(above, ["g", "b"])
        node = lambda x: F.struct(
            (F.col("b") * BLOCK + x.i).alias("pos"), x["item"].alias("item"), x["digest"].alias("digest"),
            F.concat(_siblings(F.col("levels"), x.i), F.col("up")).alias("path"))
        # the outer form: the other would evaluate the whole array once more to see that it isn't empty
        rows = rows.select("g", "top", F.inline_outer(F.transform("nodes", node)))
        above = rows.select("g", F.col("pos").alias("b"), F.col("path").alias("up"), "top")
    return rows


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s.l, acc, s.r), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.array(s.l, s.r))), ""), 256)


def leaves(docs: DataFrame, key: str, group: str, fields: tuple, text: str, tampers) -> DataFrame:
    """One row per distinct (group, key, leaf, tampered leaf) and its number of copies."""
    value = {f: F.col(f"`{f}`") for f in fields}
    changed = F.when(tampers(value[key]), F.translate(value[text], "\n", "")).otherwise(value[text])
    leaf = digest(*[field(value[f]) for f in fields])
    tampered = F.when(value[text].contains("\n") & tampers(value[key]),
                      digest(*[field(changed if f == text else value[f]) for f in fields]))
    # the group as a string that is never null and sorts as the groups do, null first
    rows = docs.select(F.coalesce(F.concat(F.lit("="), value[group].cast("string")), F.lit("")).alias("g"),
                       value[key].alias("k"), leaf.alias("digest"), tampered.alias("tampered"))
    return rows.groupBy("g", "k", "digest", "tampered").agg(F.count(F.lit(1)).alias("n"))


def even_checksum(key: Column) -> Column:
    """Rows whose crc32 of the decimal key is even are tampered with."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple = FIELDS, text: str = "text",
             tampers=even_checksum) -> DataFrame:
    """Per row: key, leaf, subroot of its group, root, path of siblings, and the root folded from the tampered leaf.

    ``tampers`` says which rows lose the line breaks of ``text`` before they
    are folded again with the siblings of the untouched dataset.
    """
    counted = leaves(docs, key, group, fields, text, tampers)
    # equal rows travel once; their copies become leaves of their own before they are numbered
    chunks = counted.select("g", "k", "digest", "tampered", "n",
                            F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("c"))
    each = chunks.select("g", "k", "digest", "tampered",
                         F.explode(F.sequence("c", F.least(F.col("n"), F.col("c") + CHUNK) - 1)).alias("c"))
    placed = numbered(each, ["g"], ["k", "digest", "c"], before="pos", total="size")
    stack, subroots = grow(placed.select("g", "pos", "size", "digest", F.struct("k", "tampered").alias("item")))
    groups = numbered(subroots.withColumn("all", F.lit("")), ["all"], ["g"], before="pos", total="size")
    upper, root = grow(groups.select(F.col("all").alias("g"), "pos", "size", "digest", F.col("g").alias("item")))
    per_group = settled(unfold(upper, root.select("g", F.expr(NO_PATH).alias("path"), F.col("digest").alias("top")))
                        .select(F.col("item").alias("g"), "path", F.struct("digest", F.col("top").alias("root")).alias("top")))
    rows = unfold(stack, per_group)
    rows = rows.select(F.col("item.k").alias("k"), F.col("digest").alias("leaf"), F.col("top.digest").alias("subroot"),
                       "top.root", "path", F.coalesce("item.tampered", "digest").alias("told"))
    return rows.select(F.col("k").alias(key), "leaf", "subroot", "root", "path",
                       fold(F.col("told"), F.col("path")).alias("folded_root"))


ship(__name__)
