"""The manifest against a tree grown in plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from cohortflow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, g int, k int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def climb(nodes):
    """Root and, per node, its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            run = i // 3 * 3
            paths[j].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        nodes = [H("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault("" if r[1] is None else "=" + r[1], []).append(r)
    keys, out = sorted(by, key=lambda s: s.encode()), []
    for g in keys:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {g: climb([leaf(r, r[4]) for r in by[g]]) for g in keys}
    root, tops = climb([trees[g][0] for g in keys])
    for g, top in zip(keys, tops):
        sub, paths = trees[g]
        for r, path in zip(by[g], paths):
            steps = path + top
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            cur = leaf(r, r[4] if odd or r[4] is None else r[4].replace("\n", ""))
            for left, right in steps:
                cur = H(left + cur + right)
            out.append((r[0], leaf(r, r[4]), sub, root, H("".join(a + b for a, b in steps)), cur, cur == root))
    return sorted(out, key=str)


def got(docs):
    df = merkle.manifest(docs)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "path", "folded_root"]
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")),
                                       "folded_root", F.col("folded_root") == F.col("root")).collect()), key=str)


def test_manifest_equals_plain_tree(spark):
    rng = random.Random(7)
    # a source of more than two blocks, single leaves, repeated ids and rows, nulls, a very long text, clashing columns
    rows = [(k, "hot", "en", k, f"text {k}\nline\n", "x", 1, 2) for k in range(600)]
    rows += [(k, rng.choice(["a", "b", "é", "", None, "Z"]), None, None, rng.choice(["", None, "a\nb", "c"]), None, None, 3)
             for k in range(60)]
    rows += [(7, "one", "en", 1, "L" * 200_000 + "\n", "", 0, 0), (None, "hot", "en", 1, "t\n", "", 0, 0),
             (None, "hot", None, 1, None, "", 0, 0)]
    rows += [(5, "twin", "en", 3, "same\n", "p", 1, 1)] * 20 + [(5, "twin", "en", 3, "other", "p", 1, 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(docs) == brute(rows)


def test_block_borders_and_small_tables(spark):
    for n in (1, 2, 3, 4, 243, 244):
        rows = [(k, "s", "en", k, f"t{k}", None, None, None) for k in range(n)]
        assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_leaves_of_a_group_in_several_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k * 3, "hot" if k % 3 else None, "en", k, f"t{k}\n", None, None, None) for k in range(1500)]
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
