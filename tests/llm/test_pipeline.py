"""The pipeline's contract on a small table, and the registered queries' SQL."""

import pytest

import corpus_pipeline
from tests.harness import compare, duck_connect

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash", "decontaminate", "mixing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(out := str(tmp_path / str(k)))
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        assert docs.columns[:len(columns)] == columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[5] == counts[4] <= counts[3]


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_quality_rules", "op12_centroids", "op13_merkle"])
def test_sql(spark, name):
    import __spark_entry__ as e
    res = compare(spark, duck_connect(SF), SF, name, e.queries()[name], e.oracle_sql()[name])
    assert res["status"] == "ok", res


def test_every_stage_equals_its_plain_version(spark, tmp_path):
    """Stage by stage on its own input: rules by SQL, lines, fingerprints and windows by brute force, targets by formula."""
    import random

    import duckdb
    import pandas as pd

    from cohortflow.llm.queries import O
    from tests.llm.test_counting import overlaps
    from tests.llm.test_duplicates import fingerprint, line_result, near, prose, roots
    from tests.llm.test_models import plain_targets
    rng = random.Random(31)
    base = [prose(70, rng) for _ in range(12)]
    lines = [prose(14, rng) for _ in range(6)] + ["的" * 3 + "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(60))]
    items = [(k, prose(20, rng)) for k in range(3)]
    texts = [prose(rng.randint(55, 90), rng) for _ in range(25)] + base + [b + " " + prose(1, rng) for b in base[:6]] + base[:3]
    texts += [prose(60, rng) + "\n" + rng.choice(lines) + "\n" + prose(8, rng) for _ in range(20)]
    texts += [prose(60, rng) + "\n" + near(x, 0.9, rng, "abcdefgh") for x in lines for _ in range(2)]
    texts += [prose(40, rng) + " " + rng.choice(items)[1] + " " + prose(30, rng) for _ in range(6)]
    texts += ["short", None, "", "same same same " * 40, lines[0] + "\n" + lines[1]]
    rng.shuffle(texts)
    rows = [(k, t, "en", rng.choice(["a", "b", None]), len(t or ""), -k) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long"
    folder = str(tmp_path / "sf")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, stages = spark.createDataFrame(rows, schema), dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        before = [tuple(r) for r in docs.collect()]
        stages[name](spark, docs, folder).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        return before, sorted(tuple(r) for r in docs.collect())

    before, after = step("quality_rules")
    con = duckdb.connect()
    documents = pd.DataFrame(before, columns=["doc_id", "text", "lang", "source", "n_chars", "size"])  # noqa: F841
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({O['op6_quality_rules']}) WHERE kept").fetchall()}
    assert after == sorted(r for r in before if r[0] in kept) and 0 < len(after) < len(before)
    before, after = step("line_dedup")
    gone = line_result([r[:2] for r in sorted(before)])
    left = lambda r: "\n".join(x for no, x in enumerate(r[1].split("\n")) if no not in gone.get(r[0], []))
    assert gone and after == sorted((r[0], left(r), *r[2:]) for r in before)
    before, after = step("simhash")
    before = sorted(before)
    fps = [fingerprint(r[1]) for r in before]
    part = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert after == [r for k, r in enumerate(before) if part[k] == k] and len(after) < len(before)
    before, after = step("decontaminate")
    bad = {k for k, v in overlaps([r[:2] for r in before], items).items() if v[3]}
    assert bad and after == sorted(r for r in before if r[0] not in bad)
    before, after = step("mixing")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "mix_size", "source_size", "target", "copies", "taken"]
    assert [r[:6] for r in after] == sorted(before)
    sizes, taken = {}, {}
    for r in after:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
        taken[r[3]] = taken.get(r[3], 0) + r[10]
        assert r[10] == r[9] * r[6] and r[6] == len((r[1] or "").split())
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= max(100, 0.05 * t)
