"""Prefix hashes, extensions, likeness and neighbours against plain Python."""

import hashlib
import random

import numpy as np

from cohortflow.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, key string, bucket int, digest int, copies int"


def one(text):
    return fp.Fingerprints(*fp.code_points([text]))


def near(a, b):
    return float(fp.likeness(one(a), one(b))[0])


def test_spans_and_extensions_equal_plain_strings():
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(400)) + "é\U0001F600\x00\x00x" * 20
    p = fp.Prefixes(fp.code_points([text])[0])
    i, j = np.array([rng.randrange(len(text)) for _ in range(3000)]), np.array([rng.randrange(len(text)) for _ in range(3000)])
    limit = len(text) - np.maximum(i, j)
    got = p.common_extension(i, j, limit)
    for a, b, m, g in zip(i, j, limit, got):
        want = next((k for k in range(m) if text[a + k] != text[b + k]), m)
        assert g == want
    length = np.minimum(limit, 5)
    assert p.equal(i, j, length).tolist() == [text[a:a + k] == text[b:b + k] for a, b, k in zip(i, j, length)]


def test_hash_is_the_polynomial(monkeypatch):
    text = "some text é " * 30
    for part in (7, 1 << 18):
        monkeypatch.setattr(fp, "PART", part)
        p = fp.Prefixes(fp.code_points([text])[0])
        for b, base in enumerate(fp.BASES):
            want = sum((ord(c) + 1) * pow(base, k, int(fp.P)) for k, c in enumerate(text[5:50])) % int(fp.P)
            assert int(p.spans(np.array([5]), np.array([50]), b)[0]) == want
    f = one(text).text()
    monkeypatch.setattr(fp, "PART", 64)
    assert one(text).text() == f


def test_likeness():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for n in (1, 5, 40, 300, 3000):
        a, b = text(n), text(n + 7)
        assert near(a, a) == 1.0 and near(a, b) < 0.1 and near(a, b) == near(b, a)
        if n >= 5:
            assert 0.5 < near(a, fp.edited(a, b)) < 0.95
    w = text(2000).split()
    for k in range(0, 2000, 100):
        w[k] = "changed"
    a = text(2000)
    w = a.split()
    for k in range(0, 2000, 100):
        w[k] = "changed"
    assert near(a, " ".join(w)) > 0.5  # many places: the span minima tell
    assert near(a, a[:-1]) > 0.85 and near(a, a[:-1]) < 1 and near(a, "x" + a) > 0.85
    assert near("", "") == 1.0 and near("", "a") == 0.0 and near("a", "b") < 1 and near("aa", "aaa") < 1
    strings = one(a).text() + one(w[0]).text() + one("").text()
    back, own = fp.parsed(strings), fp.Fingerprints(*fp.code_points([a, w[0], ""]))
    assert back.text() == strings == own.text()
    assert fp.likeness(back, own).tolist() == [1.0] * 3
    assert len({len(s) for s in strings}) == 1


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        a, b = r[1] or "", nxt[1] or ""
        c = a[:len(a) - len(a) // 3] + b[:len(a) // 3]
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        out.append((r[0], len(a), hashlib.sha256(c.encode()).hexdigest(), one(a).text()[0], one(c).text()[0],
                    near(a, c), near(a, b), common))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, fp.edited_neighbours(df).collect()), key=str)


def rows_of(rng, n):
    words = [f"w{k}é" for k in range(300)]
    return [(k * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "x", 1, 2, 3) for k in range(n)]


def test_neighbours_equal_sorting(spark):
    rng = random.Random(9)
    rows = rows_of(rng, 200)
    rows += [(2 ** 60 + 1, "big", "", 0, 0, 0), (2 ** 60, "big", "", 0, 0, 0), (7, None, None, None, None, None),
             (10, "", "", 0, 0, 0), (None, "no id", "", 0, 0, 0), (None, "no id too", "", 0, 0, 0),
             (13, "long " * 60_000, "", 0, 0, 0), (9, rows[3][1], "", 0, 0, 0), (9, "other", "", 0, 0, 0)]
    rows += [rows[5]] * 150 + [(None, "no id", "", 0, 0, 0)] * 3  # repeated rows
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_small_and_empty_tables(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    for rows in ([(1, "only one row here", "", 0, 0, 0)], [(1, "same", "", 0, 0, 0)] * 2, [(1, None, "", 0, 0, 0)],
                 rows_of(random.Random(2), 3)):
        assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_batches_share_their_border_rows(monkeypatch):
    monkeypatch.setattr(fp, "BATCH_POINTS", 50)
    rows = [(k, "t" * (k * 7 % 60), 1, 0, False) for k in range(40)]
    pairs = [(a[0], b[0]) for run in fp._batches(iter(rows)) for a, b in zip(run, run[1:])]
    assert pairs == [(k, k + 1) for k in range(39)]
