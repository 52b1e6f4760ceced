"""SimHash, line dedup, suffix dedup and components against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from cohortflow.llm import components, line_dedup, simhash, suffix_dedup

RNG = random.Random(9)
VOCAB = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def prose(n, rng):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(70, 95)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.connected_components(
        spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(100, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: want[n] for n in nodes}


def fingerprint(text):
    import re
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(40, rng) for _ in range(30)]
    texts += [t + " " + rng.choice(VOCAB) for t in texts[:12]] + texts[:5] + [None, "", " ", "A b", "a B", "é x y z"]
    for t in list(texts[:10]):
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.grouped(docs).collect()}
    fps = [fingerprint(t) for t in texts]
    want = roots(len(texts), [(i, j) for i in range(len(fps)) for j in range(i)
                              if (fps[i] ^ fps[j]).bit_count() <= 2])
    for k in range(len(texts)):
        assert got[k]["fp"] % 2**64 == fps[k] and got[k]["component_id"] == want[k], texts[k]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_simhash_ties_repeats_and_empty(spark):
    schema = "doc_id long, text string, fp string, _h int"
    docs = spark.createDataFrame([(3, "x y z", "p", 1), (3, "x y z", "p", 1), (3, "x y z", "q", 1), (None, "x y z", "r", 2),
                                  (None, None, "s", 3), (None, "", None, 4)], schema)
    out = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    assert len(out) == 2 and sum(r[0] == 3 for r in out) == 1
    ids = {(r["doc_id"], r["component_id"]) for r in simhash.grouped(docs).collect()}
    assert ids == {(3, 3), (None, 3), (None, None)}
    assert simhash.grouped(docs.limit(0)).count() == simhash.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps[50:] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    fps[120:] ^= np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)
    bits = list(range(64))
    got = simhash.within(fps, fps[:70], radius, simhash.planes(fps, bits), bits)
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps[:70]])
    assert (got == want).all()


def test_block_links_span_the_components():
    rng = np.random.default_rng(8)
    fps = np.unique((rng.integers(0, 2**12, 600, dtype=np.uint64) << np.uint64(8)))
    pairs = simhash.linked(fps, 2)
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2]
    assert roots(len(fps), pairs) == roots(len(fps), brute) and len(pairs) == len(fps) - len(set(roots(len(fps), brute)))


def shingles(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def line_result(docs):
    lines = [(k, no, x.strip(" \t\n\x0b\x0c\r")) for k, t in docs for no, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 10]
    links = []
    for i in range(len(lines)):
        for j in range(i):
            a, b = shingles(lines[i][2]), shingles(lines[j][2])
            if len(a & b) >= 0.8 * len(a | b):
                links.append((i, j))
    gone = {}
    for i, r in enumerate(roots(len(lines), links)):
        if r != i:  # lines are in (id, number) order
            gone.setdefault(lines[i][0], []).append(lines[i][1])
    return gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    base = [prose(25, rng) for _ in range(25)]
    docs = []
    for k in range(40):
        parts = [prose(20, rng), rng.choice(base), "short", ""]
        if k % 3 == 0:
            parts.append(rng.choice(base) + " " + rng.choice(VOCAB))
        if k % 4 == 0:
            parts.append("  " + rng.choice(base).replace("a", "e", 1) + " ")
        rng.shuffle(parts)
        docs.append((k, "\n".join(parts)))
    docs += [(90, None), (91, ""), (92, "é" * 30), (93, "é" * 31), (94, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.report(df).collect()}
    want = line_result(docs)
    assert {k: v for k, v in got.items() if v} == want
    texts = dict(docs)
    for r in line_dedup.dedup_lines(df).collect():
        t = texts[r["doc_id"]]
        left = None if t is None else "\n".join(
            x for no, x in enumerate(t.split("\n")) if no not in want.get(r["doc_id"], []))
        assert r["text"] == left


def test_line_dedup_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a longer line\nhere", 1), (7, "a longer line", 2), (7, "a longer line", 3)],
                               "doc_id long, text string, gone int")
    out = sorted((r["gone"], r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert out == [(1, "here"), (2, "a longer line"), (3, "a longer line")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == line_dedup.report(df.limit(0)).count() == 0


def near(line, share, rng, letters):
    """The line with characters replaced until at most ``share`` of the shingles agree by Jaccard."""
    out, a = list(line), shingles(line)
    while True:
        k = rng.randrange(len(out))
        before, out[k] = out[k], rng.choice(letters)
        b = shingles("".join(out))
        if len(a & b) < share * len(a | b):
            out[k] = before
            return "".join(out)


def test_line_dedup_unspaced_lines(spark):
    rng = random.Random(14)
    han = [chr(0x4E00 + k) for k in range(2000)]
    first = ["".join(rng.choice(han) for _ in range(66)) for _ in range(30)]
    first += ["https://www." + "".join(rng.choice("abcdef0123456789/") for _ in range(90)) for _ in range(30)]
    lines = first + ["的" + x[1:] if x[0] != "的" else "地" + x[1:] for x in first]
    docs = list(enumerate(lines))
    want = line_result(docs)
    assert len(want) == 60
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["removed"] for r in got if r["removed"]} == want


def test_line_signature_recall_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.86 of short, middle and long lines: about 0.987 or more share a band."""
    rng = random.Random(15)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for low, high in ((40, 70), (70, 100), (300, 500)):
        texts = []
        for _ in range(400):
            line = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
            texts += [line, near(line, 0.8, rng, letters)]
        lines = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "d1 long, d2 long, line string")
        bands = {r["d1"]: set(r["bands"]) for r in line_dedup.signatures(lines).collect()}
        assert sum(bool(bands[k] & bands[k + 1]) for k in range(0, 800, 2)) >= 0.96 * 400


def test_line_dedup_many_clusters_in_one_band(spark):
    """Every band holds all lines; the links of clusters without a first leader are found too."""
    rng = random.Random(16)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(40)]
    texts = [x for b in base for x in (b, b[:-1] + "!", "?" + b[1:])]
    lines = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "d1 long, d2 long, line string")
    signed = line_dedup.signatures(lines).selectExpr("d1", "d2", "53 AS n", "r1", "r2", "h1", "h2", "array(0L, 1L) AS bands")
    found = {r["node"]: r["root"] for r in line_dedup.components(signed, lines).collect()}
    name = lambda k: f"{k:016X}" * 2
    assert found == {name(k): name(k - k % 3) for k in range(len(texts))}


def true_pairs(sets):
    """All pairs of similarity 0.8 or more, exactly: such a pair shares one of the rarest fifth of either's shingles."""
    seen = Counter(x for s in sets for x in s)
    index, out = {}, []
    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda x: (seen[x], x))[:len(s) - math.ceil(0.8 * len(s)) + 1]
        for j in {j for x in rare for j in index.get(x, ())}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                out.append((i, j))
        for x in rare:
            index.setdefault(x, []).append(i)
    return out


def recall_of(spark, texts):
    """Share of the true pairs whose lines lie in one component, and their number."""
    true = true_pairs([shingles(x) for x in texts])
    lines = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "d1 long, d2 long, line string")
    got = {int(r["node"][:16], 16): r["root"] for r in line_dedup.components(
        line_dedup.signatures(lines), lines).collect()}
    want, by = roots(len(texts), true), {}
    for i, r in got.items():
        by.setdefault(r, set()).add(want[i])
    assert all(len(x) == 1 for x in by.values())  # lines joined are joined by true links
    return sum(i in got and got.get(i) == got.get(j) for i, j in true) / len(true), len(true)


def test_line_dedup_recall_of_borderline_clusters(spark):
    """Clusters whose pairs lie about the threshold: at least 0.99 of the true pairs in one component."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = []
    for _ in range(30):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(40, 200)))
        for _ in range(20):
            line = list(base)
            for _ in range(max(1, len(base) // 120)):
                line[rng.randrange(len(line))] = rng.choice(letters)
            texts.append("".join(line))
    share, pairs = recall_of(spark, sorted(set(texts)))
    print("recall", share, pairs)
    assert pairs > 1000 and share >= 0.99


def test_line_dedup_recall_on_the_documents(spark):
    """Against exact all pairs on the lines of sf0.01: at least 0.98 of the true pairs in one component."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    lines = {x.strip(" \t\n\x0b\x0c\r") for r in rows for x in (r["text"] or "").split("\n")}
    share, pairs = recall_of(spark, sorted(x for x in lines if len(x) >= 10))
    print("recall", share, pairs)
    assert pairs >= 200 and share >= 0.98


def test_line_dedup_loses_no_link_at_the_threshold(spark):
    """Pairs just above the similarity, short lines too: every true pair is linked."""
    rng = random.Random(19)
    texts = []
    for low, high in ((10, 17), (40, 70), (70, 100), (300, 400)):
        for _ in range(250):
            line = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(low, high)))
            texts += [line, near(line, 0.8, rng, "abcdefghij "), line + line[:max(1, len(line) // 6)]]
    texts = sorted({x.strip() for x in texts if len(x.strip()) >= 10})
    share, pairs = recall_of(spark, texts)
    assert pairs > 1000 and share == 1


def test_windows_of_similar_lines_meet():
    rng = random.Random(20)
    for letters in ("ab", "abcd", "abcdefghijklmnopqrstuvwxyz "):
        texts = []
        for _ in range(150):
            line = "".join(rng.choice(letters) for _ in range(rng.choice([10, 12, 14, 15, 16, 18, 25, 60, 200])))
            texts += [line, near(line, 0.8, rng, letters), line + line[:6]]
        texts = sorted(set(texts))
        owner, key = line_dedup.windows(*line_dedup.shingle_sets(texts))
        own = {}
        for i, k in zip(owner.tolist(), key.tolist()):
            own.setdefault(i, set()).add(k)
        true = true_pairs([shingles(x) for x in texts])
        assert len(true) > 50 and all(own[i] & own[j] for i, j in true)


def test_line_dedup_pairs_grow_with_the_lines(spark, monkeypatch):
    """Clusters that all share a passage: few pairs are compared, however many lines a window has, and all links are found."""
    rng, compared = random.Random(21), []
    own = line_dedup._compared

    def counted(pairs, texts, labels):
        compared.append(pairs.count())
        return own(pairs, texts, labels)

    monkeypatch.setattr(line_dedup, "_compared", counted)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choice(letters) for _ in range(120))
    texts = []
    for _ in range(12):
        base = passage + "".join(rng.choice(letters) for _ in range(120))
        texts += [base[:k] + "!" + base[k + 1:] for k in range(200, 240)]
    lines = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "d1 long, d2 long, line string")
    found = {r["node"]: r["root"] for r in line_dedup.components(None, lines).collect()}
    name = lambda k: f"{k:016X}" * 2
    assert found == {name(k): name(k - k % 40) for k in range(len(texts))}
    # all pairs in the clusters would be 9360
    assert compared[0] <= line_dedup.GATHER * len(texts) / 2 and compared[1] <= len(texts) / 2


def test_line_dedup_in_turns(spark, monkeypatch, tmp_path):
    """The turns share out the windows, give the same components and leave no files."""
    rng = random.Random(22)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(10, 90))).strip() for _ in range(150)]
    texts = sorted({y for x in texts for y in (x, near(x, 0.8, rng, "abcdef ").strip()) if len(y) >= 10})
    sets = line_dedup.shingle_sets(texts)
    turns = [np.stack(line_dedup.windows(*sets, None, turn, 3)) for turn in range(3)]
    assert sorted(np.concatenate(turns, axis=1).T.tolist()) == sorted(np.stack(line_dedup.windows(*sets)).T.tolist())
    assert all(turns[a][1].tolist() and not set(turns[a][1].tolist()) & set(turns[a - 1][1].tolist()) for a in range(3))
    monkeypatch.setattr(line_dedup, "TURN_CHARS", 2000)
    folder = (tmp_path / "kept").as_uri()
    monkeypatch.setattr(line_dedup, "ensure_checkpoint_dir", lambda spark: folder)
    share, pairs = recall_of(spark, texts)
    assert pairs >= 30 and share == 1 and not list(tmp_path.glob("kept/lines-*"))


def test_shingle_sets_equal_plain_sets():
    rng = random.Random(18)
    lines = ["x" * 8, "short", "é" * 40, "abcdefgh" * 30] + ["".join(rng.choice("abc") for _ in range(k)) for k in range(8, 90)]
    hashes, borders = line_dedup.shingle_sets(lines)
    own = [set(hashes[borders[i]:borders[i + 1]].tolist()) for i in range(len(lines))]
    plain = [shingles(x.ljust(8, "\0")) for x in lines]
    assert [len(x) for x in own] == [len(x) for x in plain]
    for i in range(0, len(lines), 7):
        for j in range(len(lines)):
            assert len(own[i] & own[j]) == len(plain[i] & plain[j])
    one = [line_dedup.signed_lines([x]) for x in lines]
    n, bands, sketch = line_dedup.signed_lines(lines)
    assert all((x[2][0] == row).all() for x, row in zip(one, sketch))
    assert [x[0][0] for x in one] == n.tolist() and [x[1][0] for x in one] == bands
    assert [len(b) for b in bands] == [6 * (int(k >= 64) + int(k <= 80)) for k in n]


def cut(texts, window=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                hit[i:i + window] = True
        spans = int((hit[:-1] & ~np.concatenate(([False], hit[:-1]))[:len(r)]).sum()) if len(r) else 0
        out.append((len(r), int(hit.sum()), spans,
                    hashlib.sha256(bytes(b for b, h in zip(r, hit) if not h)).hexdigest()))
    return out


def repeats():
    rng = random.Random(12)
    base, passage = prose(200, rng), prose(60, rng)
    texts = [base, base, base[:400] + "X" + base[400:], prose(30, rng) + base[100:330] + prose(30, rng),
             base[50:249], base[50:250], passage + passage, "é" * 150, "ab" * 250, None, "", "short"]
    texts += [prose(40, rng) + passage + prose(40, rng) for _ in range(12)]
    for _ in range(25):
        k = rng.randrange(len(base))
        texts.append(base[:k] + rng.choice("xyz") + base[k + rng.randrange(3):])
    return texts


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MAX_SPANS", most)
    texts = repeats()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.dedup(df).collect()}
    for k, want in enumerate(cut(texts)):
        assert got[k] == want, (k, texts[k])


def test_suffix_dedup_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x" * 199 + "y"), (1, "x" * 199 + "y"), (None, "z")], "doc_id long, text string")
    rows = suffix_dedup.dedup(df, keep_bytes=True).collect()
    assert sorted((r["n_removed"], bytes(r["kept"])) for r in rows) == [(0, b"z"), (200, b""), (200, b"")]
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_deep_shallow_sort_orders_groups():
    rng = random.Random(1)
    text = ("".join(rng.choice("ab") for _ in range(60)) + prose(60, rng)) * 3 + "c" * 400
    raw = text.encode()
    start = np.arange(len(raw) - 199)
    seen = Counter(raw[i:i + 200] for i in start)
    assert (suffix_dedup.repeated(raw, start, np.zeros(len(start), np.int64))
            == np.array([seen[raw[i:i + 200]] > 1 for i in start])).all()
    trie = suffix_dedup.BlindTrie(raw, 0)
    for i in start[:150].tolist():
        trie.insert(i)
    order = [raw[leaf[0]:leaf[0] + 200] for leaf in trie.leaves()]
    assert order == sorted(order)


def test_every_window_has_one_anchor():
    raw = prose(300, random.Random(3)).encode()
    _, _, first, last, place = suffix_dedup.anchors(raw)
    assert first[0] == 0 and last[-1] == len(raw) - 200 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place + suffix_dedup.GRAM <= first + suffix_dedup.WINDOW).all()


def test_lines_with_company_keeps_all_pairs_and_drops_strangers(spark, tmp_path, monkeypatch):
    """Of lines that share a passage only those with a line at the similarity are left; blocks and turns don't matter."""
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choice(letters) for _ in range(60))
    texts = [passage + "".join(rng.choice(letters) for _ in range(120)) for _ in range(60)]
    for low, high in ((16, 24), (40, 70), (300, 400)):
        for _ in range(30):
            line = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
            texts += [line, near(line, 0.8, rng, letters)]
    texts = sorted(set(texts))
    want = {k for pair in true_pairs([shingles(x) for x in texts]) for k in pair}
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "COUNT_CHARS", 4000)
    rows = spark.createDataFrame([(k, k, x, 1, k) for k, x in enumerate(texts)], "d1 long, d2 long, line string, n_lines long, no long")
    with line_dedup.shuffles_dropped(spark):
        left = {r["no"] for r in line_dedup.lines_with_company(spark, (tmp_path / "kept").as_uri(), rows.repartition(3)).collect()}
    assert len(want) >= 60 and want <= left and len(left) <= len(want) + 5


def test_pairs_of_a_window_are_made_in_arrays():
    """All pairs of different components and like sizes of a key, none of the same component."""
    rng = np.random.default_rng(24)
    key, c, n = rng.integers(0, 6, 400), rng.integers(0, 9, 400), rng.integers(8, 60, 400)
    key[:30], c[:30] = 7, 3  # one component alone has this key
    got = sorted((min(a, b), max(a, b)) for one, other in line_dedup.meetings(key, c, n) for a, b in zip(one.tolist(), other.tolist()))
    want = [(a, b) for a in range(400) for b in range(a + 1, 400)
            if key[a] == key[b] and c[a] != c[b] and 4 * max(n[a], n[b]) <= 5 * min(n[a], n[b])]
    assert got == want


def test_packed_pairs_are_those_of_like_parities(spark):
    """Pairs far apart by parities go, those of the similarity stay, each once; the top bit of a word counts as any other."""
    rng = random.Random(25)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for _ in range(40):
        line = "".join(rng.choice(letters) for _ in range(rng.randint(60, 300)))
        texts += [line, near(line, 0.8, rng, letters), line[:len(line) // 2] + "".join(rng.choice(letters) for _ in range(len(line) // 2))]
    hashes, borders = line_dedup.shingle_sets(texts)
    n, bits = np.diff(borders), line_dedup.parities(hashes, borders)
    cols = [np.arange(len(texts)), np.arange(len(texts)), n, *bits.T]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), *[pa.array(np.ascontiguousarray(x, np.int64)) for x in cols]],
                                       names=["line", *line_dedup.LINE])
    packed = list(line_dedup._met(3)(line_dedup._dealt_keys(0, 1, 4)([batch])))
    got = []
    for k in range(3):
        once = line_dedup._each_once(iter([x.filter(pc.equal(x.column("share"), k)) for x in packed]))
        got += [(a, b) for x in once for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    assert len(got) == len(set(got))
    own = [set(hashes[borders[i]:borders[i + 1]].tolist()) for i in range(len(texts))]
    true = {(min(i, j), max(i, j)) for i, j in true_pairs(own)}
    apart = lambda a, b: sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(bits[a], bits[b]))
    assert len(true) >= 40 and true <= set(got) and all(9 * apart(a, b) <= n[a] + n[b] for a, b in got)
