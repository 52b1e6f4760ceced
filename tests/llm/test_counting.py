"""Token counts, quality rules and decontamination against plain versions."""

import random
import re

import pytest

from cohortflow.llm import decontaminate, quality_rules, token_counts

TEXTS = [None, "", " ", "one", "a b c", "a b c a b c a b c", "x\nx\n\nx\n y", "# $ %\n|<>&* a", "é ñ 　 日本 é ñ",
         "w " * 60, "tab\tsep\x0bline\x0cfeed\rret", "\n\n", " lead and trail "]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def measured(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_ledger_matches_plain_measurements(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(n)) for n in (2, 5, 40, 90)]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    for k, t in enumerate(texts):
        want = measured(t)
        assert tuple(rows[k][m] for m in quality_rules.MEASURES) == want, t
        base = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert bool(rows[k]["failure_bits"] & quality_rules.mask("base")) == base


def test_policies_and_ablation(spark):
    good = " ".join(f"w{k}" for k in range(80))
    docs = frame(spark, [(1, good), (2, "short"), (3, "w w w " * 30), (4, "# " * 3), (None, good), (None, None)],
                 "doc_id long, text string")
    led = quality_rules.ledger(docs)
    assert led.filter(quality_rules.passes("v1")).count() == 2
    out = {r["rule"]: r for r in quality_rules.ablation(led).collect()}
    assert out["few_words"]["n_failed"] == 3 and out["few_words"]["n_only"] == 2
    assert out["repeated_words"]["n_kept_without"] == 3


def test_keep_leaves_clashing_columns_alone(spark):
    good = " ".join(f"w{k}" for k in range(80))
    docs = frame(spark, [(1, good, 7, "a"), (2, "no", 8, "b")], "doc_id long, text string, n_words int, _row string")
    out = quality_rules.keep(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.collect()] == [(1, good, 7, "a")]
    assert quality_rules.keep(docs.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def overlaps(docs, items):
    out = {}
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(13, len(b))
            for win in {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i:i + n]) == win:
                        hit.update(range(i, i + n))
                        ids.add(item)
        ids = sorted(str(i) for i in ids if i is not None)
        out[key] = (len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 25, 600])
def test_overlaps_match_brute_force(spark, block):
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "é1", "42", "x"]
    phrase = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, phrase(30)), (2, phrase(13)), (3, "Short one"), (4, ""), (5, None), (None, phrase(20)), (3, "two words")]
    full = [i[1] for i in items if i[1]]
    docs = [(k, phrase(40) + ", " + rng.choice(full) + "! " + phrase(5) if k % 2 else phrase(50)) for k in range(12)]
    docs += [(100, None), (101, ""), (102, "SHORT   one"), (103, "xshort one"), (104, items[0][1] + " tail " * 500)]
    d = frame(spark, docs, "doc_id long, text string")
    b = frame(spark, items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.overlaps(d, b, max_block_bytes=block).collect()}
    want = overlaps(docs, items)
    assert set(got) == set(want)
    for key, (n, hit, ids, bad) in want.items():
        r = got[key]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, ids, bad), key
    spans = got[102]["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(0, 11)]


def test_decontamination_keeps_columns_and_empty_tables(spark):
    d = frame(spark, [(1, "short one", 3), (1, "other", 4), (None, "short one", 5)], "doc_id long, text string, items int")
    b = frame(spark, [(3, "Short one")], "item_id long, text string")
    out = decontaminate.drop_contaminated(d, b)
    assert out.columns == d.columns and [tuple(r) for r in out.collect()] == [(1, "other", 4)]
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == 3
    assert decontaminate.drop_contaminated(d.limit(0), b).count() == 0


def counter():
    P = pytest.importorskip("public_tokenizers")
    return token_counts.PrefixCounter(P.path("byte_bpe_50k.json")).prepare()


SAMPLES = ["", "Hello world", "a  b <|endoftext|> c", " \n\n x's I'LL 12345 ñandú 日本語 ", "<|endoftext|>", "é\U0001F600!!!!",
           " " * 300, "aaaa" * 200, "ththererlynt Ouwhea\tof the\r\n\r\n  end"]


def test_token_counts_equal_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tok, c, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), counter(), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzeeetthhnnré ñß0123 .,'\n\t-_=/中"
    texts = SAMPLES + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert c.total(t) == len(tok.encode(t, add_special_tokens=False).ids), t


def test_every_prefix_of_a_piece_is_exact():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tok, c = Tokenizer.from_file(P.path("byte_bpe_50k.json")), counter()
    for word in ("internationalisation", " thereafterwards", "Zusammengehörigkeit"):
        counts = c.prefix_counts(word)
        for n in range(len(word) + 1):
            cut = word[:n]
            assert counts[len(cut.encode())] == len(tok.encode(cut, add_special_tokens=False).ids), cut


def test_budget_prefix_and_frame(spark):
    c = counter()
    docs = frame(spark, [(k, t) for k, t in enumerate(SAMPLES)] + [(99, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_counts.token_counts(docs, c.path, budget=4, prefixes=True).collect()}
    import numpy as np
    for k, t in enumerate(SAMPLES):
        r, counts = rows[k], np.frombuffer(rows[k]["prefix_counts"], "<u4")
        assert r["n_bytes"] == len(t.encode()) and r["n_tokens"] == counts[-1]
        at = r["budget_bytes"]
        assert counts[at] <= 4 and (at == len(t.encode()) or "<|" in t or (counts[at + 1:] > 4).all())
    assert rows[99]["n_tokens"] == rows[99]["n_bytes"] == 0
