"""Mixing, HTML extraction, the quality classifier and the licence scan."""

import math
import random

import numpy as np
import pytest

from cohortflow.llm import html_extract, license_scan, mixing, quality_model


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, closed = budget * sum(sizes.values()), {}
    while True:
        rest = total - sum(closed.values())
        open_ = [s for s in names if s not in closed]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**closed, **share}
        closed |= {s: float(cap * sizes[s]) for s in over}


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows, k = [], 0
    for s, n in ((None, 40), ("a", 300), ("b", 30), ("B", 60), ("é", 80), ("z", 5)):
        for _ in range(n):
            rows.append((k, s, " ".join("w" for _ in range(int(rng.lognormvariate(3, 1))))))
            k += 1
    rows += [(k, "a", None), (k + 1, "empty", ""), (None, "a", "x y"), (None, "a", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, whole_rows=True).select("_row.source", "_row.doc_id", "size", "source_size", "target", "copies",
                                                   "taken").collect()
    again = mixing.mix(docs.repartition(5), whole_rows=True).select("_row.source", "_row.doc_id", "size", "source_size",
                                                                    "target", "copies", "taken").collect()
    key = lambda r: (str(r[0]), str(r[1]), r[2:])
    assert sorted(map(tuple, out), key=key) == sorted(map(tuple, again), key=key) and len(out) == len(rows)
    sizes, taken, got = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        got[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    want = plain_targets(sizes)
    for s, t in want.items():
        assert got[s] == pytest.approx(t), s
        assert abs(taken[s] - t) <= max(2, 0.02 * t), (s, taken[s], t)


def test_dual_solution_is_a_root(spark):
    rng = random.Random(2)
    cells = [("a", n, rng.randint(1, 9)) for n in range(1, 60, 3)] + [("b", 5, 4), ("b", 400, 1)]
    size = {s: sum(n * c for t, n, c in cells if t == s) for s in "ab"}
    want = {"a": 1.4 * size["a"], "b": 0.3 * size["b"]}
    sources = spark.createDataFrame([(s, size[s], want[s]) for s in "ab"], "source string, source_size long, target double")
    got = {r["source"]: r for r in mixing.dual(spark.createDataFrame(cells, "source string, size long, n long"), sources, 2).collect()}
    for s in "ab":
        f = sum(c * n * min(2.0, math.exp(got[s]["lam"] * n / got[s]["scale"])) for t, n, c in cells if t == s)
        assert f == pytest.approx(want[s], rel=1e-5)


def test_mix_without_words_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0.0, 0)] * 2
    assert mixing.mix(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T %d</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu %d</a></li><li>More</li></ul></nav><!-- ad --><div class="ad">Buy %s now.</div>%s
<footer>&copy; site</footer></body></html>"""


def page(rng, k):
    words = lambda n: " ".join(rng.choice("river stone cloud walks under seven bright doors".split()) for _ in range(n))
    paras = [words(rng.randint(4, 40)).capitalize() + " &amp; more." for _ in range(rng.randint(2, 6))]
    side = rng.choice(["", '<aside class="sidebar">%s</aside>' % words(12), '<div class="cookie-notice"><p>%s</p></div>' % words(9)])
    after = rng.choice(["", '<section class="comments"><p>%s</p><p>%s</p></section>' % (words(8), words(20))])
    body = "<article><h1>Head %d</h1><p><b>%s<br></p>%s</article>" % (k, paras[0], "".join(f"<p>{p}\n </p>" for p in paras[1:]))
    want = "\n\n".join([f"Head {k}", *[p.replace("&amp;", "&") for p in paras]])
    return PAGE % (k, k, words(3), side + body + after), want


def test_extraction_finds_the_article(spark):
    rng = random.Random(3)
    pages = [page(rng, k) for k in range(150)]
    df = spark.createDataFrame([(k, f"u{k}", h) for k, (h, _) in enumerate(pages)] + [(900, None, None), (901, "x", "")],
                               "page_id long, url string, html string")
    model = html_extract.train(df, sample=60)
    got = {r["_row"]["page_id"]: r["text"] for r in html_extract.extract(df, model).collect()}
    right = sum(got[k] == want for k, (_, want) in enumerate(pages))
    assert right >= 0.97 * len(pages)
    assert got[900] == got[901] == ""
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_leaves_of_odd_markup():
    texts = lambda h: [t for _, t, _ in html_extract.leaves(h)]
    assert texts("<p>a <b>b</b>\n c<br>d<p>e &lt;f&gt; &#233; &nbsp;") == ["a b c d", "e <f> é"]
    assert texts("<ul><li>x<li>y</ul>z<!-- <p>no</p> -->w<script>if (a<b) {}</script>") == ["x", "y", "zw"]
    assert texts("<p title='a>b'>q</p><p cla") == ["q"] and texts("a < b and c") == ["a < b and c"]
    assert texts('<p>x<a href="u>y</a>') == ["xy"] and texts("") == []
    assert html_extract.leaves("<p><a href=u>ab</a>c</p>")[0][2] == 2


def test_lstm_gradients():
    model = html_extract.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    n = html_extract.PATH_DIM + html_extract.WORD_DIM + html_extract.SIZES
    x, mask = rng.normal(size=(4, 3, n)), np.ones((4, 3))
    mask[2:, 1] = 0
    y = rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        z = model.logits(x, mask)[0]
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())
    grads = model.gradients(x, mask, y)
    for key in ("wf", "uf", "cb", "ub", "o", "q"):
        at = tuple(rng.integers(0, s) for s in model.p[key].shape)
        old, eps = model.p[key][at], 1e-5
        model.p[key][at] = old + eps
        up = loss()
        model.p[key][at] = old - eps
        down = loss()
        model.p[key][at] = old
        assert grads[key][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-7), key


def test_quality_model_on_held_out_rows(spark):
    from cohortflow.llm.common import table
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_model.train(docs, labels)
    rows = (quality_model.scores(docs, model).join(labels, "doc_id").filter(quality_model.held_out("doc_id"))
            .select("score", "quality").collect())
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 40 and right >= 0.95 * len(rows)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "x " * 50_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality_model.scores(odd, model).collect())
    blank = quality_model.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.scores(odd, blank).collect()} == {0.5}


def test_quality_model_sample_with_a_repeated_id(spark, monkeypatch):
    """However often an id is repeated, at most ``sample`` rows reach the driver."""
    ids = [r["id"] for r in spark.range(60).filter(~quality_model.held_out("id")).limit(20).collect()]
    labels = spark.createDataFrame([(k, n % 2) for n, k in enumerate(ids)], "doc_id long, quality int")
    rows = [(k, f"text of {k}") for k in ids] + [(ids[0], f"other text {n % 200}") for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, plain = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(plain(self)) or sent[-1])
    quality_model.train(docs, labels, sample=30)
    assert [len(x) for x in sent] == [30]
    sent.clear()
    quality_model.train(docs.limit(20), labels, sample=30)
    assert sorted(r[0] for x in sent for r in x) == sorted(ids)


def dice(a, b):
    pairs = lambda t: set(zip(w := license_scan.normal_words(t), w[1:]))
    a, b = pairs(a), pairs(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_license_scan_matches_brute_force(spark):
    texts = [None, "", "x", "Released under the MIT License.", "some text\nLicensed under CC BY-NC 4.0.\nmore text here",
             "Licensed under the Apache License Version 2 0", "this work is licensed under the GNU General Public License "
             "version 3 now", "a b c d e f g h", license_scan.TEMPLATES[2][1].replace(" and to ", "\nand to "),
             "word " * 5000 + "\n\nAll rights reserved.", "Released under the MIT License."]
    df = spark.createDataFrame([(k % 9, t) for k, t in enumerate(texts)], "doc_id long, text string")
    import re
    want = []
    for k, t in enumerate(texts):
        units = set((t or "").split("\n")) | set(re.split(r"\n[\x20\x09-\x0D]*\n", t or ""))
        best = {}
        for u in units:
            for name, body in license_scan.TEMPLATES:
                if (d := dice(u, body)) >= 0.8:
                    best[name] = max(d, best.get(name, 0))
        want.append((k % 9, tuple(sorted(best)), round(max(best.values(), default=0.0), 9)))
    got = [(r["doc_id"], tuple(r["licences"]), round(r["dice"], 9)) for r in license_scan.scan(df).collect()]
    assert sorted(got) == sorted(want) and sum(1 for w in want if w[1]) >= 6
    assert license_scan.scan(df.limit(0)).count() == 0


def unnamed_page(rng, k, paragraphs=6):
    """A page whose class names mean nothing and which has no article or main."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    body = [" ".join(sentence(rng.randint(8, 15)) for _ in range(3)) for _ in range(paragraphs)]
    menu = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(8))
    foot = "".join(f'<a href="#">{word()} {word()}</a> ' for _ in range(4))
    title = " ".join(word() for _ in range(4))
    html = (f'<html><head><title>{title}</title></head><body><div class="x1"><ul>{menu}</ul></div><div class="x2">'
            f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in body) + f'</div><div class="x3">{foot}</div></body></html>')
    return html, body, menu


def test_pages_without_named_parts_give_their_article(spark):
    rng = random.Random(21)
    made = [unnamed_page(rng, k) for k in range(60)]
    pages = spark.createDataFrame([(k, f"u{k}", m[0]) for k, m in enumerate(made)], "page_id long, url string, html string")
    out = {r["_row"]["page_id"]: r["text"] for r in html_extract.extract(pages, html_extract.train(pages)).collect()}
    found = sum(p in out[k] for k, m in enumerate(made) for p in m[1])
    assert found >= 0.95 * sum(len(m[1]) for m in made)
    link = lambda m: [x.split(">")[-1] for x in m[2].split("</a>")[:-1]]
    assert sum(w in out[k].split("\n\n") for k, m in enumerate(made) for w in link(m)) <= 0.05 * 60 * 8


def test_a_table_of_long_pages_only(spark):
    rng = random.Random(22)
    made = [unnamed_page(rng, k, 500) for k in range(8)]
    assert min(len(m[0]) for m in made) > html_extract.SAMPLE_CHARS
    pages = spark.createDataFrame([(k, "", m[0]) for k, m in enumerate(made)] * 2, "page_id long, url string, html string")
    out = {r["_row"]["page_id"]: r["text"] for r in html_extract.extract(pages, html_extract.train(pages)).collect()}
    assert sum(p in out[k] for k, m in enumerate(made) for p in m[1]) >= 0.9 * sum(len(m[1]) for m in made)


def test_long_pages_are_labelled_alike(monkeypatch):
    """A page read in chunks has the labels of one read at once."""
    rng = random.Random(23)
    model = html_extract.Labeller().fit([html_extract.labelled(html_extract.leaves(unnamed_page(rng, k)[0])) for k in range(20)])
    page = html_extract.leaves("".join(unnamed_page(rng, k)[0] for k in range(9)))
    whole = model.label([page])[0]
    assert whole.any() and not whole.all()
    monkeypatch.setattr(html_extract, "STEP_BLOCKS", 17)
    assert (model.label([page])[0] == whole).all()


def test_stated_labels_go_before_measured_ones():
    html = "<body><nav><a>one</a></nav><article><p>Short.</p></article><div><p>" + "Long running text, here. " * 20 + "</p></div></body>"
    assert [y for _, y in html_extract.labelled(html_extract.leaves(html))] == [0, 1, 0]
    assert html_extract.labelled(html_extract.leaves("<p>x</p>"))[0][1] == 0


def test_quality_sample_of_repeated_labels_and_documents(spark):
    """A third of the labels and documents on one id: nothing multiplies, and the sample holds distinct ids."""
    rng = random.Random(24)
    good = lambda: " ".join(rng.choice(["plain", "words", "that", "read", "well"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["BUY", "!!!", "now", "$$$"]) for _ in range(30))
    docs = [(k, good() if k % 2 else bad()) for k in range(400)] + [(3, good())] * 200 + [(3, "other text")] * 3
    labels = [(k, k % 2) for k in range(400)] + [(3, 1)] * 3000 + [(None, 1), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = []
    fit = quality_model.Model.fit
    try:
        quality_model.Model.fit = lambda self, texts, y, **kw: rows.append((texts, y)) or fit(self, texts, y, **kw)
        model = quality_model.train(d, spark.createDataFrame(labels, "doc_id long, quality int"), sample=100)
    finally:
        quality_model.Model.fit = fit
    texts, y = rows[0]
    assert 80 <= len(texts) <= 100 and len(set(texts)) >= 80 and 20 < y.sum() < 80
    out = quality_model.scores(d, model).collect()
    assert len(out) == len(docs)
    mean = lambda v: sum(v) / len(v)
    assert mean([r["score"] for r in out if r["doc_id"] % 2]) > 0.8 > 0.2 > mean([r["score"] for r in out if r["doc_id"] % 2 == 0])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.scores(d, quality_model.train(d, empty)).collect()} == {0.5}
    assert quality_model.scores(d.limit(0), quality_model.train(d.limit(0), empty)).count() == 0
