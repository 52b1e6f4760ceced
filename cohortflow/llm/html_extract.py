"""Main-text extraction with a recurrent block labeller.

A page becomes its sequence of leaf blocks (text between block-level tags),
each with its tag path. A bidirectional LSTM in NumPy reads one vector per
leaf (hashed tag path, hashed words, a few measurements) and labels every
block with the whole page as context; blocks labelled main are joined.

The network is trained on a bounded sample of the pages themselves:
``SAMPLE`` different pages, of a longer one its first and last
``SAMPLE_CHARS`` characters together, of these at most the first and last
``SAMPLE_BLOCKS`` blocks together. Labelling reads whole pages. The labels
come from what the markup states (article and main against navigation,
footers and the like). A page whose markup names no main part is labelled by
measure: the container with the most running text (long blocks with sentence
marks and few links) holds the main text, but for its link lists. Copies of
the sample pages in which side blocks are added, moved or renamed teach the
network to weigh the path, the words and the context. A page of more than
``STEP_BLOCKS`` blocks is labelled in chunks that hand the state on, so
memory for the network stays a few bytes a block.

Defined results: null and empty html give an empty text; markup cut off in
the middle is read as far as it goes; ids and urls may be null or repeated;
an empty table gives an empty result; pages of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, opened, packed, share, ship

SAMPLE, SAMPLE_CHARS, SAMPLE_BLOCKS = 160, 60_000, 80
PATH_DIM, WORD_DIM, SIZES, HIDDEN = 96, 32, 5, 24
STEP_BLOCKS = 4096  # blocks of short pages that are labelled together

# Fixed values of HTML: tags that do not break a block, have no content, are
# not text, and end an open element of the same kind.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span "
             "strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = "script|style|noscript|template|svg|iframe|object|textarea|select"
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# Fixed values for the training labels: tags and words in class or id that state a block's part.
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article articlebody content entry post story body main".split())
SIDE_TAGS = set("nav footer aside form button dialog head header menu fieldset legend label noscript figure".split())
SIDE_WORDS = set("ad ads advert advertisement banner breadcrumb comment comments cookie cookies consent disqus footer "
                 "header login menu modal nav navigation newsletter notice popup promo related reply share sidebar "
                 "signup social sponsored subscribe toolbar widget".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + HIDDEN_TAGS + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def names_in(attrs: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    if "=" not in attrs:
        return ()
    out = []
    for m in _NAMES.findall(attrs):
        out += [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(m)).lower()) if w]
    return tuple(out)


def leaves(html: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters inside links) of each leaf block in page order.

    A path holds (tag, class and id words) from the outermost element in.
    """
    out, stack, text, linked, link = [], [], [], 0, 0

    def flush():
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append((tuple(stack), words, min(linked, len(words))))
            text.clear()
            linked = 0

    def close(at):
        nonlocal link
        link -= sum(1 for t, _ in stack[at:] if t == "a")
        del stack[at:]

    pos = 0
    for m in _TOKEN.finditer(html):
        if m.start() > pos:
            text.append(piece := unescape(html[pos:m.start()]))
            linked += len(piece) if link else 0
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    close(at)
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == "p" or stack[at][0] in CLOSES.get(tag, ()):
                    close(at)
                    break
                if stack[at][0] not in INLINE:
                    break
        if not (m["attrs"] or "").rstrip().endswith("/") or tag in INLINE:
            stack.append((tag, names_in(m["attrs"] or "")))
            link += tag == "a"
    if pos < len(html):
        text.append(unescape(html[pos:]))
    flush()
    return out


def stated(path: tuple) -> int:
    """1 if the markup states that a block is main text, else 0 (the training label)."""
    inside = 0
    for tag, names in path:
        if tag in MAIN_TAGS or (tag in {"div", "section"} and MAIN_WORDS.intersection(names)):
            inside = 1
        if SIDE_WORDS.intersection(names) or (tag in SIDE_TAGS and not (inside and tag in {"header", "figure"})):
            return 0
    return inside


def _signed(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % dim, 1.0 if h >> 16 & 1 else -1.0


def running(text: str, linked: int) -> bool:
    """A block of running text: long, few links, and a sentence mark."""
    return len(text) >= 80 and 3 * linked < len(text) and any(c in ".!?\u3002\uff01\uff1f" for c in text)


def measured(page: list) -> list[int]:
    """Labels of a page whose markup names no main part, from lengths, links and sentence marks.

    Every container counts the running text of its blocks; from the body
    inwards the main container is the one that holds at least 0.7 of its
    parent's, as deep as that goes on.
    """
    weight = {}
    for path, text, linked in page:
        if running(text, linked) and not side(path):
            for k in range(1, len(path) + 1):
                weight[path[:k]] = weight.get(path[:k], 0) + len(text)
    best = ()
    while inner := [p for p in weight if len(p) == len(best) + 1 and p[:-1] == best and p[-1][0] != "p"]:
        top = max(inner, key=lambda p: (weight[p], -len(str(p))))
        if best and weight[top] < 0.7 * weight[best]:
            break
        best = top
    if not best:
        return [int(running(t, n) and not side(p)) for p, t, n in page]
    blocks = [k for k, b in enumerate(page) if b[0][:len(best)] == best and running(b[1], b[2])]
    # titles and short paragraphs between the first and the last running block belong to the text
    first, last = blocks[0], blocks[-1]
    return [int(p[:len(best)] == best and not side(p) and 2 * n < len(t) and first - 2 <= k <= last)
            for k, (p, t, n) in enumerate(page)]


def side(path: tuple) -> bool:
    """The markup states that a block is no main text."""
    return any(tag in SIDE_TAGS or SIDE_WORDS.intersection(names) for tag, names in path)


def labelled(page: list) -> list[tuple]:
    """(block, label) of a page, by its markup or, where that names no main part, by measure."""
    marks = [stated(b[0]) for b in page]
    return list(zip(page, marks if any(marks) else measured(page)))


class Labeller:
    """Bidirectional LSTM over leaf vectors."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = PATH_DIM + WORD_DIM + SIZES
        init = lambda a, b: rng.normal(0, (1 / a) ** 0.5, (a, b)).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN:2 * HIDDEN] = 1  # forget gates start open
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("w", init(n, 4 * HIDDEN)), ("u", init(HIDDEN, 4 * HIDDEN)),
                                                          ("c", bias.copy()))}
        self.p |= {"o": init(2 * HIDDEN, 1), "q": np.zeros(1, np.float32)}
        self._paths, self._words = {}, {}

    def __getstate__(self):
        return {"p": self.p, "_paths": {}, "_words": {}}

    def path_vector(self, path: tuple) -> np.ndarray:
        if (found := self._paths.get(path)) is None:
            if len(self._paths) > 20_000:
                self._paths.clear()
            v = np.zeros(PATH_DIM, np.float32)
            for k, (tag, names) in enumerate(path):
                above = path[k - 1][0] if k else ""
                for word in (tag, f"{above}>{tag}", *(f".{n}" for n in names)):
                    at, sign = _signed(word, PATH_DIM)
                    v[at] += sign
            found = self._paths[path] = v
        return found

    def vectors(self, blocks: list) -> np.ndarray:
        """One row per leaf: hashed tag path, hashed words of the whole block, measurements."""
        out, memo = np.zeros((len(blocks), PATH_DIM + WORD_DIM + SIZES), np.float32), self._words
        for row, (path, text, linked) in zip(out, blocks):
            row[:PATH_DIM] = self.path_vector(path)
            words = text.split(" ")
            codes = []
            for w in words:
                if (c := memo.get(w)) is None:
                    if len(memo) > 300_000:
                        memo.clear()
                    at, sign = _signed(w.lower(), WORD_DIM)
                    c = memo[w] = at if sign > 0 else at + WORD_DIM
                codes.append(c)
            n = np.bincount(codes, minlength=2 * WORD_DIM)
            v = n[:WORD_DIM] - n[WORD_DIM:]
            row[PATH_DIM:PATH_DIM + WORD_DIM] = v / (np.sqrt((v * v).sum()) + 1)
            row[PATH_DIM + WORD_DIM:] = (np.log1p(len(text)) / 6, np.log1p(len(words)) / 5, linked / len(text),
                                         text[-1] in ".!?\"'", len(path) / 10)
        return out

    def _run(self, x: np.ndarray, d: str, mask: np.ndarray) -> list:
        """Gates and states of one direction over [time, page, feature]; masked steps keep the state."""
        w, u, c = (self.p[k + d] for k in "wuc")
        drive = x @ w + c
        h = s = np.zeros((x.shape[1], HIDDEN), x.dtype)
        out = []
        for t in (range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)):
            z = drive[t] + h @ u
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            s2 = f * s + i * g
            h2 = o * np.tanh(s2)
            out.append((t, h, s, i, f, o, g, s2, m))
            h, s = m * h2 + (1 - m) * h, m * s2 + (1 - m) * s
            out[-1] += (h,)
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray):
        runs, both = {}, np.zeros((*x.shape[:2], 2 * HIDDEN), x.dtype)
        for k, d in enumerate("fb"):
            runs[d] = self._run(x, d, mask)
            for step in runs[d]:
                both[step[0], :, k * HIDDEN:(k + 1) * HIDDEN] = step[-1]
        return (both @ self.p["o"] + self.p["q"])[..., 0], both, runs

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        z, both, runs = self.logits(x, mask)
        err = ((1 / (1 + np.exp(-z)) - y) * mask / max(1.0, mask.sum()))[..., None]
        grads = {"o": np.tensordot(both, err, ((0, 1), (0, 1))), "q": err.sum(axis=(0, 1))}
        back = err @ self.p["o"].T
        for k, d in enumerate("fb"):
            u = self.p["u" + d]
            gw, gu, gc = np.zeros_like(self.p["w" + d]), np.zeros_like(u), np.zeros_like(self.p["c" + d])
            dh = ds = np.zeros((x.shape[1], HIDDEN), x.dtype)
            for t, h0, s0, i, f, o, g, s2, m, _ in reversed(runs[d]):
                dh = dh + back[t][:, k * HIDDEN:(k + 1) * HIDDEN]
                th = np.tanh(s2)
                do, dc = dh * m * th, ds * m + dh * m * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * s0 * f * (1 - f), do * o * (1 - o),
                                     dc * i * (1 - g * g)], axis=1)
                gw += x[t].T @ dz
                gu += h0.T @ dz
                gc += dz.sum(axis=0)
                dh, ds = dz @ u.T + dh * (1 - m), dc * f + ds * (1 - m)
            grads |= {"w" + d: gw, "u" + d: gu, "c" + d: gc}
        return grads

    @staticmethod
    def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = max(map(len, rows))
        x = np.zeros((n, len(rows), rows[0].shape[1]), np.float32)
        mask = np.zeros((n, len(rows)), np.float32)
        for k, r in enumerate(rows):
            x[:len(r), k], mask[:len(r), k] = r, 1
        return x, mask

    def fit(self, pages: list[list], epochs: int = 14, seed: int = 7) -> Labeller:
        """``pages`` holds lists of (leaf, label)."""
        rng = np.random.default_rng(seed)
        data = [(self.vectors([b for b, _ in page]), np.array([y for _, y in page], np.float32))
                for page in pages if page]
        m, v, step = {k: 0 * p for k, p in self.p.items()}, {k: 0 * p for k, p in self.p.items()}, 0
        for _ in range(epochs if data else 0):
            for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // 24)):
                x, mask = self.padded([data[k][0] for k in part])
                y = np.zeros_like(mask)
                for at, k in enumerate(part):
                    y[:len(data[k][1]), at] = data[k][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - 8e-3 * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Boolean per leaf of each page: main text or not. Pages of like length are read together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        for k, p in enumerate(pages):
            if len(p) > STEP_BLOCKS:
                out[k] = self._long(p)
        todo = sorted((k for k, p in enumerate(pages) if 0 < len(p) <= STEP_BLOCKS), key=lambda k: len(pages[k]))
        while todo:
            n = max(1, STEP_BLOCKS // len(pages[todo[-1]]))
            part, todo = todo[-n:], todo[:-n]
            x, mask = self.padded([self.vectors(pages[k]) for k in part])
            z = self.logits(x, mask)[0]
            for at, k in enumerate(part):
                out[k] = z[:len(pages[k]), at] > 0
        return out

    def _long(self, page: list) -> np.ndarray:
        """Labels of one long page: its two readings chunk by chunk, one number a block kept of each."""
        z = np.full(len(page), self.p["q"][0], np.float32)
        starts = range(0, len(page), STEP_BLOCKS)
        for k, d in enumerate("fb"):
            w, u, c = (self.p[x + d] for x in "wuc")
            o = self.p["o"][k * HIDDEN:(k + 1) * HIDDEN, 0]
            h = s = np.zeros(HIDDEN, np.float32)
            for at in (starts if d == "f" else reversed(starts)):
                drive = self.vectors(page[at:at + STEP_BLOCKS]) @ w + c
                for t in (range(len(drive)) if d == "f" else range(len(drive) - 1, -1, -1)):
                    g = drive[t] + h @ u
                    gates = 1 / (1 + np.exp(-g[:3 * HIDDEN]))
                    s = gates[HIDDEN:2 * HIDDEN] * s + gates[:HIDDEN] * np.tanh(g[3 * HIDDEN:])
                    h = gates[2 * HIDDEN:] * np.tanh(s)
                    z[at + t] += h @ o
        return z > 0

    def extract(self, htmls: list[str]) -> list[str]:
        pages = [leaves(h) for h in htmls]
        return ["\n\n".join(b[1] for b, ok in zip(page, keep) if ok) for page, keep in zip(pages, self.label(pages))]


def variants(page: list, rng: np.random.Generator) -> list[list]:
    """A labelled page and changed copies of it: side blocks added, main containers and side blocks renamed."""
    page = labelled(page)
    if len(page) > SAMPLE_BLOCKS:  # the end of a page holds comments and footers
        page = page[:SAMPLE_BLOCKS * 5 // 8] + page[-(SAMPLE_BLOCKS * 3 // 8):]
    main = [k for k, (_, y) in enumerate(page) if y]
    out = [page]
    if not main or not page[main[0]][0][0]:
        return out
    root = page[main[0]][0][0]
    top = next((k for k, (tag, names) in enumerate(root) if stated(root[:k + 1])), max(0, len(root) - 2))
    words = sorted(SIDE_WORDS)
    tags = sorted(SIDE_TAGS - {"head", "noscript", "figure", "label", "legend"})
    for _ in range(3):
        new = list(page)
        for _ in range(int(rng.integers(1, 5))):
            text = page[int(rng.integers(len(page)))][0][1]
            if rng.random() < 0.3:
                text = " ".join(text.split()[:int(rng.integers(1, 9))])
            inside = rng.random() < 0.5
            holder = ((tags[int(rng.integers(len(tags)))], ()) if rng.random() < 0.5 else
                      (("div", "section", "p", "ul")[int(rng.integers(4))], (words[int(rng.integers(len(words)))],)))
            leaf = ((), (("p", ()),), (("div", ()), ("p", ())), (("ul", ()), ("li", ())), (("h3", ()),))[int(rng.integers(5))]
            path = (*root[:top + 1 if inside else top], holder, *leaf)
            if holder[0] == "header" and inside:
                continue
            linked = len(text) if rng.random() < 0.3 else 0
            at = main[int(rng.integers(len(main)))] if inside else int(rng.choice([0, len(new)]))
            for k in range(int(rng.integers(1, 4))):
                new.insert(min(at + k, len(new)), ((path, text, linked), 0))
        if rng.random() < 0.4:  # another container for the main text
            other = (("main", ()), ("div", ("content",)), ("div", ("post", "content")), ("section", ("article",)),
                     ("div", ("entry", "content")))[int(rng.integers(5))]
            new = [((((*b[0][:top], other, *b[0][top + 1:]), b[1], b[2]) if b[0][:top + 1] == root[:top + 1] else b), y)
                   for b, y in new]
        if rng.random() < 0.5:  # other leaves: headings, lists, quotes, tables
            kinds = ("h2", "h3", "blockquote", "pre", "td", "li", "p", "div")
            new = [(((*b[0][:-1], (kinds[int(rng.integers(len(kinds)))], ())), b[1], b[2]) if y and len(b[0]) > top + 1
                    and rng.random() < 0.3 else b, y) for b, y in new]
        out.append(new)
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """Fits on at most ``sample`` pages, chosen by a hash of the html."""
    rows = packed(pages.select(id_col, html_col), id_col, html_col).filter(F.length("_1") > 0)
    rows = rows.select("_1", F.sha2("_1", 256).alias("_d"))
    # copies of a page count once; what reaches the driver is bounded by the number and by the cut
    picked = hash_sample(rows.select("_d").distinct(), sample, "_d")
    cut = F.when(F.length("_1") <= SAMPLE_CHARS, F.col("_1")).otherwise(
        F.concat(F.substring("_1", 1, SAMPLE_CHARS * 2 // 3), F.substring("_1", -(SAMPLE_CHARS // 3), SAMPLE_CHARS // 3)))
    rows = rows.join(F.broadcast(picked), "_d").select("_d", cut.alias("_1")).dropDuplicates(["_d"])
    htmls = [r["_1"] for r in sorted(rows.collect(), key=lambda r: r["_d"])]
    rng = np.random.default_rng(11)
    return Labeller().fit([v for h in htmls for v in variants(leaves(h), rng)])


def _extract(shared):
    def run(batches):
        model = opened(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                htmls = [h or "" for h in part.column(part.num_columns - 1).to_pylist()]
                kept = part.select(range(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(model.extract(htmls), pa.string())],
                                                 [*kept.schema.names, "_text"])
    return run


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """``_row`` (all columns but the html) and ``text``, the main text, of each page."""
    others = [c for c in pages.columns if c != html_col]
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(html_col).alias("_h"))
    shared = share(pages.sparkSession, model)
    schema = T.StructType([df.schema["_row"]]).add("_text", "string")
    return df.mapInArrow(_extract(shared), schema).select("_row", F.col("_text").alias("text"))


ship(__name__)
