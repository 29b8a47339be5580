"""Operator 5: main text of web pages with a recurrent block labeller.

A page becomes the sequence of its text leaves (blocks).  Each leaf is described
by a hashed vector of its tag path (tags, classes, ids and roles of its open
elements), a hashed vector of its words, and a few figures.  A bidirectional LSTM
in numpy reads the sequence, so each label depends on the whole page.

The model is trained when the job starts, on at most ``TRAIN_PAGES`` pages chosen
by a hash of their id (the only sample here; every page is labelled).  Training
labels come from the pages' own markup: text of an article or main element
outside of marked furniture.  Furniture of many names is planted into the
training sequences, inside and outside the article, so that the model knows
more of it than the sample shows, and articles are given a div or section of
varied names.  Pages without an article or main element are not trained on,
unless all are.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import table

TRAIN_PAGES, TRAIN_BLOCKS = 192, 60     # pages, and blocks of a page in a training step
PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 48, 16, 7, 16
EPOCHS, BATCH, RATE, SEED = 12, 16, 0.01, 7
TOGETHER = 16_384                       # padded blocks that are labelled at once

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = set("script style noscript template svg math iframe object canvas select textarea title head".split())
IN_HEAD = set("title base basefont bgsound link meta style script noscript noframes template".split())
IN_SELECT = set("option optgroup hr script template".split())
RAW = ("script", "style", "textarea", "title")
FURNITURE = ("nav menu header footer aside sidebar ad ads advert advertisement banner promo sponsor cookie consent notice "
             "form login search comment comments reply related share social breadcrumb pagination widget popup modal "
             "newsletter subscribe legal copyright toolbar").split()
ARTICLE = {"article", "main"}
HOLDERS = ["", "content", "post", "entry", "story", "text", "body", "page content", "post body", "entry content", "wrapper"]
TEXT_TAGS = "h1 h2 h3 h4 p li div blockquote td pre figcaption section dd".split()
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
_PART = re.compile(r"[a-z0-9]+")
_END_OF_TAG = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_SPACE = re.compile(r"\s+")


def leaves(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters inside links) of each block of visible text, in page order.

    An element's path entry is its tag followed by the words of its class, id and
    role.  Inline elements do not end a block; a line break is white space.
    A head ends at the first text or element that may not stand in it, a select in
    the same way; other hidden elements without an end tag in the rest of the page
    hide nothing.
    """
    out, stack, text = [], [], []
    linked = hidden = links = 0
    pos, n, no_comment_end, lower, endless = 0, len(page), False, None, set()

    def flush():
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((tuple(w for _, w in stack if w), joined, linked))
        text.clear()
        linked = 0

    def close(k):
        nonlocal hidden, links
        for tag, _ in stack[k:]:
            hidden -= tag in HIDDEN_TAGS
            links -= tag == "a"
        del stack[k:]

    def leave(tag, allowed):
        """End a head or select that ``tag`` may not stand in."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == allowed[0] and tag not in allowed[1]:
                return close(k)
            if stack[k][0] in HIDDEN_TAGS and stack[k][0] != "noscript":
                return

    while pos < n:
        at = page.find("<", pos)
        at = n if at < 0 else at
        if at > pos and hidden and stack[-1][0] == "head" and page[pos:at].strip():
            leave("", ("head", IN_HEAD))
        if at > pos and not hidden:
            piece = htmllib.unescape(page[pos:at]) if "&" in page[pos:at] else page[pos:at]
            text.append(piece)
            linked += len(piece) if links else 0
        if at == n:
            break
        nxt = page[at + 1:at + 2]
        if page.startswith("<!--", at):
            end = -1 if no_comment_end else page.find("-->", at + 4)
            no_comment_end = end < 0
            pos = n if end < 0 else end + 3
            continue
        if nxt in "!?":
            end = page.find(">", at)
            pos = n if end < 0 or not nxt else end + 1
            continue
        name = _NAME.match(page, at + (2 if nxt == "/" else 1))
        if not name:
            if not hidden:
                text.append("<")
            pos = at + 1
            continue
        tag = name[0].lower()
        closed = _END_OF_TAG.match(page, name.end())
        end = closed.end() if closed else page.find(">", name.end()) + 1
        pos = end or n
        if hidden and nxt != "/":
            if tag == "body":
                k = next((k for k, (t, _) in enumerate(stack) if t == "head"), -1)
                if k >= 0:
                    close(k)
            else:
                leave(tag, ("head", IN_HEAD))
                leave(tag, ("select", IN_SELECT))
        if tag == "br" or tag in VOID:
            if not hidden:
                text.append(" ")
            continue
        if nxt == "/":
            open_at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if tag not in INLINE:
                flush()
            if open_at >= 0 and (tag not in INLINE or all(t in INLINE for t, _ in stack[open_at:])):
                close(open_at)
            continue
        if page[pos - 2:pos - 1] == "/":
            continue
        attributes = page[name.end():pos]
        words = [tag]
        for m in _ATTR.finditer(attributes) if "=" in attributes else ():
            words += _PART.findall((m[2] or m[3] or m[4] or "").lower())
        if tag not in INLINE:
            flush()
            while stack and (stack[-1][0] in INLINE or (stack[-1][0] == tag and tag in ("p", "li", "td", "tr", "option"))
                             or (stack[-1][0] == "p")):
                close(len(stack) - 1)
        if tag in HIDDEN_TAGS and lower is None:
            lower = page.lower()
        if tag in HIDDEN_TAGS and tag not in RAW and tag not in ("head", "select"):
            if tag in endless or lower.find("</" + tag, pos) < 0:
                endless.add(tag)
                continue
        if tag in RAW:
            end = lower.find("</" + tag, pos)
            pos = n if end < 0 else end
        stack.append((tag, " ".join(words)))
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
    flush()
    return out


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


_vectors: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashed counts of the words of the path; the innermost element counts again."""
    have = _vectors.get(path)
    if have is None:
        if len(_vectors) > 50_000:
            _vectors.clear()
        have = np.zeros(PATH_DIM + 3, np.float32)
        parts = [set(e.split(" ")) for e in path]
        marks = [bool(p.intersection(FURNITURE)) for p in parts]
        have[PATH_DIM:] = any(marks), any(bool(p & ARTICLE) for p in parts), sum(marks) / 4
        for w in [w for e in path for w in e.split(" ")] + ["in " + w for w in (path[-1] if path else "").split(" ")]:
            h = _hash(w)
            have[h % PATH_DIM] += 1 if h >> 16 & 1 else -1
        _vectors[path] = have
    return have


def features(blocks) -> np.ndarray:
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + FIGURES), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        out[i, :PATH_DIM + 3] = _path_vector(path)
        words = text.split(" ")
        at = np.fromiter((_hash(w) for w in words), np.uint32, len(words))
        out[i, PATH_DIM + 3:PATH_DIM + 3 + WORD_DIM] = np.bincount(at % WORD_DIM, minlength=WORD_DIM) / np.sqrt(len(words)) / 4
        out[i, -4:] = np.log1p(len(words)) / 4, min(1.0, linked / max(1, len(text))), text[-1] in ".!?", i / len(blocks)
    return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Bidirectional LSTM with a logistic output; sequences are padded and masked."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * hidden)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p["b" + d] = np.zeros(4 * hidden, np.float32)
            self.p["b" + d][hidden:2 * hidden] = 1          # forget gate open at first
        self.p["o"] = rng.normal(0, 0.1, 2 * hidden).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _pass(self, x, mask, d):
        """Hidden states (batch, time, hidden) of one direction, and what the backward pass needs."""
        n, t, _ = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        z = x @ self.p["W" + d] + self.p["b" + d]
        out, kept = np.zeros((n, t, self.h), np.float32), [None] * t
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            i, f, o, g = np.split(z[:, k] + h @ self.p["U" + d], 4, axis=1)
            i, f, o, g = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g)
            m = mask[:, k, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            kept[k] = (h, c, i, f, o, g, tc, m)
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, k] = h
        return out, kept

    def score(self, x, mask):
        hf, kf = self._pass(x, mask, "f")
        hb, kb = self._pass(x, mask, "b")
        both = np.concatenate([hf, hb], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["c"]), both, kf, kb

    def gradients(self, x, mask, y):
        s, both, kf, kb = self.score(x, mask)
        d = (s - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,nth->h", d, both), "c": np.array([d.sum()], np.float32)}
        up = d[:, :, None] * self.p["o"]
        for way, kept, dh_all in (("f", kf, up[:, :, :self.h]), ("b", kb, up[:, :, self.h:])):
            t = x.shape[1]
            dz = np.zeros((x.shape[0], t, 4 * self.h), np.float32)
            dh = dc = np.zeros((x.shape[0], self.h), np.float32)
            du = np.zeros_like(self.p["U" + way])
            for k in range(t - 1, -1, -1) if way == "f" else range(t):
                h, c, i, f, o, g, tc, m = kept[k]
                dh = dh + dh_all[:, k]
                a = m * dh
                dc2 = m * dc + a * o * (1 - tc * tc)
                dz[:, k] = np.concatenate(
                    [dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), a * tc * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
                du += h.T @ dz[:, k]
                dh = (1 - m) * dh + dz[:, k] @ self.p["U" + way].T
                dc = (1 - m) * dc + dc2 * f
            grad["U" + way], grad["b" + way] = du, dz.sum((0, 1))
            grad["W" + way] = np.einsum("ntx,ntz->xz", x, dz)
        return grad

    def fit(self, sequences, epochs=EPOCHS, batch=BATCH, rate=RATE, seed=SEED):
        """sequences: (features, labels); Adam with a fixed seed."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for lo in range(0, len(order), batch):
                x, mask, y = _padded([sequences[i] for i in order[lo:lo + batch]])
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Main-text flags of pages of any length; pages of like length share a step."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(len(order), TOGETHER // len(pages[order[-1]])))
            now, order = order[-n:], order[:-n]
            x, mask, _ = _padded([(pages[i], ()) for i in now])
            for i, s in zip(now, self.score(x, mask)[0]):
                out[i] = s[:len(pages[i])] > 0.5
        return out


def _padded(rows):
    t = max(len(x) for x, _ in rows)
    x = np.zeros((len(rows), t, rows[0][0].shape[1]), np.float32)
    mask, y = np.zeros((len(rows), t), np.float32), np.zeros((len(rows), t), np.float32)
    for i, (a, b) in enumerate(rows):
        x[i, :len(a)], y[i, :len(b)], mask[i, :len(a)] = a, b, 1
    return x, mask, y


def markup_label(path: tuple[str, ...]) -> bool:
    """Weak label: inside an article or main element, and in no furniture.  Pages without one have no labels."""
    inside = False
    for words in path:
        parts = words.split(" ")
        if inside and set(parts) & set(FURNITURE) and parts[0] != "header":
            return False
        inside = inside or parts[0] in ARTICLE
    return inside


def plain_label(path: tuple[str, ...]) -> bool:
    """Weak label where no page has an article or main element: in no furniture."""
    return not any(set(words.split(" ")) & set(FURNITURE) for words in path)


def _planted(blocks, rng):
    """``blocks`` with some furniture planted at random places; its words come from the page.

    The article element also gets other names.
    """
    name = ("article", "main", "article post", "main content", "article entry")[rng.integers(5)]
    out = [(tuple(name if w.split(" ")[0] in ARTICLE else w for w in p), t, k) for p, t, k in blocks]
    for i, (path, t, k) in enumerate(out):      # other text elements than the sample happens to use
        if len(path) > 1 and rng.random() < 0.3:
            out[i] = ((*path[:-1], TEXT_TAGS[rng.integers(len(TEXT_TAGS))]), t, k)
    for _ in range(rng.integers(0, 7)):
        k = int(rng.integers(0, len(out)))
        around, text, _ = out[k]
        word = FURNITURE[rng.integers(len(FURNITURE))]
        as_tag = word in ("nav", "footer", "aside", "form", "header", "menu") and rng.random() < 0.5
        holder = word if as_tag else f"{('div', 'section', 'ul', 'p')[rng.integers(4)]} {word}"
        if rng.random() < 0.3 and not as_tag:
            holder += " box"
        inside = next((j + 1 for j, w in enumerate(around) if w.split(" ")[0] in ARTICLE), len(around[:2]))
        base = around[:inside] if word != "header" else tuple(w for w in around[:inside] if w.split(" ")[0] not in ARTICLE)
        words = text.split(" ")
        inner = ((), ("p",), ("li",), ("div", "p"))[rng.integers(4)]
        for _ in range(rng.integers(1, 4)):
            lo = int(rng.integers(0, len(words)))
            part = " ".join(words[lo:lo + int(rng.integers(1, 25))])
            out.insert(k, ((*base, holder, *inner), part, len(part) if rng.random() < 0.3 else 0))
    return out


def _renamed(blocks, rng):
    """``blocks`` with a div or section of any name in place of the article element."""
    tag, word = ("div", "section")[rng.integers(2)], HOLDERS[rng.integers(len(HOLDERS))]
    name = f"{tag} {word or f'c{rng.integers(1000)}'}" if rng.random() < 0.8 else tag
    return [(tuple(name if w.split(" ")[0] in ARTICLE else w for w in p), t, k) for p, t, k in blocks]


def train(pages: list[str], seed: int = SEED) -> Labeller:
    """A labeller for the markup labels of ``pages``; if none has an article or main element, all but furniture counts as main text."""
    rng = np.random.default_rng(seed)
    rows = []
    every = list(filter(None, map(leaves, pages)))
    marked = [b for b in every if any(markup_label(p) for p, _, _ in b)]
    label = markup_label if marked else plain_label
    for blocks in marked or every:
        for turn in range(3):
            seq = _planted(blocks, rng) if turn else blocks
            y = np.array([label(p) for p, _, _ in seq], np.float32)
            x = features(_renamed(seq, rng) if turn == 2 else seq)
            for lo in range(0, len(seq), TRAIN_BLOCKS):
                rows.append((x[lo:lo + TRAIN_BLOCKS], y[lo:lo + TRAIN_BLOCKS]))
    model = Labeller(PATH_DIM + WORD_DIM + FIGURES, seed=seed)
    return model.fit(rows, seed=seed) if rows else model


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    blocks = [leaves(p) for p in pages]
    keep = model.label([features(b) for b in blocks])
    return [" ".join(t for (_, t, _), k in zip(b, f) if k) for b, f in zip(blocks, keep)]


def _extracted(params: dict):
    def run(batches):
        model = Labeller(PATH_DIM + WORD_DIM + FIGURES)
        model.p = params
        for batch in batches:
            pages = [x.as_py() or "" for x in batch.column("html")]
            texts = [t for lo in range(0, len(pages), 256) for t in main_texts(pages[lo:lo + 256], model)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    Null html is empty and gives an empty text; so does a page without main text.
    Repeated rows are each extracted; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    ids = [r[0] for r in rows.where("page_id is not null").select("page_id").distinct()
           .orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()]
    sample = rows.where(F.col("page_id").isin(ids)).select("page_id", "html").limit(2 * train_pages).collect() if ids else []
    chosen = {}
    for r in sorted(sample, key=lambda r: (r[0], r[1] or "")):
        chosen.setdefault(r[0], r[1] or "")
    model = train(list(chosen.values()))
    return rows.mapInArrow(_extracted(model.p), "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extract": op5_html_extract}
SQL: dict[str, str] = {}
