"""HTML main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags. Each block is read as a vector of
its tag path (hashed tag names, class and id words of all its ancestors), hashed words and a few sizes; a bidirectional
LSTM in numpy reads the whole sequence both ways and gives each block the probability that it is main text. Inference
runs pages of like lengths together.

The labeller is trained here, by back-propagation through time, on PAGES generated layouts (a fixed seed) that hold an
article among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, under several mark-ups.
That sample's size is its bound; no page of the table is needed for it. A process trains once; the weights, of fixed
size, are sent to the executors.

Defined cases: null and empty pages, and pages without main text, give an empty text; scripts, styles, comments and
unclosed or stray tags are tolerated (see RAW and SKIPPED), and mark-up is read in one pass, however malformed or long;
a block is read to its last word; elements more than DEPTH deep keep their text but not their own place in the path; a
probability of exactly one half is main text; <br> is white space inside its block; rows repeated stay repeated; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, SIZES, HIDDEN = 96, 16, 4, 16
INPUT = PATH_DIM + WORD_DIM + SIZES
PAGES, EPOCHS, BATCH_BLOCKS, SEED = 600, 14, 20_000, 11

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Those of the first kind hold no mark-up either, so an unclosed one takes
#: the rest of the page; of the second kind, a self-closing or unclosed tag takes nothing but itself.
RAW, SKIPPED = frozenset(("script", "style")), frozenset(("noscript", "template", "iframe", "svg", "button", "select", "textarea", "datalist"))
#: A tag that is opened inside one of these closes it first, back to the nearest of the second kind.
CLOSES = {"p": (BLOCKS - {"body", "html"}, frozenset()), "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "tr": (frozenset(["tr"]), frozenset(["table"]))}
DEPTH = 100  # elements nested deeper stand beside one another in paths; their text is read all the same

OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?]|/)")
STOP = re.compile("[>=]")
VALUE = re.compile(r"\s*(?:([\"'])|[^\s>]*)")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


def _tag_end(text: str, at: int) -> int:
    """Past the > that ends a tag whose name ends at at. Quotes count only right after =, as in HTML; a quoted value
    that never ends is taken to end at the next >, and a tag that never ends takes the rest."""
    while m := STOP.search(text, at):
        if m[0] == ">":
            return m.end()
        v = VALUE.match(text, m.end())
        at = v.end()
        if v[1]:
            close = text.find(v[1], at)
            if close < 0:
                close = text.find(">", at)
                return close + 1 if close >= 0 else len(text)
            at = close + 1
    return len(text)


def tags(text: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name, whether it closes, and attributes of each tag; comments and the like have no name. One pass."""
    at = 0
    while m := OPENING.search(text, at):
        if m[2]:
            at = _tag_end(text, m.end())
            yield m.start(), at, m[2].lower(), bool(m[1]), text[m.end() : at]
        else:
            end, skip = ("-->", 3) if text.startswith("<!--", m.start()) else (">", 1)
            found = text.find(end, m.start() + 2)
            at = found + skip if found >= 0 else len(text)
            yield m.start(), at, "", False, ""


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str]]:
    """Path and text of each leaf block. A path names a tag, and after it its class, id and role words, outermost first."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    deeper: Counter[str] = Counter()
    held: list[str] = []
    endless: set[str] = set()
    path: tuple[str, ...] | None = ()
    at, text = 0, page or ""

    def flush() -> None:
        nonlocal path
        if held:
            line = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if line:
                if path is None:
                    path = tuple(name for _, names in stack for name in names)
                out.append((path, line))
            held.clear()

    def close(name: str) -> None:
        nonlocal path
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                path = None
                return

    def past(name: str, begin: int) -> int | None:
        """Past the end tag of name, None if there is none."""
        end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, begin)
        if not end:
            endless.add(name)
            return None
        return _tag_end(text, end.end())

    for begin, end, name, closing, attributes in tags(text):
        if begin < at:  # inside an element that is left out
            continue
        if begin > at:
            held.append(text[at:begin])
        at = end
        if name == "br":
            held.append(" ")
        elif closing:
            if name in BLOCKS:
                flush()
                if deeper[name]:
                    deeper[name] -= 1
                else:
                    close(name)
        elif name in RAW:
            at = past(name, at) or len(text)
        elif name in SKIPPED:
            at = at if attributes.endswith("/>") else past(name, at) or at
        elif name in BLOCKS:
            flush()
            if stack and (stack[-1][0] == "p" or name in CLOSES):
                if any(t == "p" for t, _ in stack):
                    close("p")
                inner, until = CLOSES.get(name, (frozenset(), frozenset()))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in until:
                        break
                    if stack[i][0] == name and name in inner:
                        del stack[i:]
                        path = None
                        break
            if name not in VOID:
                if len(stack) < DEPTH:
                    words = [w.lower() for v in NAMED.findall(attributes) for w in re.split(r"[^A-Za-z0-9]+", "".join(v)) if w]
                    stack.append((name, (name, *("." + w for w in words))))
                    path = None
                else:
                    deeper[name] += 1
    held.append(text[at:])
    flush()
    return out


@lru_cache(1 << 16)
def _hashed(word: str, dim: int) -> tuple[int, int, float]:
    """Two places and a sign."""
    h = zlib.crc32(word.encode())
    return h % dim, (h >> 11) % dim, 1.0 if h >> 31 else -1.0


@lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for name in set(path):
        a, b, s = _hashed(name, PATH_DIM)
        v[a] += s
        v[b] -= s
    return v


def vectors(page: list[tuple[tuple[str, ...], str]]) -> np.ndarray:
    out = np.zeros((len(page), INPUT), np.float32)
    for i, (path, text) in enumerate(page):
        out[i, :PATH_DIM] = _path_vector(path)
        words = Counter(text.lower().split(" "))
        share = 1 / words.total()
        v = [0.0] * WORD_DIM
        for w, n in words.items():
            a, _, s = _hashed(w, WORD_DIM)
            v[a] += s * n
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.array(v) * share
        out[i, -SIZES:] = np.log1p(len(text)) / 5, len(path) / 10, i / len(page), text[-1] in ".!?…"
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for way in "fb":
        w[f"x{way}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
        w[f"h{way}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"b{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    w["o"], w["c"] = rng.normal(0, HIDDEN**-0.5, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: dict[str, np.ndarray], way: str, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """One direction over (time, page, input); where the mask is 0 the state stays. keep: also what training needs of each step."""
    steps, n = x.shape[:2]
    pre = x @ w[f"x{way}"] + w[f"b{way}"]
    h = c = np.zeros((n, HIDDEN), np.float32)
    out, kept = np.zeros((steps, n, HIDDEN), np.float32), [None] * (steps if keep else 0)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = pre[t] + h @ w[f"h{way}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        new_h = o * np.tanh(new_c)
        if keep:
            kept[t] = (h, c, i, f, o, g, new_c)
        c, h = m * new_c + (1 - m) * c, m * new_h + (1 - m) * h
        out[t] = h
    return out, kept


def probabilities(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    both = np.concatenate([_run(w, "f", x, mask)[0], _run(w, "b", x, mask)[0]], axis=2)
    return _sigmoid(both @ w["o"] + w["c"])


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    (hf, kf), (hb, kb) = _run(w, "f", x, mask, True), _run(w, "b", x, mask, True)
    both = np.concatenate([hf, hb], axis=2)
    d = (_sigmoid(both @ w["o"] + w["c"]) - y) * mask / max(mask.sum(), 1)
    g = {"o": np.einsum("tn,tnh->h", d, both), "c": d.sum(keepdims=True).reshape(1)}
    for way, kept, cut in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, None))):
        steps, n = x.shape[:2]
        dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((n, HIDDEN), np.float32)
        gh = np.zeros_like(w[f"h{way}"])
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            h, c, i, f, o, q, new_c = kept[t]
            m = mask[t][:, None]
            dh = dh + d[t][:, None] * w["o"][cut]
            tc = np.tanh(new_c)
            into_c = m * (dc + dh * o * (1 - tc * tc))
            dz[t] = np.concatenate([into_c * q * i * (1 - i), into_c * c * f * (1 - f), m * dh * tc * o * (1 - o), into_c * i * (1 - q * q)], axis=1)
            gh += h.T @ dz[t]
            dh = (1 - m) * dh + dz[t] @ w[f"h{way}"].T
            dc = (1 - m) * dc + into_c * f
        g[f"h{way}"], g[f"b{way}"] = gh, dz.sum(axis=(0, 1))
        g[f"x{way}"] = np.einsum("tni,tnz->iz", x, dz)
    return g


def _batched(pages: list[np.ndarray], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(pages[i]) for i in order)
    x, mask = np.zeros((steps, len(order), INPUT), np.float32), np.zeros((steps, len(order)), np.float32)
    for j, i in enumerate(order):
        x[: len(pages[i]), j], mask[: len(pages[i]), j] = pages[i], 1
    return x, mask


SYLLABLES = "an ar be da el en er go ha il in ka lo ma ne on or pa qu ré ro sa se so ti tz un ve vi zu".split()
LEFT = {
    "menu": ['<nav>{}</nav>', '<ul class="menu">{}</ul>', '<div id="nav"><ul>{}</ul></div>', '<div class="breadcrumb">{}</div>', '<div role="navigation">{}</div>'],
    "header": ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div class="site-header"><p>{}</p></div>'],
    "footer": ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>', '<div class="copyright">{}</div>'],
    "side": ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="related"><ul><li>{}</li></ul></div>', '<div class="share social">{}</div>', '<section class="widget">{}</section>'],
    "notice": ['<div class="cookie-notice">{}</div>', '<div class="banner">{}</div>', '<div id="consent"><p>{}</p></div>', '<div class="newsletter popup">{}</div>', '<div class="alert notice">{}</div>'],
    "advert": ['<div class="ad">{}</div>', '<div class="ads sponsored">{}</div>', '<div class="advert"><p>{}</p></div>', '<div class="promo">{}</div>'],
    "form": ['<form><label>{}</label><input name="q"></form>', '<form class="search"><p>{}</p><button>ok</button></form>', '<form id="signup"><fieldset>{}</fieldset></form>'],
    "comments": ['<div class="comments"><p>{}</p></div>', '<section id="comments"><article class="comment"><p>{}</p></article></section>', '<ol class="comment-list"><li>{}</li></ol>', '<div id="disqus" class="comment"><p>{}</p></div>'],
}
MAIN = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content"><div class="post">{}</div></div>', '<div class="article-body">{}</div>', '<div class="entry-content">{}</div>', '<article class="post"><div class="text">{}</div></article>', '<section class="story">{}</section>']
#: Words that some blocks of a kind begin or end with.
SAID = {
    "menu": "home about contact archive login help topics news sections sitemap".split(),
    "header": "welcome daily journal blog official site tagline".split(),
    "footer": "copyright © rights reserved privacy terms imprint powered by".split(),
    "side": "related popular recent share follow tags trending archives also".split(),
    "notice": "cookies accept consent we use subscribe newsletter close settings".split(),
    "advert": "sponsored advertisement buy now offer sale deal discount free".split(),
    "form": "search email name password submit sign up send your".split(),
    "comments": "reply posted says comment comments agree thanks ago".split(),
}
MARK = "\N{SQUARE FOUR CORNERS}"


def layout(rng: np.random.Generator) -> str:
    """A page; blocks of main text begin with MARK."""
    word = lambda: "".join(rng.choice(SYLLABLES, rng.integers(1, 5))) + ("", "", "", ",", "$$$", "!!")[rng.integers(6)]
    words = lambda lo, hi: " ".join(word() for _ in range(int(np.exp(rng.uniform(np.log(lo), np.log(hi)))))).capitalize()
    links = lambda: "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.integers(1, 8)))

    def other(kind: str) -> str:
        form = LEFT[kind][rng.integers(len(LEFT[kind]))]
        inner = links() if kind == "menu" else words(1, 30) + (". " + words(1, 20) + "." if rng.random() < 0.6 else "")
        if rng.random() < 0.5:
            own = " ".join(rng.choice(SAID[kind], rng.integers(1, 5)))
            inner = f'<li><a href="/x">{own}</a></li>{inner}' if kind == "menu" else rng.choice([f"{own} {inner}", f"{inner} {own}", own])
        return form.format(f"<ul>{inner}</ul>" if kind == "menu" and "<ul" not in form and rng.random() < 0.9 else inner)

    def body() -> str:
        parts = [f"<h{rng.integers(1, 3)}>{MARK}{words(1, 12)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(int(np.exp(rng.uniform(0, 3.3)))):
            form = ["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br><p>" + MARK + words(1, 60) + "</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>" + MARK + words(1, 9) + "</li></ul>", "<pre>{}</pre>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"][min(int(rng.exponential(2.5)), 10)]
            parts.append(form.format(MARK + words(1, 90) + (".", "")[rng.random() < 0.2]))
            if rng.random() < 0.05:
                parts.append(other(str(rng.choice(["advert", "side", "form"]))))
        return "".join(parts)

    some = lambda p, kind: other(kind) if rng.random() < p else ""
    main = MAIN[0 if rng.random() < 0.4 else rng.integers(len(MAIN))].format(body())
    top = "".join([some(0.4, "header"), some(0.9, "menu"), some(0.3, "notice"), some(0.5, "advert"), some(0.2, "form")])
    tail = "".join([some(0.3, "side"), some(0.3, "comments"), some(0.2, "advert"), some(0.9, "footer"), some(0.2, "notice")])
    if rng.random() < 0.2:
        top, tail = top + some(0.9, "side"), tail
    close = "</body></html>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title></head><body>{top}{main}{tail}{close}"


@lru_cache(2)
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam over generated layouts; the same weights each time."""
    rng = np.random.default_rng(seed)
    made = [blocks(layout(rng)) for _ in range(pages)]
    labels = [np.array([t.startswith(MARK) for _, t in page], np.float32) for page in made]
    xs = [vectors([(path, t.removeprefix(MARK) or " ") for path, t in page]) for page in made]
    w = start_weights(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for i in range(0, pages, 30):
            order = rng.permutation(pages)[:30].tolist()
            x, mask = _batched(xs, order)
            y = np.zeros_like(mask)
            for j, k in enumerate(order):
                y[: len(labels[k]), j] = labels[k]
            step += 1
            for k, g in _gradients(w, x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def label(w: dict[str, np.ndarray], pages: list[list[tuple[tuple[str, ...], str]]]) -> list[np.ndarray]:
    """Whether each block is main text."""
    xs = [vectors(p) for p in pages]
    out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
    order, at = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i])), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(xs[order[to]]) <= BATCH_BLOCKS:
            to += 1
        x, mask = _batched(xs, order[at:to])
        p = probabilities(w, x, mask)
        for j, i in enumerate(order[at:to]):
            out[i] = p[: len(xs[i]), j] >= 0.5
        at = to
    return out


def extract(w: dict[str, np.ndarray], pages: list[str | None]) -> list[str]:
    cut = [unwrapped(blocks(p)) for p in pages]
    return ["\n".join(t for (path, t), keep in zip(page, kept, strict=True) if keep and "form" not in path) for page, kept in zip(cut, label(w, cut), strict=True)]


def unwrapped(page: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
    """A page's blocks; a form around more than half of its text is the page's own wrapper and goes from the paths, all
    others are left out of the main text wherever they stand."""
    inside = sum(len(t) for path, t in page if "form" in path)
    if 2 * inside <= sum(len(t) for _, t in page):
        return page
    return [(tuple(name for name in path if name != "form"), t) for path, t in page]


def html_extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    weights = pages.sparkSession.sparkContext.broadcast(train())

    @F.pandas_udf("string")
    def main_text(column: pd.Series) -> pd.Series:
        texts: list[str] = []
        held: list[str | None] = []
        for i, page in enumerate(column.tolist()):
            held.append(page)
            if len(held) == 500 or i == len(column) - 1:
                texts += extract(weights.value, held)
                held = []
        return pd.Series(texts, dtype=object)

    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_text(F.col(html)).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


