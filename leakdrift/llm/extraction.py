"""Main text of web pages: a recurrent labeller reads each page's blocks in order and classifies every one."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import small_batches, table

#: Pages that the labeller is fitted on at most, those of the smallest hashes of their ids.
SAMPLE = 240
PATH_DIM, WORD_DIM, MORE_DIM, HIDDEN = 128, 24, 6, 24

#: Elements whose contents are no text of the page, besides scripts and styles. Those of a head have nothing else.
DROPPED = frozenset("noscript template svg title textarea select iframe canvas".split())
MORE = r"((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
TOKEN = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b(?:(?:[^>]*[\s\"'])?/>(?!(?:(?!<\1\b).)*?</\1\s*>)|[^>]*>.*?(?:</\1\s*>|\Z))|<[!?][^>]*>"
    rf"|<(/?)([a-z][^\s/>]*){MORE}|<(/?)([a-z][^\s/>]*)([^>]*)>"
)
ENDS = re.compile(rf"(?is)<(/?)({'|'.join(sorted(DROPPED))})(?=[\s/>])(?:{MORE}|([^>]*)>)")
NAME = re.compile(r"""(?is)\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img br object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts mstyle mpadded mphantom menclose semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Words in tags, classes and ids that mark main text or boilerplate; only the training labels use them.
MAIN = frozenset("<article> <main> article main content post entry story body text".split())
BOILERPLATE = frozenset(
    "<nav> <header> <footer> <aside> <form> <button> <menu> <dialog> nav menu navbar header masthead footer sidebar "
    "aside ad ads advert advertisement banner promo sponsored sponsor cookie consent notice alert popup modal newsletter "
    "subscribe signup login search form navigation contentinfo complementary comment comments reply replies disqus discussion related recommended share social "
    "breadcrumb breadcrumbs pagination pager widget copyright".split()
)


def element_ends(page: str, limit: int) -> dict[int, int]:
    """Where dropped elements begin, and where each ends: an end tag closes the last open element of its name.

    Elements that are never closed aren't here, nor <svg/>; elsewhere HTML takes a slash at a tag's end for nothing.
    """
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in DROPPED}
    for m in ENDS.finditer(page, 0, limit):
        name = m[2].lower()
        if not m[1]:
            if not (name == "svg" and re.search(r"(?:^|[\s\"'])/\s*$", m[3] or m[4] or "")):
                opened[name].append(m.start())
        elif opened[name]:
            ends[opened[name].pop()] = m.end()
    return ends


class Step:
    """An element in a tag path: what marks it, and the element around it. Equal paths are one object within a trie."""

    __slots__ = ("above", "inside", "main", "junk", "heading", "names", "vector")

    def __init__(self, above: Step | None, names: tuple[str, ...]) -> None:
        self.above, self.names, self.inside = above, names, {}
        self.vector: np.ndarray | None = None
        self.main = any(x in MAIN for x in names) or (above is not None and above.main)
        self.junk = any(x in BOILERPLATE for x in names) or (above is not None and above.junk)
        self.heading = any(x[1:-1] in HEADINGS for x in names[:1]) or (above is not None and above.heading)

    def into(self, names: tuple[str, ...]) -> Step:
        step = self.inside.get(names)
        if step is None:
            step = self.inside[names] = Step(self, names)
            TRIE[1] += 1
        return step


#: The root of all paths that a process knows, and how many there are; it is left for a new one between pages.
TRIE: list = [None, 0]
KNOWN_PATHS = 50_000


def root_step() -> Step:
    if TRIE[0] is None or TRIE[1] > KNOWN_PATHS:
        TRIE[:] = [Step(None, ()), 0]
    return TRIE[0]


Block = tuple[str, Step, float]


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: text (references decoded, one space for white space), tag path, share of linked text."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, Step]] = []
    opened: dict[str, int] = {}
    top = root_step()
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, stack[-1][1] if stack else top, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            linked += len(text) if in_link else 0

    def leave() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    at = 0
    # Behind the last > there is no tag, and nothing is searched for one.
    limit = page.rfind(">") + 1
    ends: dict[int, int] | None = None
    while m := TOKEN.search(page, at, limit):
        say(page[at : m.start()])
        at = m.end()
        close, name, more = m[2], m[3], m[4]
        if m[6]:
            close, name, more = m[5], m[6], m[7]
        if not name:
            if m[1]:
                parts.append(" ")
            if at == limit and (m[1] and not re.search(rf"(?i)</{m[1]}\s*>\Z", m[0]) and not m[0].endswith("/>") or m[0].startswith("<!--") and not m[0].endswith("-->")):
                # A comment or script that isn't closed reaches to the page's end.
                at = len(page)
            continue
        name = name.lower()
        if name in DROPPED:
            # An element without an end loses its tag only.
            parts.append(" ")
            if not close:
                ends = element_ends(page, limit) if ends is None else ends
                at = ends.get(m.start(), at)
            continue
        if name == "a":
            in_link = 0 if close else 1
        if name == "br":
            parts.append(" ")
        if name in INLINE:
            continue
        flush()
        in_link = 0
        if name == "head":
            continue
        if close:
            if opened.get(name):
                while leave() != name:
                    pass
            continue
        while stack and stack[-1][0] in CLOSES.get(name, ()):
            leave()
        if name in VOID or (more and more.rstrip().endswith("/")):
            continue
        names = (f"<{name}>", *[w for v in NAME.findall(more or "") for w in re.findall(r"[a-z]+", v.lower())])
        stack.append((name, (stack[-1][1] if stack else top).into(names)))
        opened[name] = opened.get(name, 0) + 1
    rest = page[at:]
    say(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out


def hashed(text: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(text.encode("utf-8", "replace"))
    return h % dim, 1.0 if h & (1 << 20) else -1.0


class Encoder:
    """Blocks to input vectors: hashed tag path, mean of hashed words, and lengths, links, place and heading."""

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, float]] = {}

    def path(self, step: Step) -> np.ndarray:
        """Sum of the hashed marks of a path's elements, made from the path above and kept there."""
        new = []
        while step is not None and step.vector is None:
            new.append(step)
            step = step.above
        v = step.vector if step is not None else np.zeros(PATH_DIM, dtype=np.int32)
        for step in reversed(new):
            v = v.copy()
            for x in step.names:
                k, sign = hashed(x, PATH_DIM)
                v[k] += int(sign)
            step.vector = v
        return np.clip(v, -2, 2)

    def __call__(self, page: list[Block]) -> np.ndarray:
        x = np.zeros((len(page), PATH_DIM + WORD_DIM + MORE_DIM))
        for i, (text, path, linked) in enumerate(page):
            ws = text.split(" ")
            x[i, :PATH_DIM] = self.path(path)
            got = []
            for w in ws:
                k = self.words.get(w)
                if k is None:
                    if len(self.words) > 200_000:
                        self.words.clear()
                    k = self.words[w] = hashed(w.lower(), WORD_DIM)
                got.append(k)
            at, sign = zip(*got, strict=True)
            x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(at, sign, WORD_DIM) / len(ws)
            x[i, PATH_DIM + WORD_DIM :] = (
                np.log1p(len(ws)) / 5, np.log1p(len(text)) / 7, linked, i / len(page), text[-1] in ".?!", path.heading,
            )
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction; x is time, batch, input. Padded steps carry the state on."""
    steps, batch, _ = x.shape
    n = u.shape[0]
    z_in = x @ w + b
    h = np.zeros((batch, n))
    c = np.zeros((batch, n))
    out = np.zeros((steps, batch, n))
    for t in range(steps):
        z = z_in[t] + h @ u
        s = sigmoid(z[:, : 3 * n])
        g = np.tanh(z[:, 3 * n :])
        m = mask[t][:, None]
        c_new = s[:, n : 2 * n] * c + s[:, :n] * g
        tc = np.tanh(c_new)
        h_new = s[:, 2 * n :] * tc
        if keep is not None:
            keep.append((h, c, s, g, tc, m))
        c = m * c_new + (1 - m) * c
        h = m * h_new + (1 - m) * h
        out[t] = h
    return out


def lstm_back(x: np.ndarray, u: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of w, u and b from those of the hidden states."""
    steps, batch, n = d_out.shape
    dz_all = np.zeros((steps, batch, 4 * n))
    du = np.zeros_like(u)
    dh = np.zeros((batch, n))
    dc = np.zeros((batch, n))
    for t in range(steps - 1, -1, -1):
        h, c, s, g, tc, m = keep[t]
        dh = dh + d_out[t]
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        dh_new = m * dh
        dc_new = m * dc + dh_new * o * (1 - tc * tc)
        dz = np.hstack([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tc * o * (1 - o), dc_new * i * (1 - g * g)])
        dz_all[t] = dz
        du += h.T @ dz
        dh = (1 - m) * dh + dz @ u.T
        dc = (1 - m) * dc + dc_new * f
    dw = np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
    return dw, du, dz_all.sum((0, 1))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]))
    mask = np.zeros((steps, len(pages)))
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


def run(model: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(both directions' states, probability of main text) of every block."""
    ahead = lstm(x, mask, model["wf"], model["uf"], model["bf"], keep and keep[0])
    back = lstm(x[::-1], mask[::-1], model["wb"], model["ub"], model["bb"], keep[1] if keep else None)[::-1]
    state = np.concatenate([ahead, back], axis=2)
    return state, sigmoid(state @ model["v"] + model["a"])


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 14, batch: int = 32, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Trains the labeller by Adam on cross-entropy; the same pages give the same model."""
    rng = np.random.default_rng(5)
    n_in = PATH_DIM + WORD_DIM + MORE_DIM
    model = {}
    for d in "fb":
        model[f"w{d}"] = rng.normal(0, 1 / np.sqrt(n_in), (n_in, 4 * HIDDEN))
        model[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        model[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    model["v"], model["a"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    pages_of = [k for k in range(len(pages)) if len(pages[k])]
    for _ in range(epochs):
        order = rng.permutation(pages_of)
        # Pages of like length share a batch.
        groups = [order[k : k + 8 * batch] for k in range(0, len(order), 8 * batch)]
        order = np.concatenate([g[np.argsort([len(pages[k]) for k in g], kind="stable")] for g in groups]) if groups else order
        for k in rng.permutation(range(0, len(order), batch)):
            some = order[k : k + batch]
            x, mask = padded([pages[i] for i in some])
            y = np.zeros_like(mask)
            for col, i in enumerate(some):
                y[: len(labels[i]), col] = labels[i]
            keep: tuple[list, list] = ([], [])
            state, p = run(model, x, mask, keep)
            d = (p - y) * mask / mask.sum()
            grad = {"v": np.tensordot(d, state, axes=([0, 1], [0, 1])), "a": np.array([d.sum()])}
            d_state = d[:, :, None] * model["v"]
            for name, xs, kept, ds in (("f", x, keep[0], d_state[:, :, :HIDDEN]), ("b", x[::-1], keep[1], d_state[::-1, :, HIDDEN:])):
                grad[f"w{name}"], grad[f"u{name}"], grad[f"b{name}"] = lstm_back(xs, model[f"u{name}"], kept, ds)
            step += 1
            for q, g in grad.items():
                g = np.clip(g, -1, 1)
                first[q] = 0.9 * first[q] + 0.1 * g
                second[q] = 0.99 * second[q] + 0.01 * g * g
                model[q] = model[q] - rate * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.99**step)) + 1e-8)
    return model


def weak_labels(page: list[Block]) -> np.ndarray:
    """1 for blocks in a main element and outside boilerplate; without a main element, for all outside boilerplate."""
    some = any(path.main and not path.junk for _, path, _ in page)
    return np.array([float(not path.junk and (path.main or not some)) for _, path, _ in page])


def variants(texts: list[str], rng: np.random.Generator, n: int) -> list[list[tuple[str, int]]]:
    """Pages made of real blocks with known labels: (html piece, label) lists in many common layouts."""

    def pick() -> str:
        return html.escape(texts[int(rng.integers(len(texts)))])

    def short() -> str:
        return " ".join(pick().split(" ")[: int(rng.integers(1, 6))])

    def one(options: str) -> str:
        options = options.split()
        return options[int(rng.integers(len(options)))]

    def box(names: str, tags: str = "div section") -> str:
        name = one(names)
        return one(tags) + (f' class="{name}"' if rng.random() < 0.7 else f' id="{name}"')

    def junk() -> list[str]:
        kind = int(rng.integers(9))
        if kind == 0:
            items = "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rng.integers(2, 9)))
            return [one("nav menu div"), f"<ul>{items}</ul>"] if rng.random() < 0.6 else [box("menu nav navbar topnav breadcrumb", "div ul"), items]
        if kind == 1:
            return ["header" if rng.random() < 0.6 else box("header masthead site-header"), f"<p>{short()}</p>" if rng.random() < 0.5 else f"<h1>{short()}</h1>"]
        if kind == 2:
            return ["footer" if rng.random() < 0.6 else box("footer copyright site-footer"), f"<p>&copy; {short()} &middot; {pick()}</p>"]
        if kind == 3:
            return ["aside" if rng.random() < 0.6 else box("sidebar side widget related recommended"), "".join(f"<p>{pick()}</p>" for _ in range(rng.integers(1, 4)))]
        if kind == 4:
            return [box("cookie notice consent cookie-notice alert popup newsletter"), f"<p>{pick()}</p><button>{short()}</button>"]
        if kind == 5:
            return [box("ad ads advert advertisement banner promo sponsored"), pick()]
        if kind == 6:
            return ["form", f"<label>{short()}</label><input name=q><p>{short()}</p><button>{short()}</button>"]
        if kind == 7:
            more = "".join(f'<div class="{one("comment reply")}"><p>{pick()}</p></div>' for _ in range(rng.integers(1, 5)))
            return [box("comments replies discussion comment-list"), f"<h3>{short()}</h3>{more}"]
        return [box("share social tags pagination"), "".join(f"<a href=#>{short()}</a> " for _ in range(3))]

    def wrap(piece: list[str]) -> tuple[str, int]:
        tag = piece[0].split(" ")[0]
        return f"<{piece[0]}>{piece[1]}</{tag}>", 0

    def table() -> str:
        rows = "".join(f"<tr><td>{short()}<td>{short() if rng.random() < 0.5 else int(rng.integers(1000))}</tr>" for _ in range(rng.integers(1, 4)))
        return f"<table><tr><th>{short()}</th><th>{short()}</th></tr>{rows}</table>"

    def inner_junk() -> list[str]:
        """What stands inside of an article and isn't of it."""
        kind = int(rng.integers(5))
        if kind < 2:
            return ["aside" if rng.random() < 0.5 else box("related sidebar promo"), f"<p>{pick()}</p>"]
        if kind < 4:
            more = "".join(f"<p>{pick()}</p>" if rng.random() < 0.5 else f'<div class="{one("comment reply")}"><p>{pick()}</p></div>' for _ in range(rng.integers(1, 4)))
            return [box("comments replies discussion comment-list", "section div"), f"<h2>{short()}</h2>{more}"]
        return junk()

    pages = []
    for _ in range(n):
        bare, closed = rng.random() < 0.25, rng.random() < 0.75
        end = "</p>" if closed else ""
        body = [(f"<h1>{short()}</h1>", 1)] if rng.random() < 0.7 else []
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.12:
                body.append((f"<h2>{short()}</h2>", 1))
            elif kind < 0.2:
                body.append((f"<ul><li>{pick()}</li><li>{pick()}</li></ul>", 1))
            elif kind < 0.28:
                body.append((f"<blockquote><p>{pick()}</p></blockquote>", 1))
            elif kind < 0.38:
                body.append(wrap(inner_junk()))
            elif kind < 0.44:
                body.append((table(), 1))
            elif kind < 0.47:
                body.append((f"<pre><code>{short()} = {short()}</code></pre>", 1))
            elif kind < 0.5:
                body.append((f"<figure><figcaption>{short()}</figcaption></figure>", 1))
            elif kind < 0.53:
                body.append((f"<dl><dt>{short()}<dd>{pick()}</dl>", 1))
            else:
                body.append((f"<p>{pick()}{end}", 1))
        single = rng.random() < 0.12
        if single:
            body = [(f"<p>{pick() if rng.random() < 0.6 else short()}{end}", 1)]
        roles = not bare and rng.random() < 0.15
        main = "article" if rng.random() < 0.6 else ("main" if rng.random() < 0.4 else box("content post entry story article-body main post-content"))
        main = f'{one("div section")} role="main"' if roles else main
        tag = main.split(" ")[0]
        role = lambda name: (f'<div role="{name}"><p>{short()}</p><a href=#>{short()}</a></div>', 0)
        least = 0 if bare else 1
        before = [wrap(junk()) for _ in range(rng.integers(least, 3 if bare else 5))]
        after = [wrap(junk()) for _ in range(rng.integers(least, 3 if bare else 5))]
        if single and bare:
            before, after = [], []
        if roles:
            before, after = [role("banner"), role("navigation")], [role("complementary"), role("contentinfo")]
        around = rng.random() < 0.4
        whole = body if bare else [(f"<{main}>", 0), *body, (f"</{tag}>", 0)]
        pages.append(([('<div class="wrapper">', 0)] if around else []) + before + whole + after)
    return pages


def labelled(pieces: list[tuple[str, int]]) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a made page; a mark in front of each piece's texts carries its label through."""
    marked = "".join(re.sub(r">(?=[^<\s])", f">{label}\x01", piece) if label or piece[-1] == ">" else piece for piece, label in pieces)
    found = blocks(f"<html><body>{marked}</body></html>")
    y = np.array([1.0 if "1\x01" in text else 0.0 for text, _, _ in found])
    return [(re.sub("[01]\x01", "", text) or ".", path, linked) for text, path, linked in found], y


def train(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fits the labeller on at most `sample` pages, labelled weakly by their tags, and on layouts made of their blocks."""
    rows = pages.where("html is not null").select("page_id", "html", F.xxhash64("page_id", "html").alias("h"))
    # The pages of the least hashes; a bar on the hash that twice as many get under keeps the rest from being sorted and sent.
    bar = min(2**63 - 1, -(2**63) + 2 * sample * 2**64 // max(1, rows.count()))
    rows = rows.where(F.col("h") <= F.lit(bar)).orderBy("h", "page_id").limit(sample).collect()
    some = [b for b in (blocks(r["html"]) for r in sorted(rows, key=lambda r: (r["page_id"] is None, r["page_id"], r["html"]))) if b]
    x = [p for p in some]
    y = [weak_labels(p) for p in some]
    texts = [t[:400] for p in some for t, _, _ in p] or ["some text"]
    rng = np.random.default_rng(3)
    for piece in variants(texts, rng, max(900, 4 * len(some))):
        page, label = labelled(piece)
        x.append(page)
        y.append(label)
    encode = Encoder()
    # Long pages are cut into stretches for training only.
    xs, ys = [], []
    for page, label in zip(x, y, strict=True):
        v = encode(page)
        for k in range(0, len(v), 120):
            xs.append(v[k : k + 120])
            ys.append(label[k : k + 120])
    return fit(xs, ys)


def main_text(model: dict[str, np.ndarray]):  # noqa: ANN201
    """A column function: html to its main text; every block of a page is read, whatever the page's length."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = Encoder()
        for batch in batches:
            texts = [""] * len(batch)
            found = [blocks(page) for page in batch]
            order = sorted((k for k, p in enumerate(found) if p), key=lambda k: len(found[k]))
            while order:
                most = max(1, min(64, 20_000 // len(found[order[-1]])))
                some, order = order[-most:], order[:-most]
                x, mask = padded([encode(found[k]) for k in some])
                p = run(model, x, mask)[1]
                for col, k in enumerate(some):
                    texts[k] = "\n\n".join(t for (t, _, _), q in zip(found[k], p[:, col], strict=False) if q >= 0.5)
            yield pd.Series(texts, dtype=object)

    return extract


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """pages with `text`, the main text ('' if none), and `n_chars`, its code points; null html is an empty page.

    Scripts, styles, comments, titles, <template>, <noscript>, <svg>, <canvas>, <iframe>, <select> and <textarea> are
    no blocks; a head has no other text, as any other begins the body. Of such an element that isn't closed only
    the tag goes (scripts and styles reach to the page's end, as in HTML). References are decoded, white space within a
    block becomes one space, the blocks taken for main text are joined in page order by two newlines. Rows that
    repeat get the same text.
    """
    small_batches(pages.sparkSession)
    model = model or train(pages)
    found = pages.drop("text", "n_chars").withColumn("text", main_text(model)("html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
