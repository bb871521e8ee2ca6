"""Main text of web pages by a recurrent block labeller (operator 3).

A page is read into its leaf blocks: runs of text between tags that break lines, in page order, each
with the path of tags that hold it (names, classes and ids). Each block becomes a vector of its hashed
path, its hashed words and a few figures (length, share of link text, punctuation, place). A
bidirectional LSTM reads the page's whole sequence, so every block is classed with the context before
and after it; blocks classed as content make the text.

The model is trained here, on generated pages: layouts are drawn at random (menus, headers, notices,
side bars, adverts, forms, comments, footers around and within an article in one of several mark-ups) and filled with
random words, so that labels are known and no page of the data is needed. Training takes seconds
and always gives the same weights.

Defined results: null html is empty and gives empty text; a comment, script or declaration that never closes reaches to the
page's end, a tag to the next one; pages and nesting may be of any length and depth, in linear work; a block that scores exactly
one half is left out; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import ship, table

PATH_PLACES, WORD_PLACES, FIGURES, HIDDEN = 96, 48, 8, 20
WIDTH = PATH_PLACES + WORD_PLACES + FIGURES
TRAIN_PAGES, EPOCHS, BATCH = 800, 8, 32
SEED = 7
#: Pages of more blocks than this are read in parts.
LONG_PAGE = 4096

#: Elements that break a line of text (HTML living standard, rendering section), fixed values.
BLOCK_TAGS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN_TAGS = set("head script style template noscript svg math iframe object select textarea button title audio video canvas".split())
#: A start tag closes open elements of these names (the usual omitted end tags).
CLOSES = {t: {"p"} for t in BLOCK_TAGS - {"body", "html"}} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
#: Closing by a start tag never reaches beyond these.
SCOPES = set("article aside body div footer form header html main nav ol section table td th ul".split())
_STOPS = SCOPES.union(*CLOSES.values())

_KNOWN = BLOCK_TAGS | VOID_TAGS | HIDDEN_TAGS | set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label map mark meter nobr output picture progress q ruby rp rt s samp slot small span strike strong sub sup time tt u var".split())
# A tag ends at the first > outside quoted values, or before the next <, or with the page; so whatever is read is
# consumed, and reading is linear in any page. A quote that never closes is a character like others.
_REST = r"""(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+"""
_MARKUP = re.compile(
    rf"""<!--(?:.*?-->|.*)|<(?P<raw>script|style|textarea|title|iframe|noscript)(?![a-z0-9:-]){_REST}>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>{_REST})(?P<close>>?)""",
    re.I | re.S,
)
_LONG_REFERENCE = re.compile(r"&#0*([0-9]{0,7})([0-9]*);?")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


class Leaf:
    """A block of text: its path as a set of hashed places (bits) and a depth, share of link text."""

    __slots__ = ("depth", "links", "path", "text")

    def __init__(self, path: int, depth: int, text: str, links: float):
        self.path, self.depth, self.text, self.links = path, depth, text, links


def _bit(kind: str, word: str) -> int:
    return 1 << _place(kind, word, PATH_PLACES)


def _reference(m: re.Match) -> str:
    # Numbers beyond seven digits are no characters, and Python refuses to read very long ones.
    return "\ufffd" if m[2] else f"&#{m[1]};" if m[1] else m[0]


def _decoded(text: str) -> str:
    return entities.unescape(_LONG_REFERENCE.sub(_reference, text) if "&#" in text else text)


def leaves(page: str | None) -> list[Leaf]:
    """Leaf blocks in page order: path, text with references decoded and white space made one space, share of link text.

    Each open element holds the places of its whole path, so a leaf costs the same at any depth.
    """
    out: list[Leaf] = []
    #: tag, places of the path that ends here, places if this is the innermost element, index of the nearest
    #: element here or below that may be closed by a start tag or stops that.
    stack: list[tuple[str, int, int, int]] = []
    open_of: Counter[str] = Counter()
    parts: list[str] = []
    linked = hidden = 0
    bodies = False
    text = page or ""

    def flush():
        nonlocal linked
        if parts:
            joined = " ".join(_decoded("".join(parts)).split())
            if joined:
                out.append(Leaf(stack[-1][2] if stack else 0, len(stack), joined, min(1.0, linked / max(1, len(joined)))))
            parts.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece and not hidden:
            parts.append(piece)
            if open_of["a"]:
                linked += len(piece)

    def close(k: int):
        nonlocal hidden
        for t, *_ in stack[k:]:
            open_of[t] -= 1
            hidden -= t in HIDDEN_TAGS
        del stack[k:]

    at = 0
    for m in _MARKUP.finditer(text):
        add(text[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if not m["close"] and tag not in _KNOWN:
            add(m[0])
            continue
        if m["end"]:
            if tag in BLOCK_TAGS:
                flush()
            if open_of[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in BLOCK_TAGS:
            flush()
            k = stack[-1][3] if stack else -1
            while k >= 0:
                if stack[k][0] in CLOSES.get(tag, ()):
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
                k = stack[k - 1][3] if k else -1
        if tag == "br":
            add(" ")
        if tag == "body" and not bodies:  # an open head ends here
            bodies, held = True, [x for x in stack if x[0] == "html"]
            close(0)
            stack += held
            open_of["html"] += len(held)
        if tag in VOID_TAGS or m["rest"].endswith("/"):
            continue
        names = 0
        for x in _NAMES.findall(m["rest"]) if m["rest"] else ():
            for p in _PARTS.findall("".join(x).lower()):
                names |= _bit("n", p)
        under = stack[-1][1] if stack else 0
        anchor = len(stack) if tag in _STOPS else stack[-1][3] if stack else -1
        stack.append((tag, under | names | _bit("t", tag), under | names | _bit("leaf", tag), anchor))
        open_of[tag] += 1
        hidden += tag in HIDDEN_TAGS
    add(text[at:])
    flush()
    return out


@functools.lru_cache(maxsize=1 << 16)
def _place(kind: str, word: str, places: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % places


def vectors(page: list[Leaf], start: int = 0, stop: int | None = None) -> np.ndarray:
    """(blocks x WIDTH): hashed path, hashed words, figures. ``start``, ``stop``: of these blocks of the page only."""
    part = page[start:stop]
    out = np.zeros((len(part), WIDTH), np.float32)
    bits = np.frombuffer(b"".join(leaf.path.to_bytes(PATH_PLACES // 8, "little") for leaf in part), np.uint8).reshape(len(part), -1)
    out[:, :PATH_PLACES] = np.unpackbits(bits, axis=1, bitorder="little")
    for k, leaf in enumerate(part):
        x = out[k]
        words = leaf.text.lower().split()
        places = np.array([_place("w", w[:24], WORD_PLACES) for w in words])
        x[PATH_PLACES : PATH_PLACES + WORD_PLACES] = np.bincount(places, minlength=WORD_PLACES) * np.float32(1 / np.sqrt(len(words)))
        n = len(leaf.text)
        x[-FIGURES:] = (
            np.log1p(n) / 6, np.log1p(len(words)) / 5, leaf.links, leaf.text[-1] in ".!?:;\"'", sum(map(leaf.text.count, ",.;")) / max(1, len(words)),
            (start + k) / max(1, len(page) - 1), min(leaf.depth, 60) / 12, len(page) / (len(page) + 20),
        )
    np.clip(out, 0, 5, out=out)
    np.clip(out[:, :-FIGURES], 0, 3, out=out[:, :-FIGURES])
    return out


# --- the network ---------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in ("f", "b"):
        w[d + "x"] = rng.standard_normal((WIDTH, 4 * HIDDEN)).astype(np.float32) / np.sqrt(WIDTH).astype(np.float32)
        w[d + "h"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)).astype(np.float32) / np.sqrt(HIDDEN).astype(np.float32)
        w[d + "c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    w["o"] = rng.standard_normal((2 * HIDDEN + WIDTH, 1)).astype(np.float32) * np.float32(0.1)
    w["oc"] = np.zeros(1, np.float32)
    return w


def _pass(w: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """One direction over (time, batch, WIDTH) and the state it ends in; states stand still where the mask is 0."""
    steps, batch, _ = x.shape
    out = np.zeros((steps, batch, HIDDEN), np.float32)
    h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
    given = x @ w[d + "x"] + w[d + "c"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = given[t] + h @ w[d + "h"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tanh, m))
        h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
        out[t] = h
    return out, (h, c)


def forward(w: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Probability that each block is content, (time, batch)."""
    kept = {d: [] if keep is not None else None for d in "fb"}
    joined = np.concatenate([_pass(w, "f", x, mask, kept["f"])[0], _pass(w, "b", x, mask, kept["b"])[0], x], axis=2)
    if keep is not None:
        keep.update(kept, joined=joined)
    return _sigmoid((joined @ w["o"])[..., 0] + w["oc"][0])


def long_scores(w: dict, page: list[Leaf], size: int = 4096) -> np.ndarray:
    """``forward`` for one page of any length: states pass from part to part, and only they and the outputs are held."""
    starts = list(range(0, len(page), size))
    out = np.zeros(len(page), np.float32)
    for d, at in (("f", 0), ("b", HIDDEN)):
        state = None
        for k in starts if d == "f" else starts[::-1]:
            x = vectors(page, k, k + size)[:, None]
            y, state = _pass(w, d, x, np.ones((len(x), 1), np.float32), None, state)
            out[k : k + size] += (y[:, 0] @ w["o"][at : at + HIDDEN])[:, 0]
            if d == "f":
                out[k : k + size] += (x[:, 0] @ w["o"][2 * HIDDEN :])[:, 0]
    return _sigmoid(out + w["oc"][0])


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    keep: dict = {}
    p = forward(w, x, mask, keep)
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum())
    dz = (mask * (p - y) / mask.sum())[..., None].astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["o"] = np.einsum("tbk,tbo->ko", keep["joined"], dz)
    g["oc"] = dz.sum(axis=(0, 1))
    back = dz @ w["o"].T
    for d, at in (("f", 0), ("b", HIDDEN)):
        dh, dc = np.zeros_like(keep[d][0][1]), np.zeros_like(keep[d][0][1])
        for t, h, c, i, f, o, gg, tanh, m in reversed(keep[d]):
            dh = dh + back[t][:, at : at + HIDDEN]
            own, rest = dh * m, dh * (1 - m)
            dnew = dc * m + own * o * (1 - tanh * tanh)
            dzt = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), own * tanh * o * (1 - o), dnew * i * (1 - gg * gg)], axis=1)
            g[d + "x"] += x[t].T @ dzt
            g[d + "h"] += h.T @ dzt
            g[d + "c"] += dzt.sum(axis=0)
            dh, dc = dzt @ w[d + "h"].T + rest, dnew * f + dc * (1 - m)
    return loss, g


# --- generated pages -----------------------------------------------------------------------------


def _words(rng: np.random.Generator, n: int) -> str:
    parts = ["al", "be", "co", "da", "en", "fi", "gu", "hé", "in", "jo", "ka", "lo", "mä", "ne", "or", "pé", "qu", "ra", "st", "te", "ul", "vi", "wa", "ñe", "za"]
    sizes, marks = rng.integers(1, 5, n), rng.random(n)
    syllables = iter(rng.integers(0, len(parts), int(sizes.sum())).tolist())
    out = ["".join(parts[next(syllables)] for _ in range(k)) for k in sizes.tolist()]
    return " ".join(w + ("," if m < 0.06 else "." if m < 0.14 else "") for w, m in zip(out, marks.tolist(), strict=True)).capitalize()


def _prose(rng: np.random.Generator, low: int = 4, high: int = 90) -> str:
    return _words(rng, int(rng.integers(low, high))) + ("." if rng.random() < 0.9 else "")


def _menu(rng) -> str:
    items = "".join(f'<li><a href="/x">{_words(rng, int(rng.integers(1, 4)))}</a></li>' for _ in range(rng.integers(2, 9)))
    return f"<ul>{items}</ul>"


def _noise(rng, kind: str) -> str:
    """One region that is not content, in one of its usual forms."""

    def one(*forms: str) -> str:
        return str(rng.choice(np.array(forms, dtype=object)))

    short, some = _words(rng, int(rng.integers(1, 6))), _prose(rng, 4, 25)
    if kind == "menu":
        return one(f"<nav>{_menu(rng)}</nav>", f'<div class="menu">{_menu(rng)}</div>', f'<ul class="breadcrumb"><li><a href="/">{short}</a></li><li>{short}</li></ul>', f'<div id="navigation"><a href="#">{short}</a> | <a href="#">{short}</a></div>')
    if kind == "header":
        return one(f"<header><h1>{short}</h1><p>{some}</p></header>", f'<div id="header"><a href="/">{short}</a><p>{some}</p></div>', f'<header class="site-header">{_menu(rng)}</header>', f'<div class="banner">{short}</div>')
    if kind == "footer":
        return one(f"<footer>&copy; {short} &middot; {some}</footer>", f'<div id="footer"><p>{some}</p>{_menu(rng)}</div>', f"<footer><p>{some}</p></footer>", f'<div class="copyright">&copy; 2024 {short}. All rights reserved.</div>')
    if kind == "side":
        return one(f"<aside><h3>{short}</h3><p>{some}</p></aside>", f'<div class="sidebar">{_menu(rng)}<p>{some}</p></div>', f'<div id="related"><h4>{short}</h4>{_menu(rng)}</div>', f'<aside class="widget"><p>{some}</p><p>{some}</p></aside>', f'<div class="share social"><a href="#">{short}</a></div>')
    if kind == "ad":
        name = one("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad")
        return one(f'<div class="{name}">{some}</div>', f'<div class="{name}"><p>{some}</p></div>', f'<div id="{name}"><a href="#">{some}</a></div>', f'<section class="{name}">{some}</section>', f'<p class="{name}">{some}</p>')
    if kind == "notice":
        name = one("cookie", "cookies", "consent", "notice", "newsletter", "popup", "alert", "subscribe", "gdpr", "paywall", "modal", "warning")
        return one(f'<div class="{name}">{some}</div>', f'<div class="{name}"><p>{some}</p><a href="#">{short}</a></div>', f'<div id="{name}-bar">{some}</div>', f'<section class="{name}"><h3>{short}</h3><p>{some}</p></section>')
    if kind == "form":
        return one(f'<form><p>{some}</p><label>{short}</label><input name="q"></form>', f'<form class="search"><label>{short}</label><input><button>{short}</button></form>', f'<div class="login"><form>{short}<input></form></div>', f"<form><fieldset><legend>{short}</legend><p>{some}</p></fieldset></form>")
    count = int(rng.integers(1, 6))
    name = one("comments", "comment-list", "responses", "disqus", "replies")
    inner = "".join(one(f'<div class="comment"><b>{_words(rng, 1)}</b><p>{_prose(rng, 3, 60)}</p></div>', f'<li class="comment"><p>{_prose(rng, 3, 60)}</p></li>', f"<p>{_prose(rng, 3, 60)}</p>") for _ in range(count))
    return one(f'<div class="{name}"><h3>{short}</h3>{inner}</div>', f'<section id="{name}">{inner}</section>', f'<ol class="{name}">{inner}</ol>')


NOISE = ("menu", "header", "footer", "side", "ad", "notice", "form", "comments")
_MARK, _END = "\x02", "\x03"


def generated(rng: np.random.Generator) -> tuple[list[Leaf], list[int]]:
    """One random page: its leaf blocks and which are content (content carries a mark, removed here)."""

    def mark(tag: str, text: str) -> str:
        return f"<{tag}>{_MARK}{text}</{tag}>" if rng.random() < 0.85 or tag != "p" else f"<p>{_MARK}<b>{text}<br>"

    content = [mark(str(rng.choice(["h1", "h1", "h2"])), _words(rng, int(rng.integers(1, 14))))] if rng.random() < 0.9 else []
    plain = rng.random() < 0.5  # an article of paragraphs only
    for _ in range(1 + min(90, int(rng.exponential(11)))):
        kind = 0.0 if plain else rng.random()
        if kind < 0.74:
            content.append(mark("p", _prose(rng, 1, 8) if rng.random() < 0.25 else _prose(rng, 1, 110)))
        elif kind < 0.82:
            content.append(mark(str(rng.choice(["h2", "h3", "h4"])), _words(rng, int(rng.integers(1, 8)))))
        elif kind < 0.88:
            content.append("<ul>" + "".join(mark("li", _prose(rng, 1, 20)) for _ in range(rng.integers(2, 6))) + "</ul>")
        elif kind < 0.91:
            content.append(mark("blockquote", _prose(rng)))
        elif kind < 0.93:
            content.append(mark("pre", _prose(rng)))
        elif kind < 0.95:
            content.append("<table><tr>" + "".join(mark("td", _words(rng, 2)) for _ in range(3)) + "</tr></table>")
        elif kind < 0.97:
            content.append(f'<p>{_MARK}{_prose(rng)} <a href="/y">{_words(rng, 2)}</a> {_prose(rng, 2, 9)}</p>')
        else:
            content.append(mark("div", _prose(rng)))
    for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.5 else 0):  # regions inside the article
        content.insert(int(rng.integers(0, len(content) + 1)), _noise(rng, str(rng.choice(["ad", "side", "notice", "form", "menu", "comments"]))))
    holder = ("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post">', "</div>"), ("<main><article>", "</article></main>"), ('<article class="entry">', "</article>"), ('<div class="article-body">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>")
    begin, end = holder[int(rng.choice(len(holder), p=[0.4, 0.1, 0.1, 0.08, 0.1, 0.08, 0.06, 0.04, 0.04]))]
    before = [_noise(rng, str(k)) for k in rng.choice(["menu", "header", "ad", "notice", "form", "side"], rng.integers(0, 5))]
    after = [_noise(rng, str(k)) for k in rng.choice(["side", "comments", "footer", "ad", "form", "notice", "menu"], rng.integers(0, 5))]
    page = f"<html><head><title>{_words(rng, 4)}</title></head><body>{''.join(before)}{begin}{''.join(content)}{end}{''.join(after)}</body></html>"
    found = leaves(page)
    labels = [int(_MARK in leaf.text) for leaf in found]
    for leaf in found:
        leaf.text = leaf.text.replace(_MARK, "") or "."
    return found, labels


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights, by Adam on generated pages; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    data = [(vectors(p), np.array(y, np.float32)) for p, y in (generated(rng) for _ in range(pages)) if p]
    data.sort(key=lambda d: len(d[0]))
    groups = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
    w = start_weights(rng)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for k in rng.permutation(len(groups)):
            x, mask = padded([p for p, _ in groups[k]])
            y = np.zeros_like(mask)
            for j, (_, labels) in enumerate(groups[k]):
                y[: len(labels), j] = labels
            _, g = gradients(w, x, mask, y)
            step += 1
            for name, v in g.items():
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                w[name] = (w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def texts_of(pages: list[str | None], w: dict, together: int = 64) -> list[list[str]]:
    """Content blocks of each page. Pages of like length are read together."""
    found = [leaves(p) for p in pages]
    out: list[list[str]] = [[] for _ in pages]
    order = sorted((k for k, p in enumerate(found) if 0 < len(p) <= LONG_PAGE), key=lambda k: len(found[k]))
    for k, p in enumerate(found):
        if len(p) > LONG_PAGE:
            out[k] = [leaf.text for leaf, s in zip(p, long_scores(w, p).tolist(), strict=True) if s > 0.5]
    for k in range(0, len(order), together):
        part = order[k : k + together]
        # A page of extraordinary length is read alone, so that it pads no others.
        for group in ([part] if len(found[part[-1]]) <= 2 * len(found[part[0]]) + 50 else [[j] for j in part]):
            scores = forward(w, *padded([vectors(found[j]) for j in group]))
            for c, j in enumerate(group):
                out[j] = [leaf.text for leaf, s in zip(found[j], scores[:, c].tolist(), strict=False) if s > 0.5]
    return out


def extracted(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for each row of ``pages`` (page_id, url, html)."""
    w = weights or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                blocks = texts_of(part.column(2).to_pylist(), w)
                texts = ["\n\n".join(b) for b in blocks]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


ship(__name__)
