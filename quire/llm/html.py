"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block gets features of its ancestors' tags
and names and of its text, and of the blocks beside it; the field is trained on labelled pages and decoded by Viterbi.

Defined cases: null html is an empty page with empty text; unclosed elements end where HTML implies it; a comment, script or
tag that never ends takes the rest; repeated rows and null ids are rows like any other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.arrow import lean

from quire.llm.crf import LinearChain

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|select|button)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_ENDS_P = frozenset("address article aside blockquote body details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())

#: Groups that an element falls in by its tag or by a word of its class, id or role.
GROUPS: dict[str, tuple[str, str]] = {
    "navigation": ("nav menu", "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager topbar tabs skip"),
    "header": ("header", "header masthead logo topbar hero"),
    "footer": ("footer", "footer copyright legal colophon imprint"),
    "aside": ("aside", "sidebar aside related widget recommended trending popular rail more complementary"),
    "advert": ("ins", "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored adsense commercial"),
    "comment": ("", "comment comments commentlist disqus reply replies respond discussion thread"),
    "notice": ("dialog", "cookie cookies consent gdpr notice notices alert modal popup newsletter subscribe overlay paywall toast disclaimer signup"),
    "social": ("", "share sharing social follow tweet facebook"),
    "form": ("form fieldset label input", "form login search contact"),
    "article": ("article", "article articlebody"),
    "main": ("main", "main content post entry story prose body text"),
    "heading": ("h1 h2 h3 h4 h5 h6", "title headline"),
    "paragraph": ("p", ""),
    "list": ("ul ol dl menu", ""),
    "table": ("table", ""),
    "quote": ("blockquote pre", ""),
    "figure": ("figure figcaption", "caption"),
    "head": ("head", ""),
    "hidden": ("", "hidden"),
}
_TAG_BITS: dict[str, int] = {}
_WORD_BITS: dict[str, int] = {}
for _i, (_tags, _words) in enumerate(GROUPS.values()):
    for _t in _tags.split():
        _TAG_BITS[_t] = _TAG_BITS.get(_t, 0) | 1 << _i
    for _t in _words.split():
        _WORD_BITS[_t] = _WORD_BITS.get(_t, 0) | 1 << _i
_BIT = {g: 1 << i for i, g in enumerate(GROUPS)}


@functools.lru_cache(maxsize=50_000)
def _bits(name: str, attrs: str) -> int:
    out = _TAG_BITS.get(name, 0)
    for m in _NAMES.finditer(attrs):
        for part in _PART.findall(m[1] or m[2] or m[3] or ""):
            out |= _WORD_BITS.get(part.lower(), 0)
    return out


class Block:
    __slots__ = ("groups", "link", "tag", "text")

    def __init__(self, text: str, groups: int, tag: str, link: int):
        self.text, self.groups, self.tag, self.link = text, groups, tag, link


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]  # open block-level elements with the groups of all their ancestors
    text: list[str] = []
    linked, in_link, inline = 0, 0, 0

    def flush() -> None:
        nonlocal linked, inline
        if text:
            joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, stack[-1][1] | inline, stack[-1][0], min(linked, len(joined))))
            text.clear()
        linked, inline = 0, 0

    def pop(names: frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] is not None or m[0].startswith("<!"):
                continue
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                in_link = 0 if m["end"] else 1
            elif name == "br":
                text.append(" ")
            if not m["end"] and m["attrs"]:
                inline |= _bits(name, m["attrs"])
            continue
        flush()
        in_link = 0
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _ENDS_P:
            pop(frozenset(("p",)), frozenset(("table", "td", "th", "button", "article", "section", "div", "li", "blockquote", "body")))
        if name in _CLOSES:
            pop(*_CLOSES[name])
        if name == "body":
            del stack[1:]
        if name not in _VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append((name, stack[-1][1] | _bits(name, m["attrs"])))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


# -- features ---------------------------------------------------------------------------------------------------------

_WIDTH = 8
_WORDS, _LINKS, _MARKS = (1, 3, 6, 12, 25, 60, 120), (0.05, 0.3, 0.6, 0.95), (0.01, 0.05, 0.1, 0.2)
_TAGS = {"p": 0, "h1": 1, "h2": 2, "h3": 2, "li": 3, "div": 4, "section": 4, "td": 5, "th": 5, "article": 6, "main": 6, "blockquote": 6, "pre": 6}
_END = frozenset(".!?:;\"'”»…")
N_FEATURES = len(GROUPS) + 8 + 3 * 4


def features(page: list[Block]) -> np.ndarray:
    """Bin numbers (blocks, N_FEATURES) of each block's ancestors, text and neighbours."""
    n = len(page)
    f = np.zeros((n, N_FEATURES), np.int64)
    if not n:
        return f
    groups = np.array([b.groups for b in page], np.int64)
    for k in range(len(GROUPS)):
        f[:, k] = (groups >> k) & 1
    n_chars = np.array([len(b.text) for b in page])
    n_words = np.array([b.text.count(" ") + 1 for b in page])
    links = np.array([b.link for b in page]) / n_chars
    marks = np.array([sum(map(b.text.count, ",.;!?")) for b in page]) / n_words
    k = len(GROUPS)
    core = _BIT["article"] | _BIT["main"]
    inside = (groups & core) > 0
    within = (groups & _BIT["article"]) > 0
    f[:, k] = np.searchsorted(_WORDS, n_words, "right")
    f[:, k + 1] = np.searchsorted(_LINKS, links, "right")
    f[:, k + 2] = np.searchsorted(_MARKS, marks, "right")
    f[:, k + 3] = np.where(within, 3, np.where(inside, 2, 1)) if within.any() else np.where(inside, 5, 4) if inside.any() else 0
    f[:, k + 4] = [_TAGS.get(b.tag, 7) for b in page]
    f[:, k + 5] = [2 * (b.text[-1] in _END) + ("©" in b.text or "™" in b.text or "®" in b.text) for b in page]
    chrome = sum(_BIT[g] for g in ("navigation", "footer", "aside", "advert", "comment", "notice", "social", "form"))
    aside = (groups & chrome) > 0
    f[:, k + 6] = 2 * inside + aside
    f[:, k + 7] = np.searchsorted((0.001, 0.1, 0.3, 0.7, 0.9, 0.999), np.arange(n) / max(1, n - 1), "right")
    for j, source in enumerate((k, k + 1, k + 6)):
        for d, col in ((-1, k + 8 + 4 * j), (1, k + 9 + 4 * j), (-2, k + 10 + 4 * j), (2, k + 11 + 4 * j)):
            f[:, col] = _WIDTH - 1
            if abs(d) < n:
                if d < 0:
                    f[-d:, col] = np.minimum(f[:d, source], _WIDTH - 2)
                else:
                    f[:-d, col] = np.minimum(f[d:, source], _WIDTH - 2)
    return f + _WIDTH * np.arange(N_FEATURES)


# -- labelled pages ---------------------------------------------------------------------------------------------------

#: Marks a block of the main text in a labelled page.
MARK = "\x02"


def labelled_page(rng: np.random.Generator) -> str:
    """A page of a random layout; blocks of its main text begin with MARK."""
    syllables = "ba de ti on er th en an re st in ing ou ly ha ver kei sch eau que ción mi lo ra zu".split()

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.integers(a, b)))

    def sentence() -> str:
        return words(1 if rng.random() < 0.15 else 4, 18).capitalize() + str(rng.choice([".", ".", ".", "!", "?", ""], p=[0.3, 0.3, 0.25, 0.05, 0.05, 0.05]))

    def text(a: int = 1, b: int = 7) -> str:
        return " ".join(sentence() for _ in range(rng.integers(a, b)))

    def pick(*options: str) -> str:
        return str(rng.choice(options))

    def chance(p: float) -> bool:
        return bool(rng.random() < p)

    def links(tag: str = "ul", n: int = 8) -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(rng.integers(2, n))) + f"</{tag}>"

    def wrap(kind: str, inner: str) -> str:
        opens = {
            "nav": ["nav", 'div class="menu"', 'div id="navbar"', 'ul class="nav"', 'div class="breadcrumbs"', 'div role="navigation"'],
            "header": ["header", 'div class="header"', 'div id="masthead"'],
            "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"'],
            "aside": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related-posts"', 'section class="widget"'],
            "ad": ['div class="ad"', 'div class="advert"', 'div class="ad-banner"', 'div id="ads"', 'aside class="sponsored"', 'p class="promo"', 'div class="advertisement"'],
            "comment": ['section id="comments"', 'div class="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'section class="comments"'],
            "notice": ['div class="cookie-notice"', 'div class="notice"', 'div id="consent"', 'div class="newsletter"', 'dialog class="modal"', 'div role="alert"', 'div class="cookie-banner"'],
            "form": ["form", 'form class="search"', 'div class="login-form"'],
            "social": ['div class="share"', 'div class="social-links"'],
        }[kind]
        tag = pick(*opens)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def chrome(kind: str) -> str:
        if kind == "nav":
            return wrap(kind, links() if chance(0.8) else " | ".join(f"<a href=/{word()}>{words(1, 3)}</a>" for _ in range(5)))
        if kind == "header":
            return wrap(kind, f"<{pick('h1', 'h2', 'p', 'a')}>{words(1, 5)}</p>" + (f"<p>{sentence()}</p>" if chance(0.5) else ""))
        if kind == "footer":
            return wrap(kind, pick("&copy; ", "Copyright ", "") + f"{word()}.example.com &middot; {sentence()}" + (links() if chance(0.4) else "") + (f"<p>{text(1, 4)}</p>" if chance(0.4) else ""))
        if kind == "aside":
            return wrap(kind, (f"<h3>{words(1, 4)}</h3>" if chance(0.7) else "") + (links() if chance(0.6) else f"<p>{text()}</p>"))
        if kind == "comment":
            return wrap(kind, (f"<h3>{words(1, 3)}</h3>" if chance(0.6) else "") + "".join(pick(f"<div class=comment><b>{word()}</b><p>{text()}</p></div>", f"<p>{text()}</p>", f"<li class=comment><p>{text(1, 4)}</p></li>") for _ in range(rng.integers(1, 6))))
        if kind == "notice":
            return wrap(kind, pick(f"<p>{text(1, 4)}</p>", text(1, 3)) + (f"<button>{words(1, 3)}</button>" if chance(0.5) else ""))
        if kind == "form":
            return wrap(kind, f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button>" + (f"<p>{sentence()}</p>" if chance(0.4) else ""))
        if kind == "social":
            return wrap(kind, " ".join(f'<a href="#">{word()}</a>' for _ in range(rng.integers(2, 5))))
        return wrap(kind, pick(text(1, 4), f"<p>{text(1, 3)}</p>", f'<a href="/x">{sentence()}</a>'))

    def body() -> str:
        parts = [f"<{pick('h1', 'h1', 'h2')}>{MARK}{words(2, 10)}</h1>"] if chance(0.85) else []
        parts = [re.sub(r"<h2>(.*)</h1>", r"<h2>\1</h2>", p) for p in parts]
        for _ in range(rng.integers(1, 14)):
            r = rng.random()
            if r < 0.72:
                inner = text() if chance(0.8) else f"<b>{words(1, 3)}</b> {text()} <a href='/{word()}'>{words(1, 3)}</a> {sentence()}"
                parts.append(f"<p>{MARK}{inner}" + ("</p>" if chance(0.85) else ""))
            elif r < 0.78:
                parts.append(f"<p><b>{MARK}{sentence()}<br><p>{MARK}{text()}</p>")
            elif r < 0.84:
                parts.append(f"<h{rng.integers(2, 5)}>{MARK}{words(1, 6)}</h2>".replace("</h2>", "</h2>"))
                parts[-1] = re.sub(r"<h(\d)>(.*)</h2>", r"<h\1>\2</h\1>", parts[-1])
            elif r < 0.89:
                parts.append("<ul>" + "".join(f"<li>{MARK}{words(2, 14)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif r < 0.92:
                parts.append(f"<blockquote>{MARK}{text(1, 3)}</blockquote>")
            elif r < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{rng.integers(1, 999)}</td></tr>" for _ in range(rng.integers(2, 5))) + "</table>")
            elif r < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{MARK}{sentence()}</figcaption></figure>")
            else:
                parts.append(chrome(pick("ad", "social", "aside", "notice", "form")))
        open_ = pick("article", "article", "article", "main", "main", 'div class="content"', 'div class="post-content"', 'div id="main"', 'div class="entry"', "div", "main><article", 'div class="article-body"')
        close = "".join(f"</{t.split()[0]}>" for t in reversed(open_.split("><")))
        tail = chrome("comment") if chance(0.15) else ""
        return f"<{open_}>" + "".join(parts) + tail + close

    before = [chrome(k) for k in ("notice", "header", "nav", "ad", "form", "aside", "nav") if chance(0.4)]
    after = [chrome(k) for k in ("social", "ad", "comment", "aside", "form", "notice") if chance(0.3)] + ([chrome("footer")] if chance(0.85) else [])
    page = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{margin:0}}</style></head><body>" + "".join(before) + body() + "".join(after) + "</body></html>"
    return page if chance(0.95) else page[: int(len(page) * rng.uniform(0.6, 1))]


def labelled_pages(n: int, seed: int = 11) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels (1: main text) of ``n`` labelled pages."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        page = blocks(labelled_page(rng))
        y = np.array([MARK in b.text for b in page], np.int64)
        for b in page:
            b.text = b.text.replace(MARK, "").strip() or "-"
        out.append((page, y))
    return out


class MainText:
    """The trained field."""

    def __init__(self, pages: list[tuple[list[Block], np.ndarray]], steps: int = 100):
        f = np.concatenate([features(p) for p, _ in pages])
        y = np.concatenate([y for _, y in pages])
        self.chain = LinearChain(N_FEATURES * _WIDTH).fit(f, y, np.array([len(p) for p, _ in pages]), steps)

    def texts(self, pages: list[str]) -> list[tuple[str, int]]:
        """(main text, number of blocks) of each page."""
        cut = [blocks(p) for p in pages]
        lengths = np.array([len(c) for c in cut], np.int64)
        if not lengths.sum():
            return [("", 0)] * len(pages)
        y = self.chain.decode(np.concatenate([features(c) for c in cut]), lengths).tolist()
        out, at = [], 0
        for c in cut:
            out.append(("\n".join(b.text for b, keep in zip(c, y[at : at + len(c)], strict=True) if keep), len(c)))
            at += len(c)
        return out


#: Labelled pages that the default field learns from.
TRAINING_PAGES = 500


@functools.lru_cache(maxsize=1)
def default_model() -> MainText:
    return MainText(labelled_pages(TRAINING_PAGES))


def extract(pages: DataFrame, model: MainText | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, main text, its code points, and the page's number of blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # fixed size: a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                hi, size, part = lo, 0, []
                while hi < b.num_rows and size < 1 << 20:
                    part.append(b.column(2)[hi].as_py() or "")
                    size += len(part[-1])
                    hi += 1
                got = m.texts(part)
                n = hi - lo
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n).cast(pa.int64()), b.column(1).slice(lo, n).cast(pa.string()), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])
                lo = hi

    return pages.select(pages[id_col], pages[url_col], pages[html_col]).mapInArrow(lean(run), SCHEMA)
