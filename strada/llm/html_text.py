"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A tolerant scan splits a page into leaf blocks: runs of text between block-level tags, each with its open ancestors (tag
names and the words of their class, id and role). Contents of script, style, svg and the like are never blocks. Features
are the ancestors' tags and name words, the block's own tag, and the text's length, punctuation, links and wording. Two
labels, content and boilerplate, are chained by transition weights; Viterbi decodes a page's blocks, and those labelled
content are the text.

The field is trained by stochastic gradient on the exact log likelihood (forward-backward) over labelled pages that a
seeded generator lays out: article templates of many kinds with menus, headers, footers, sidebars, notices, adverts, forms
and comments around and between their paragraphs, with the tag and class names in common use. Training is deterministic.

Cases. A null or empty html gives an empty text. Unclosed, misnested or cut-off tags and half character references are
read as far as they go: script, style, textarea, title and iframe without an end tag go on to the end of the page, as in
HTML; noscript, svg, select and the other elements without text of the page end with the element around them or before a
block that can't stand in them; a head ends at what can't stand in it. A page of plain text without a tag is one block. Rows with a null page_id are left out; rows that
repeat a page_id are extracted each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm.common import ship, table, work_dir

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea title".split())
#: Those of them that hold plain text: without an end tag they go on to the end of the page.
RAW = frozenset("script style iframe textarea title".split())
#: Those that may stand in one of their own kind.
NESTED = frozenset("template svg math object canvas".split())
#: Elements that end the block before them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul label option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind closes an open element of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Of the block elements, what may stand in a dropped element; the others end one that has no end tag.
STANDS = {"select": frozenset("option legend hr button".split())}
#: What else ends an svg or math element without an end tag, as in HTML.
_BREAKOUT = frozenset("b big br code em embed i img listing nobr ruby s small span strong strike sub sup tt u var".split())
_ENDS_P = BLOCKS - {"button", "label", "option", "body", "html"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Open:
    """An open element, with what its descendants need to know of it and its ancestors; made from its parent's in constant time."""

    __slots__ = ("name", "words", "own_hidden", "up", "tags", "kinds", "last", "tag", "hidden", "linked", "article", "place")

    def __init__(self, name: str, words: tuple[str, ...], hidden: bool, up: Open | None, places: dict):
        self.name, self.words, self.own_hidden, self.up = name, words, hidden, up
        tags, kinds, last, self.tag = (up.tags, up.kinds, up.last, up.tag) if up else (frozenset(), frozenset(), (), "")
        self.tags = tags | {name} if name in _KNOWN and name not in tags else tags
        new = {kind for w in words for kind in _KIND_OF.get(w, ())}
        self.kinds = kinds | new if new - kinds else kinds
        if name in BLOCKS:
            last, self.tag = (*last[-2:], name), name
        self.last = last
        self.hidden = hidden or (up.hidden if up else False)
        self.linked = name == "a" or (up.linked if up else False)
        self.article = name in ("article", "main") or (up.article if up else False)
        self.place = places.setdefault((up.place if up else 0, name), len(places) + 1)


class Block:
    """A leaf block: its text, how much of it is linked, and the innermost element that is open around it."""

    __slots__ = ("text", "linked", "at")

    def __init__(self, at: Open | None, text: str, linked: int):
        self.at, self.text, self.linked = at, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.at
        while at:
            out.append(at.name)
            at = at.up
        return tuple(reversed(out))

    @property
    def tag(self) -> str:
        return self.at.tag if self.at else ""

    @property
    def hidden(self) -> bool:
        return self.at is not None and self.at.hidden


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each dropped element of a name ends, by where it begins; those without an end tag aren't in it."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(rf"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\b|$)|<(/?){name}(?=[\s/>]|$)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", page, re.S | re.I):
        if m.group(3) is None:
            continue
        if m.group(2):
            if open_:
                out[open_.pop()] = m.end()
        elif not m.group(3).rstrip().endswith("/"):
            if name not in NESTED:
                open_.clear()
            open_.append(m.start())
    return out


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in its order, their character references decoded and white space normalised."""
    out: list[Block] = []
    stack: list[Open] = []
    count: Counter[str] = Counter()
    places: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    state = {"linked": 0}
    ends: dict[str, dict[int, int]] = {}
    held = None  # the place in the stack of a dropped element without an end tag

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(stack[-1] if stack else None, text, state["linked"]))
            parts.clear()
        state["linked"] = 0

    def push(name: str, words: tuple[str, ...] = (), hidden: bool = False) -> None:
        stack.append(Open(name, words, hidden, stack[-1] if stack else None, places))
        count[name] += 1

    def pop() -> Open:
        count[stack[-1].name] -= 1
        return stack.pop()

    def cut(k: int) -> None:
        while len(stack) > k:
            pop()

    def close(k: int) -> None:
        if any(stack[j].name in BLOCKS for j in range(k, len(stack))):
            flush()
        cut(k)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        begin, at = at, m.end()
        name = m.group(2)
        if name is None:
            raw = m.group()
            if held is None and (raw[0] != "<" or raw == "<"):
                text = _html.unescape(raw)
                parts.append(text)
                if stack and stack[-1].linked:
                    state["linked"] += len(text.strip())
            continue
        name = name.lower()
        if m.group(1):
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name) if count[name] else None
            if held is not None and k is not None and k <= held:
                cut(held)
                held = None
                if k == len(stack):
                    continue
            if k is not None and (name in BLOCKS or not any(stack[j].name in BLOCKS for j in range(k + 1, len(stack)))):
                close(k)
            elif k is not None:  # an inline element that a block has cut through
                above = stack[k + 1 :]
                cut(k)
                for e in above:
                    push(e.name, e.words, e.own_hidden)
            continue
        if held is not None:
            inside = stack[held].name
            if (name in BLOCKS and name not in STANDS.get(inside, ())) or (inside in ("svg", "math") and name in _BREAKOUT):
                cut(held)
                held = None
        if name == "head":  # what may stand in it is dropped by itself; anything else ends it
            continue
        if name in DROPPED:
            if name != "title" and held is None:
                parts.append(" ")
            if m.group(3).rstrip().endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if name not in ends:
                ends[name] = _ends(page, name)
            if begin in ends[name]:
                at = max(at, ends[name][begin])
            elif held is None:
                held = len(stack)
                push(name)
            continue
        if held is not None:
            if name not in VOID and name not in BLOCKS and not m.group(3).rstrip().endswith("/"):
                push(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
            while stack and stack[-1].name not in BLOCKS:  # an inline element doesn't go on into the next block
                pop()
            if name in _ENDS_P and stack and stack[-1].name == "p":
                pop()
            for other in CLOSES.get(name, ()):
                if stack and stack[-1].name == other:
                    pop()
        names, hidden = [], False
        if m.group(3):
            for a in _ATTRIBUTE.finditer(m.group(3)):
                kind, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                if kind in ("class", "id", "role"):
                    names += _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                elif kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true") or (kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    hidden = True
        if not m.group(3).rstrip().endswith("/") or name in BLOCKS:
            push(name, tuple(names), hidden)
    flush()
    return out


_KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip topbar",
    "head": "header masthead banner logo branding",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar side aside widget related recommended popular trending more tags rail",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay paywall newsletter subscribe signup promo banner",
    "ad": "ad ads advert advertisement adverts sponsored sponsor promoted dfp",
    "form": "form search login input field contact",
    "talk": "comment comments reply replies respond disqus discussion reactions",
    "share": "share sharing social follow buttons",
    "meta": "meta byline author date timestamp dateline",
    "main": "article content main post entry story body text prose markdown",
}
_KIND_OF = {}
for _kind, _words in _KINDS.items():
    for _w in _words.split():
        _KIND_OF.setdefault(_w, []).append(_kind)
_TAGS = "nav header footer aside form article main section table ul ol li p h1 h2 h3 h4 h5 h6 blockquote pre figcaption figure td dt dd div button label address body".split()
_KNOWN = frozenset(_TAGS)
_TALK = re.compile(r"\b(cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|privacy|terms|all rights reserved|advertisement|sponsored|share|comments?|reply|follow us|read more)\b|©", re.I)


def features_of(blocks: list[Block]) -> list[list[str]]:
    """The names of each block's features."""
    out = []
    for k, b in enumerate(blocks):
        f = ["bias", f"tag={b.tag}"]
        if b.at:
            f += [f"in={t}" for t in b.at.tags]
            for depth, t in enumerate(reversed(b.at.last)):
                f.append(f"up{depth}={t}")
            f += [f"kind={kind}" for kind in b.at.kinds]
        n = len(b.text)
        words = b.text.count(" ") + 1
        f.append(f"len={0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 300 else 4}")
        f.append(f"link={0 if not b.linked else 1 if b.linked < 0.3 * n else 2 if b.linked < 0.8 * n else 3}")
        ends = sum(b.text.count(c) for c in ".!?")
        f.append(f"stops={min(3, ends)}")
        f.append(f"last={b.text[-1] in '.!?…\"”»:'}")
        f.append(f"wording={bool(_TALK.search(b.text))}{words < 12}")
        if b.hidden:
            f.append("hidden")
        if not (b.at and b.at.article):
            f.append("outside")
        f.append(f"before={blocks[k - 1].tag == b.tag if k else 'first'}")
        f.append(f"same={(blocks[k - 1].at.place if blocks[k - 1].at else 0) == (b.at.place if b.at else 0) if k else 'first'}")
        out.append(f)
    return out


class Field:
    """The trained field: weights[feature] has one number per label (0 boilerplate, 1 content)."""

    def __init__(self, weights: dict[str, np.ndarray], turn: np.ndarray):
        self.weights, self.turn = weights, turn

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weights.get(f, zero) for f in row), zero) for row in feats]).reshape(-1, 2)

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not feats:
            return []
        e, t = self.emissions(feats).tolist(), self.turn.tolist()
        best, back = e[0], []
        for x, y in e[1:]:
            a0, a1 = best[0] + t[0][0], best[1] + t[1][0]
            b0, b1 = best[0] + t[0][1], best[1] + t[1][1]
            back.append((0 if a0 >= a1 else 1, 0 if b0 > b1 else 1))
            best = [max(a0, a1) + x, max(b0, b1) + y]
        label = 0 if best[0] > best[1] else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _gradient(e: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood: by the emissions and by the transitions."""
    n = len(y)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = e[0]
    for k in range(1, n):
        a[k] = np.logaddexp(a[k - 1][0] + t[0], a[k - 1][1] + t[1]) + e[k]
    for k in range(n - 2, -1, -1):
        x = t + e[k + 1] + b[k + 1]
        b[k] = np.logaddexp(x[:, 0], x[:, 1])
    z = np.logaddexp(*a[-1])
    one = np.zeros((n, 2))
    one[np.arange(n), y] = 1
    ge = one - np.exp(a + b - z)
    gt = np.zeros((2, 2))
    for k in range(1, n):
        gt[y[k - 1], y[k]] += 1
        gt -= np.exp(a[k - 1][:, None] + t + e[k] + b[k] - z)
    return ge, gt


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Stochastic gradient with averaging, over the pages in turn."""
    names = sorted({f for feats, _ in pages for row in feats for f in row})
    place = {f: i for i, f in enumerate(names)}
    coded = [([np.array([place[f] for f in row]) for row in feats], np.array(y)) for feats, y in pages if y]
    w, t, sw, st, steps = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((len(names), 2)), np.zeros((2, 2)), 0
    order = np.random.RandomState(5)
    for r in range(rounds):
        for k in order.permutation(len(coded)):
            rows, y = coded[k]
            e = np.array([w[row].sum(axis=0) for row in rows])
            ge, gt = _gradient(e, t, y)
            eta = rate / (1 + r)
            w *= 1 - eta * ridge
            for row, g in zip(rows, ge, strict=True):
                w[row] += eta * g
            t += eta * gt
            sw, st, steps = sw + w, st + t, steps + 1
    w, t = sw / max(1, steps), st / max(1, steps)
    return Field({f: w[i] for f, i in place.items()}, t)


class _Maker:
    """Lays out labelled pages. Content is written with the mark \\x01 before its text; the scan keeps it, labels are read from it."""

    def __init__(self, seed: int):
        self.r = np.random.RandomState(seed)

    def pick(self, *options):
        return options[self.r.randint(len(options))]

    def word(self) -> str:
        return "".join(self.pick(*"b d f g k l m n p r s t v z ch st tr".split()) + self.pick(*"a e i o u ai ou é ä".split()) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self, lo: int = 3, hi: int = 18) -> str:
        return self.words(lo, hi).capitalize() + self.pick(".", ".", ".", "!", "?")

    def prose(self, most: int = 7) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(1, most)))
        if self.r.rand() < 0.15:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.sentence()}'
        return text

    def wrap(self, inner: str, kind: str, tags: tuple[str, ...]) -> str:
        tag = self.pick(*tags)
        named = self.r.rand() < 0.75 or tag == "div"
        name = self.pick(*_KINDS[kind].split())
        extra = self.pick("", f"-{self.word()}", "-box", "-wrap")
        attribute = f' {self.pick("class", "class", "id")}="{name}{extra}"' if named else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, lo: int, hi: int) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.words(1, 4)}</a></li>' for _ in range(self.r.randint(lo, hi)))
        return f"<ul>{items}</ul>"

    def boilerplate(self) -> str:
        k = self.pick("menu", "head", "foot", "side", "notice", "ad", "form", "talk", "share")
        if k == "menu":
            return self.wrap(self.links(3, 9), k, ("nav", "nav", "div"))
        if k == "head":
            return self.wrap(f"<div><a href='/'>{self.words(1, 3)}</a></div><p>{self.words(2, 6)}</p>", k, ("header", "header", "div"))
        if k == "foot":
            return self.wrap(self.pick(f"&copy; {self.word()}.com &middot; {self.sentence()}", f"<p>© 2024 {self.words(1, 3)}. All rights reserved.</p>{self.links(2, 5)}", f"<p>{self.sentence()}</p><p>Privacy | Terms</p>"), k, ("footer", "footer", "div"))
        if k == "side":
            return self.wrap(f"<h3>{self.words(1, 3)}</h3>{self.links(2, 6)}" + self.pick("", f"<p>{self.prose(3)}</p>"), k, ("aside", "aside", "div", "section"))
        if k == "notice":
            return self.wrap(self.pick(f"<p>We use cookies. {self.sentence()}</p><button>Accept</button>", f"Subscribe to our newsletter. {self.sentence()}", f"<p>{self.prose(3)}</p><button>{self.words(1, 2)}</button>"), k, ("div", "div", "section", "aside"))
        if k == "ad":
            return self.wrap(self.pick(self.sentence(), f"<p>{self.prose(3)}</p>", f"<a href='/ad'>{self.words(2, 6)}</a>", "Advertisement"), k, ("div", "div", "aside", "section"))
        if k == "form":
            return f"<form>{self.pick('', '<label>' + self.words(1, 3) + '</label>')}<p>{self.words(2, 9)}</p><input type=text><button>{self.words(1, 2)}</button></form>"
        if k == "talk":
            each = "".join(f'<{t}{c}><b>{self.word()}</b><p>{self.prose(4)}</p></{t}>' for _ in range(self.r.randint(1, 4)) for t, c in [self.pick(("div", ' class="comment"'), ("li", ""), ("article", ' class="comment"'))])
            return self.wrap(f"<h3>{self.words(1, 2)}</h3>{each}", k, ("section", "div", "aside", "ol"))
        return self.wrap("".join(f"<a href='#'>{self.word()}</a> " for _ in range(3)), k, ("div", "ul"))

    def article(self) -> str:
        out = [f"<h1>\x01{self.words(2, 12).capitalize()}</h1>"] if self.r.rand() < 0.85 else []
        for _ in range(self.r.randint(1, 12)):
            k = self.r.randint(20)
            if k < 13:
                out.append(f"<p>\x01{self.prose()}" + self.pick("</p>", "</p>", "</p>", ""))
            elif k < 14:
                out.append(f"<p><b>\x01{self.prose()}<br><p>\x01{self.prose()}</p>")
            elif k < 15:
                out.append(f"<{(h := self.pick('h2', 'h3'))}>\x01{self.words(1, 7).capitalize()}</{h}>")
            elif k < 16:
                out.append(f"<blockquote>\x01{self.prose(3)}</blockquote>")
            elif k < 17:
                out.append("<ul>" + "".join(f"<li>\x01{self.pick(self.words(2, 9), self.sentence())}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif k < 18:
                out.append(f"<pre>\x01{self.words(3, 12)}</pre>")
            elif k < 19:
                out.append(f"<div>\x01{self.prose(4)}</div>")
            else:
                out.append(self.wrap(self.sentence(), "ad", ("div", "aside")))
        inner = "".join(out)
        style = self.r.randint(6)
        if style < 3:
            return f"<article>{inner}</article>"
        if style < 4:
            return f"<main>{inner}</main>"
        if style < 5:
            return self.wrap(inner, "main", ("div", "section"))
        return f"<main><article>{inner}</article></main>"

    def page(self) -> str:
        before = "".join(self.boilerplate() for _ in range(self.r.randint(0, 5)))
        after = "".join(self.boilerplate() for _ in range(self.r.randint(0, 5)))
        end = self.pick("</body></html>", "</body></html>", "")
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{before}{self.article()}{after}{end}"


def labelled(n: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    maker, out = _Maker(seed), []
    for _ in range(n):
        blocks = blocks_of(maker.page())
        y = [int("\x01" in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace("\x01", "")
        out.append((features_of(blocks), y))
    return out


@functools.cache
def field() -> Field:
    """The field that queries use; 500 labelled pages."""
    return train(labelled(500, 1))


def extract(page: str, f: Field) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, f.decode(features_of(blocks)), strict=True) if y)


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    ship(pages.sparkSession)
    trained = field()
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).where("page_id IS NOT NULL")

    def run(batches):
        for b in batches:
            texts = [extract(h, trained) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    work_dir(spark)
    return main_text(table(spark, sf_dir, "pages"))
