"""Main text of web pages by union-free wrapper inference.

Every page becomes a tree of block elements with text leaves. Pages of one host are aligned one after the other into a
wrapper, a regular expression without unions: where children agree they merge; a child that one side lacks becomes
optional; neighbours with the same element become a repeated group; text that differs becomes a slot, text that is always
the same stays a constant. Aligning is associative enough to run first inside the tasks that read the pages, then over the
partial wrappers of a host, so a host of any size costs a task only as many rows as there are partial wrappers.

The wrapper then tells main text from the rest. Outside articles, text that many of the host's pages of different content share at
one place (TEMPLATE_SHARE; also in optional and repeated groups) is template text and goes. On a page without an article (or main)
element the main region is where the text in the wrapper's slots is: from the root down, the block that holds most of the varying
text, as far as a repeated group or a place where no block holds most; headings on the way stay. In a page with such an element its
blocks stay, whatever its host's pages share, but for nested navigation, asides, forms, adverts and comments. Elsewhere blocks in
navigation, header, footer, aside, form and similar elements or classes go.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, write_shared

#: Depth of the tree; bounds recursion. Blocks opened below it become flat children of the deepest block, cut where another comes
#: between, and marked where a block around them holds no main text or is an article.
MAX_DEPTH = 40
#: Hosts whose wrappers a reading task holds before it hands them on.
HELD_HOSTS = 2000
#: Texts of pages that a reading task holds before it hands them on.
HELD_LEAVES = 100_000
#: Pages that must agree on a text outside articles before it counts as template text.
TEMPLATE_PAGES = 5
#: Share of a host's different pages (TEMPLATE_PAGES at least) on which a text stands at one place outside articles, as template text.
TEMPLATE_SHARE = 0.2
#: Longest texts that tell pages of different content apart; copies of a page count once.
TELLING = 3
#: Characters of a constant that a wrapper keeps.
CONSTANT_CHARS = 40
#: Cells of the table that aligns two lists of children; longer ones are aligned by halves.
LCS_CELLS = 1 << 20
#: Share of a block's varying text that one of its children must hold to be the main region's way down.
REGION_SHARE = 0.5
#: Bytes of wrappers that are broadcast; beyond it pages and wrappers are joined by host and salt.
BROADCAST_BYTES = 16 << 20
SALTS = 16

#: What may begin a tag or a comment, the first characters of a tag's name, and what may end or quote inside it.
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)(?=[a-zA-Z]))")
_NAME = re.compile(r"[^\s/>]{1,64}")
_SPECIAL = re.compile("[>\"']")
#: The rest of a usual tag: short, with few quoted values. Others take the longer way, to the same end.
_USUAL = re.compile(r"""[^"'>]{0,200}(?:"[^"]{0,200}"[^"'>]{0,200}){0,8}>""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset address details summary hgroup menu search dialog center".split())
_RAW = frozenset("script style noscript template textarea iframe svg select option button head title object canvas audio video datalist annotation annotation-xml".split())
_VOID = frozenset("br hr img input meta link source track wbr area base col embed param".split())
_ENDS_P = _BLOCK - {"html", "body"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
#: Elements that never hold main text, and words of class, id or role that say so.
_OUTSIDE = frozenset("nav header footer aside form fieldset menu dialog search address".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar side aside widget "
    "notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login form search comment comments reply replies discussion disqus respond "
    "share sharing social related recommended recommendations pagination pager toolbar copyright legal disclaimer complementary contentinfo dialog toc".split()
)
#: Parts of a class word that only say where or what kind of block one of _WORDS names: site-header, but not post-header or has-sidebar.
_PLAIN = frozenset("site global top bottom left right primary secondary list links link bar box block section area container wrapper wrap inner item items form".split())
#: Elements of headings, of running text, and of lists and tables.
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT = frozenset("p pre blockquote".split()) | _HEADING
_LISTED = frozenset("ul ol li dl dt dd table tbody tr td th".split())
#: Inside an article: elements that hold no text of it, blocks that one of _ASIDE may name, and those words. Its headings, paragraphs,
#: lists and its own sections stay, whatever they are called.
_NESTED = frozenset("nav aside form menu dialog search footer".split())
_NAMED = frozenset("div section ul ol aside table".split())
_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo banner navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "comment comments replies respond disqus share sharing social related recommended pagination pager toolbar".split()
)
#: Elements to which the words never apply.
_FRAME = frozenset("html body article main".split())


class Node:
    __slots__ = ("kids", "linked", "name", "sym", "text")

    def __init__(self, sym: str, text: str = "", linked: bool = False) -> None:
        self.sym, self.text, self.linked = sym, text, linked
        self.name = sym.partition(".")[0]
        self.kids: list[Node] = []


class _Tags:
    """Ends of tags in a page, each found in a few steps: a quote that is never closed, or a tag that never ends, is met once."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.special: list[int] | None = None
        self.quotes: dict[str, list[int]] = {}
        self.ends: dict[int, int] = {}  # of a scan that stands, outside quotes, before this special character
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """Place of the '>' that ends a tag from ``at`` on, outside quotes; -1: none."""
        if self.special is None:
            self.special = [m.start() for m in _SPECIAL.finditer(self.page)]
            for i in self.special:
                self.quotes.setdefault(self.page[i], []).append(i)
        met, found = [], -1
        while (k := bisect.bisect_left(self.special, at)) < len(self.special):
            i = self.special[k]
            if i in self.ends:
                found = self.ends[i]
                break
            met.append(i)
            if (quote := self.page[i]) == ">":
                found = i
                break
            places = self.quotes[quote]
            n = bisect.bisect_right(places, i)
            if n == len(places):
                break
            at = places[n] + 1
        for i in met:
            self.ends[i] = found
        return found

    def behind(self, name: str, at: int) -> int:
        """Place behind the end tag of a raw element; -1: none. An element without one is looked for once."""
        if name in self.unclosed:
            return -1
        for m in re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).finditer(self.page, at):
            if (end := self.page.find(">", m.end())) >= 0:
                return end + 1
            break
        self.unclosed.add(name)
        return -1


class _Stack:
    """Open blocks, with the places of each name's blocks, so that no tag walks through them."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.articles = [0]  # among the blocks up to each one

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.articles.append(self.articles[-1] + _is_article(node.sym))
        self.nodes.append(node)

    def cut(self, upto: int) -> None:
        while len(self.nodes) > upto:
            self.places[self.nodes.pop().name].pop()
            self.articles.pop()

    def last(self, name: str) -> int | None:
        """Place of the innermost open block of a name."""
        places = self.places.get(name)
        return places[-1] if places else None


def parse(page: str | None) -> Node:
    """Tree of block elements; text leaves have sym '#', references decoded and white space made single.

    Time is linear in the page but for the logarithm of a search, whatever is left open or nested in it. A '<' whose tag does not end is text.
    """
    root = Node("page")
    stack, parts, in_link, plain = _Stack(root), [], 0, False
    page = page or ""
    tags = _Tags(page)

    def flush() -> None:
        nonlocal parts, plain
        text = " ".join("".join(parts).split())
        if text:
            top = stack.nodes[-1]
            if len(stack.nodes) > MAX_DEPTH:
                below, flat = stack.nodes[MAX_DEPTH - 1].kids, top.kids
                if not (below and flat and below[-1] is flat[-1]):
                    flat.append(Node(top.text))
                    below.append(flat[-1])
                top = flat[-1]
            top.kids.append(Node("#", text, not plain))
        parts, plain = [], False

    def close(upto: int) -> None:
        flush()
        stack.cut(upto)

    def say(raw: str) -> None:
        nonlocal plain
        if raw:
            parts.append(raw)
            if not in_link and not raw.isspace():
                plain = True

    at = text_from = 0
    last_end = page.rfind(">")
    pending: list[str] = []  # text whose references are decoded together, so that a '<' in it changes nothing

    def spoken() -> None:
        if pending:
            say(html_lib.unescape("".join(pending)))
            pending.clear()

    while m := _OPEN.search(page, at):
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif m.end() > last_end:
            end = 0
        elif m[1] is None:
            end = page.find(">", m.end()) + 1
        else:
            word = _NAME.match(page, m.end())
            usual = _USUAL.match(page, word.end())
            close_at = usual.end() - 1 if usual else tags.end(word.end())
            end = close_at + 1
        if not end:
            at = m.end()  # text, like what is before it
            continue
        pending.append(page[text_from : m.start()])
        spoken()
        at = text_from = end
        if m[1] is None:
            continue
        name, closing, attributes = word[0].lower(), bool(m[1]), page[word.end() : close_at]
        if name in _RAW and not closing:
            if not attributes.endswith("/"):
                behind = tags.behind(name, at)
                at = text_from = behind if behind >= 0 else (len(page) if name in ("script", "style") else at)
        elif name in ("br", "hr"):
            parts.append(" ")
        elif name == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        elif name in _BLOCK:
            if closing:
                if (place := stack.last(name)) is not None:
                    close(place)
                else:
                    flush()
                in_link = 0
            else:
                if name in ("html", "body") and stack.last(name) is not None:
                    continue
                flush()
                if name in _ENDS_P and (place := stack.last("p")) is not None:
                    close(place)
                if stack.nodes[-1].name in _SELF.get(name, ()):
                    close(len(stack.nodes) - 1)
                words = " ".join(v.strip("\"'") for _, v in _ATTR.findall(attributes)).lower() if attributes else ""
                tokens = {"-".join(re.findall("[a-z]+", w)) for w in words.split()} - {""} if name not in _FRAME else ()
                node = Node(f"{name}.{'.'.join(sorted(tokens))}" if tokens else name)
                if len(stack.nodes) < MAX_DEPTH:
                    stack.nodes[-1].kids.append(node)
                else:
                    node.text, node.linked = _flat_sym(node.sym, stack)
                stack.push(node)
    pending.append(page[text_from:])
    spoken()
    flush()
    return root


def _flat_sym(sym: str, stack: _Stack) -> tuple[str, bool]:
    """What a block below MAX_DEPTH counts as, by itself and the blocks around it, and whether that is outside the main text."""
    top = stack.nodes[-1]
    if len(stack.nodes) > MAX_DEPTH and top.linked:
        return top.text, True
    if _outside(sym, stack.articles[-1] > 0):
        return sym, True
    return ("article" if stack.articles[-1] > stack.articles[MAX_DEPTH - 1] else sym), False


# A wrapper node is [sym, mode, pages, text, kids, kind]: mode '1' once, '?' optional, '+' repeated, '*' both; text of a leaf is its
# constant or None for a slot. A page's own tree is a wrapper without optional or repeated parts: these come from mismatches.
def _wrap(node: Node) -> list:
    if node.sym == "#":
        return ["#", "1", 1, _constant(node.text), [], "#"]
    kids = [_wrap(k) for k in node.kids]
    return [node.sym, "1", 1, None, kids, _kind(node.sym, kids)]


def _constant(text: str) -> str:
    """A text as a wrapper keeps it: long ones as their beginning and a digest, so a wrapper grows with the elements, not with the texts."""
    return text if len(text) <= CONSTANT_CHARS else f"{text[:CONSTANT_CHARS]}...{_key(text):016x}"


def _kind(sym: str, kids: list[list]) -> str:
    """What children are aligned by: the element, and whether it holds text alone. Merging changes no node's kind."""
    return sym if any(k[0] != "#" for k in kids) else f"{sym} #"


def _alike(a: list, b: list) -> bool:
    """Whether neighbours can be two turns of a repeated group: same kind, and mostly the same elements inside."""
    if a[5] != b[5]:
        return False
    x, y = {k[0] for k in a[4]}, {k[0] for k in b[4]}
    return not (x or y) or 2 * len(x & y) >= len(x | y)


def _gather(kids: list[list], groups: list[list]) -> list[tuple[list, list[int]]]:
    """Children with their numbers, runs of neighbours that are like one of the ``groups`` as one."""
    if not groups:
        return [(k, [i]) for i, k in enumerate(kids)]
    out: list[tuple[list, list[int]]] = []
    last: list | None = None
    for i, k in enumerate(kids):
        group = next((g for g in groups if _alike(g, k)), None)
        if out and group is not None and group is last:
            out[-1] = (_turn(out[-1][0], k), [*out[-1][1], i])
        else:
            out.append((k, [i]))
        last = group
    return out


def _turn(a: list, b: list) -> list:
    """Two neighbours as turns of one repeated group."""
    return [a[0], _join(_join("1" if a[1] == "?" else a[1], "1" if b[1] == "?" else b[1]), "+"), max(a[2], b[2]), a[3] if a[3] == b[3] else None, align(a[4], b[4]), a[5]]


def _join(a: str, b: str) -> str:
    if a == b:
        return a
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[a in "?*" or b in "?*", a in "+*" or b in "+*"]


def _merge(a: list, b: list) -> list:
    """Two wrappers of the same element as one."""
    return [a[0], _join(a[1], b[1]), a[2] + b[2], a[3] if a[3] == b[3] else None, align(a[4], b[4]), a[5]]


def _rows_of(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Lengths of the longest common subsequence of the first i of ``x`` and the first j of ``y``, for i = 0, 1, ..."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    yield row
    for s in x:
        new = row.copy()
        np.maximum(new[1:], row[:-1] + (y == s), out=new[1:])
        row = np.maximum.accumulate(new)
        yield row


def _common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places; of long sequences by halves, so the table stays small."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > LCS_CELLS:
        half = len(x) // 2
        for front in _rows_of(x[:half], y):
            pass
        for behind in _rows_of(x[half:][::-1], y[::-1]):
            pass
        k = int(np.argmax(front + behind[::-1]))
        return _common(x[:half], y[:k]) + [(half + i, k + j) for i, j in _common(x[half:], y[k:])]
    rows, out = list(_rows_of(x, y)), []
    i, j = len(x), len(y)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, after equal ends."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    ends = [(k, k) for k in range(lo)], [(ha + k, hb + k) for k in range(len(a) - ha)]
    if lo == ha or lo == hb:
        return ends[0] + ends[1]
    names = {s: i for i, s in enumerate(sorted({*a[lo:ha], *b[lo:hb]}))}
    x, y = (np.array([names[k] for k in part], dtype=np.int32) for part in (a[lo:ha], b[lo:hb]))
    return ends[0] + [(lo + i, lo + j) for i, j in _common(x, y)] + ends[1]


def _matched(a: list[list], b: list[list]) -> tuple[list[tuple[list, list[int]]], list[tuple[list, list[int]]], list[tuple[int, int]]]:
    """Children of both sides, those that repeated groups of the other side take up gathered, and which of them agree."""
    x = _gather(a, [k for k in b if k[1] in "+*"])
    y = _gather(b, [k for k in a if k[1] in "+*"])
    return x, y, _pairs([k[5] for k, _ in x], [k[5] for k, _ in y])


def _same(a: list[list], b: list[list]) -> bool:
    """Whether children agree one by one, and no group of the one could take up more of the other."""
    return len(a) == len(b) and all(x[5] == y[5] and x[1] not in "+*" and y[1] not in "+*" for x, y in zip(a, b, strict=True))


def align(a: list[list], b: list[list]) -> list[list]:
    """Children of two wrappers: agreeing ones merge; one that only one side has becomes another turn of its neighbour if they are alike, or optional."""
    if _same(a, b):
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    x, y, pairs = _matched(a, b)
    out: list[tuple[list, bool]] = []  # child, whether only one side has it
    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        out += [(k, True) for k, _ in x[i:p]] + [(k, True) for k, _ in y[j:q]]
        if p < len(x):
            out.append((_merge(x[p][0], y[q][0]), False))
        i, j = p + 1, q + 1
    return _refold(out)


def _refold(kids: list[tuple[list, bool]]) -> list[list]:
    out: list[tuple[list, bool]] = []
    for k, odd in kids:
        if out and (odd or out[-1][1]) and _alike(out[-1][0], k):
            other, was = out[-1]
            made = _turn(other, k)
            both = odd and was
            out[-1] = ([made[0], _join(made[1], "?") if both else made[1], *made[2:]], both)
        elif odd and len(out) > 1 and _alike(out[-2][0], k) and not _alike(out[-1][0], k) and out[-1][1] and len(out) > 2 and _alike(out[-3][0], out[-1][0]):
            # elements that alternate, as terms and definitions do
            last = out.pop()
            out[-1] = (_turn(out[-1][0], k), False)
            out[-2] = (_turn(out[-2][0], last[0]), False)
        else:
            out.append((k, odd))
    return [[k[0], _join(k[1], "?"), *k[2:]] if odd else k for k, odd in out]


def infer(pages: list[str | None]) -> list:
    """Wrapper of one host's pages."""
    now = None
    for p in pages:
        w = _wrap(parse(p))
        now = w if now is None else _merge(now, w)
    return now if now is not None else _wrap(Node("page"))


def to_regex(w: list) -> str:
    """The wrapper as a union-free regular expression over elements, constants and #text slots."""
    name = w[0]
    inner = "".join(map(to_regex, w[4]))
    body = (w[3] if w[3] is not None else "#text") if name == "#" else f"<{name}>{inner}</{name.partition('.')[0]}>"
    return body if w[1] == "1" else f"({body}){w[1]}"


@functools.lru_cache(1 << 14)
def _outside(sym: str, in_article: bool) -> bool:
    name, _, words = sym.partition(".")
    if in_article:
        return name in _NESTED or name in _NAMED and any(all(x in _ASIDE or x in _PLAIN for x in t.split("-")) and any(x in _ASIDE for x in t.split("-")) for t in words.split("."))
    if name in _OUTSIDE:
        return True
    return any(_names_outside(x) for x in words.split(".")) if words and name not in _FRAME else False


def _names_outside(token: str) -> bool:
    """Whether a whole class word names a block outside: every part of it is one of _WORDS or plain, one at least of _WORDS."""
    parts = token.split("-")
    return any(x in _WORDS for x in parts) and all(x in _WORDS or x in _PLAIN for x in parts)


@functools.lru_cache(1 << 14)
def _is_article(sym: str) -> bool:
    name, _, words = sym.partition(".")
    return name in ("article", "main") or "main" in words.split(".")


def _has_article(w: list, anywhere: bool = False) -> bool:
    """Whether an article is at or below a node: outside of blocks that hold no main text, or ``anywhere``."""
    return _is_article(w[0]) or any(_has_article(k, anywhere) for k in w[4] if anywhere or not _outside(k[0], False))


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def leaf_keys(root: Node) -> tuple[set[int], int]:
    """Place and text of each leaf outside articles as a key, and a key of the page's content."""
    keys: set[int] = set()
    texts: set[str] = set()
    todo = [(root, "", False)]
    while todo:
        node, place, inside = todo.pop()
        inside = inside or _is_article(node.sym)
        for k in node.kids:
            if k.sym == "#":
                if not inside:
                    keys.add(_key(place, k.text))
                texts.add(k.text)
            else:
                todo.append((k, f"{place}/{k.sym}", inside))
    return keys, _key(*sorted(texts, key=lambda t: (-len(t), t))[:TELLING])


def extract(page: str | None, wrapper: list, shared: frozenset[int] = frozenset()) -> str:
    """Main text of a page of the wrapper's host: kept blocks in page order, two line ends between them.

    ``shared`` has the keys of the host's template text (see leaf_keys).
    """
    root = parse(page)
    own = _wrap(root)
    only_article = _has_article(own)
    hidden = not only_article and _has_article(own, True)  # all articles are in blocks that the words tell outside: such a block stays
    only_article = only_article or hidden
    places: dict[int, list | None] = {}  # wrapper node of each block and leaf
    mass: dict[int, int] = {}  # characters of varying text, without links, in each block
    common: set[int] = set()  # leaves of the host's template text

    def place_all(node: Node, mine: list, w: list | None, place: str) -> int:
        where, total = {} if w is None else _places(mine[4], w[4]), 0
        for i, k in enumerate(node.kids):
            known = places[id(k)] = where.get(i)
            if k.sym != "#":
                below = place_all(k, mine[4][i], known, f"{place}/{k.sym}" if shared else "")
                total += 0 if _outside(k.sym, False) else below
            elif shared and _key(place, k.text) in shared:
                common.add(id(k))
            elif not k.linked and (known is None or known[3] is None):
                total += len(k.text)
        mass[id(node)] = total
        return total

    place_all(root, own, wrapper, "")
    region, heads = (None, set()) if only_article or wrapper[2] < 2 else _region(root, places, mass)
    out: list[str] = []

    def walk(node: Node, inside: bool, within: bool) -> None:
        inside, within = inside or _is_article(node.sym), within or node is region or id(node) in heads
        listed = node.name in _LISTED
        for k in node.kids:
            if k.sym == "#":
                linked = k.linked and not inside and (region is None or listed)
                wanted = inside or (within if region is not None else not only_article)
                if wanted and not linked and (inside or id(k) not in common):
                    out.append(k.text)
            elif not _outside(k.sym, inside) or hidden and not inside and _has_article(_wrap(k), True):
                walk(k, inside, within)

    walk(root, False, False)
    return "\n\n".join(out)


def _region(root: Node, places: dict[int, list | None], mass: dict[int, int]) -> tuple[Node | None, set[int]]:
    """Block that holds the main text of a page without an article, and the headings before it on the way down."""
    if not mass[id(root)]:
        return None, set()
    node, heads = root, set()
    while True:
        best = max((k for k in node.kids if id(k) in mass), key=lambda k: mass[id(k)], default=None)
        known = None if best is None else places[id(best)]
        if best is None or mass[id(best)] <= REGION_SHARE * mass[id(node)] or known is None or known[1] in "+*" or best.name in _TEXT:
            return node, heads
        for k in node.kids:
            if k is best:
                break
            if k.name in _HEADING:
                heads.add(id(k))
        node = best


def _places(kids: list[list], wrapped: list[list]) -> dict[int, list]:
    """Wrapper node of each child: aligned as in inference; what is left over goes to a group that it is like."""
    if _same(kids, wrapped):
        return dict(enumerate(wrapped))
    x, y, pairs = _matched(kids, wrapped)
    out = {i: y[q][0] for p, q in pairs for i in x[p][1]}
    groups = [k for k in wrapped if k[1] in "+*"]
    for i, k in enumerate(kids):
        if i not in out and (group := next((g for g in groups if _alike(g, k)), None)) is not None:
            out[i] = group
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` of every host of two pages or more: JSON of its wrapper and of the keys of its template text."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, list] = {}
        leaves: set[tuple[str, int, int]] = set()
        schema = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string()), ("leaf", pa.int64()), ("content", pa.int64())])

        def hand_on() -> pa.RecordBatch:
            rows = [(h, salt, json.dumps(w), None, None) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        def hand_leaves() -> pa.RecordBatch:
            rows = [(h, None, None, *r) for h, *r in leaves]
            leaves.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in slices(batches):
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page)
                h, w = host_of(url), _wrap(root)
                held[h] = _merge(held[h], w) if h in held else w
                keys, content = leaf_keys(root)
                leaves.update((h, key, content) for key in keys)
                leaves.add((h, 0, content))  # the page itself
                if len(leaves) >= HELD_LEAVES:
                    yield hand_leaves()
                if len(held) >= HELD_HOSTS:
                    yield hand_on()
        yield hand_on()
        yield hand_leaves()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:  # parts in the order of their text, so of any arrival
        parts = sorted(pdf["wrapper"])
        now = json.loads(parts[0])
        for p in parts[1:]:
            now = _merge(now, json.loads(p))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(now)], "pages": [now[2]]})

    part = map_arrow(pages.select("url", F.col("html").cast("string").alias("html")), local, "host string, salt int, wrapper string, leaf long, content long")
    part = write_shared(part, "host-parts")
    once = part.where("wrapper is not null").groupBy("host", "salt").applyInPandas(fold, "host string, wrapper string, pages long")
    whole = once.groupBy("host").applyInPandas(fold, "host string, wrapper string, pages long").where("pages > 1").withColumn("hk", F.xxhash64("host"))
    seen = part.where("leaf is not null").select(F.xxhash64("host").alias("hk"), "leaf", "content").distinct().groupBy("hk", "leaf").agg(F.count("*").alias("n"))
    often = seen.where(F.col("n") >= TEMPLATE_PAGES)  # a host of fewer pages has no template text
    total = often.where("leaf = 0").select("hk", F.col("n").alias("total"))
    shared = often.where("leaf <> 0").join(total, "hk").where(F.col("n") >= TEMPLATE_SHARE * F.col("total")).groupBy("hk").agg(F.collect_set("leaf").alias("shared"))
    keys = F.coalesce(F.concat_ws(",", F.col("shared").cast("array<string>")), F.lit(""))
    return whole.join(shared, "hk", "left").select("host", F.concat(F.lit("["), "wrapper", F.lit(",["), keys, F.lit("]]")).alias("wrapper"))


def _read(raw: str | None) -> tuple[list, frozenset[int]]:
    """Wrapper and template text of a host; none: those of a single page, which tell nothing."""
    if raw is None:
        return _wrap(Node("page")), frozenset()
    wrapper, shared = json.loads(raw)
    return wrapper, frozenset(shared)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, one row per input row.

    Null html counts as empty and gives the empty text; a null or odd url belongs to the host ''. Null ids and repeated rows
    are kept. Other columns are ignored. An empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    wrappers = write_shared(host_wrappers(pages), "host-wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64).alias("n")).first()["n"] or 0

    def rows(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    schema = "page_id long, url string, text string, n_chars long"
    if size <= BROADCAST_BYTES:
        table = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read: dict[str, tuple] = {}
            for batch in slices(batches):
                urls, texts = batch.column(1).to_pylist(), []
                for url, page in zip(urls, batch.column(2).to_pylist(), strict=True):
                    h = host_of(url)
                    if h not in read:
                        if len(read) >= HELD_HOSTS:
                            read.clear()
                        read[h] = _read(table.value.get(h))
                    texts.append(extract(page, *read[h]))
                yield rows(batch.column(0).to_pylist(), urls, texts)

        return map_arrow(pages, apply, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, tuple] | None = None
        for batch in slices(batches):
            urls, texts = batch.column(1).to_pylist(), []
            for page, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last is None or last[0] != raw:
                    last = (raw, _read(raw))
                texts.append(extract(page, *last[1]))
            yield rows(batch.column(0).to_pylist(), urls, texts)

    host = F.udf(host_of, "string", useArrow=True)("url")
    left = pages.withColumn("host", host).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    right = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return map_arrow(left.join(right, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper"), joined, schema)
