"""Main text of web pages by wrappers: union-free regular expressions learned for each host.

A page is read as a stream of tokens: tags and texts. Two streams of a host are aligned from
left to right. Where texts differ, the wrapper gets a text slot. Where tags differ, a square
that repeats what came before becomes a repeated group, and a part that one stream lacks
becomes an optional one; neither needs alternatives, so the wrapper stays free of unions.
The wrapper of some pages of a host is aligned with one page after another and grows more
general. Pages that a host's wrapper does not match are aligned with it in rounds, until it
matches all of them. Where a host's pages differ so much that some are left after the rounds, those
are dealt into parts; every part widens a copy of the host's wrapper until it matches all of its
pages. So each page that was learned from is matched by a wrapper of its host.

Every text of a wrapper (a slot, or a text that never changes) is given a role by where it
stands in the wrapper, and whether it varies over the host's pages. A page is matched against its
host's wrapper, which tells what of its texts varies; their roles are those on the page's own way
through the wrapper, since an optional part that the page lacks may open an element that another
one closes. A page that was not learned from and that the wrapper does not match is its own wrapper. Elements such as ``nav`` are furniture and ``article`` and ``main`` are
main regions by themselves. Names in ``class``, ``id`` and ``role`` are hints only: where a page has no
main region outside elements with furniture names, its texts decide which of those names to
believe. An element whose name speaks of furniture but which holds the page's only ``article``, or most
of its text that varies over the host and is no link, is no furniture (see ``disbelieved``).
Of a host's pages without a main region, texts that stand in the same place on every
page are furniture, whether the wrapper matches or not. These constants are counted over all
pages of the host, copies once, and never take the last text of a page.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gleanworks.llm.arrow import map_batches
from gleanworks.session import staged, table

# ------------------------------------------------------------------ fixed values
#: Elements without content, whose start tag is all there is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
#: Elements that stand within a line: no white space at their borders.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text.
OUTSIDE = frozenset("nav header footer aside button select option dialog menu script style noscript template textarea head title iframe object svg canvas audio video noembed noframes xmp".split())
#: Elements that an article keeps its own of: a header or footer inside it is a part of it no more than outside.
MAIN = frozenset(("article", "main"))
#: Names in class, id or role of what is not main text, whatever it holds: adverts, notices, readers' words, other articles.
OTHERS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription"
    " signup comment comments respond discussion disqus reply replies reviews related recommended recommendations".split()
)
#: Names of the parts around main text.
AROUND = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside header masthead topbar footer foot copyright overlay login share sharing social widget toolbar"
    " pager pagination skip search form complementary contentinfo".split()
)
#: Names of main text.
CONTENT = frozenset("article main content post entry story body articlebody".split())
#: First parts of names that tell a state of an element, not what it is.
STATES = frozenset("with without has have no not is are hide hides show shows".split())
#: Elements that hold running text.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())
#: Start tags that close an open p.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tags that close an open element of their own kind or of another one.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

FURNITURE = OTHERS | AROUND
_P_BARRIERS = frozenset("article main section div td li body button".split())
_ITEM_BARRIERS = frozenset("ul ol dl table select".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def tokens_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page: kind is ``text``, ``open`` or ``close``; rest is the text or the attributes."""
    at, n = 0, len(page)
    while at < n:
        found = _MARKUP.search(page, at)
        if found is None:
            yield "text", "", page[at:]
            return
        if found.start() > at:
            yield "text", "", page[at : found.start()]
        at = found.end()
        name = found[2]
        if name is None:
            if found[0].startswith("<![CDATA["):
                yield "text", "", found[0][9:].removesuffix("]]>")
            continue
        name = name.lower()
        if found[1]:
            yield "close", name, ""
            continue
        rest = found[3]
        yield "open", name, rest
        if name in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None:
                return  # unclosed script or style: nothing of it is text
            yield "text", "", page[at : end.start()]
            yield "close", name, ""
            at = end.end()
        elif rest.endswith("/") and name not in VOID:
            yield "close", name, ""


def _mark(name: str) -> str | None:
    """A name as it tells of an element: whole (``comments``) or by its last part (``-comments``).

    What only stands before another part tells nothing (``comments-open``), nor do states
    (``with-sidebar``); main text of furniture (``comment-body``) is furniture by that name.
    """
    parts = [w.lower() for w in _WORD.findall(name)]
    if not parts or (len(parts) > 1 and parts[0] in STATES):
        return None
    last = parts[-1]
    if last in CONTENT and len(parts) > 1 and (first := [w for w in parts if w in FURNITURE]):
        return f"-{first[-1]}"
    if last in FURNITURE or last in CONTENT:
        return last if len(parts) == 1 else f"-{last}"
    return None


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[str, ...]:
    """What class, id and role tell, ``=`` before roles; ``~`` for hidden elements."""
    marks: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden":
            if key == "hidden" or value == "true":
                marks.add("~")
        else:
            marks.update(("=" + m if key == "role" else m) for name in value.split() if (m := _mark(name)))
    return tuple(sorted(marks))


#: Roles of a text by its elements: main text, never main text, in an element with a name of main text,
#: or of furniture; and, told by a wrapper, different from page to page.
MAIN_ROLE, OUTSIDE_ROLE, HINT_ROLE, DOUBT_ROLE, VARIES = 1, 2, 4, 8, 16
#: What an element tells by itself: nothing, main text, a name of main text, furniture; and furniture by a
#: name or a form, in doubt from least to most believed.
_NOTHING, _IS_MAIN, _HINTS, _IS_OUTSIDE, _PARTLY, _NAMED, _CERTAIN = range(7)


@lru_cache(maxsize=8192)
def _element_of(item: str) -> tuple[str, int]:
    """The name of a start tag's item, and what it tells."""
    name, *marks = item.split(".")
    plain = [m.lstrip("=") for m in marks]
    if name in ("html", "body"):
        return name, _NOTHING
    if "~" in marks or (name in OUTSIDE and name != "header"):
        return name, _IS_OUTSIDE
    whole, last = {m for m in plain if m[0] != "-"}, {m[1:] for m in plain if m[0] == "-"}
    others = (whole | last) & OTHERS
    if (name in MAIN or "=article" in marks or "=main" in marks) and not others:
        return name, _IS_MAIN
    if name == "header":
        return name, _IS_OUTSIDE
    if whole & OTHERS:
        return name, _CERTAIN
    if whole & CONTENT or (last & CONTENT and not whole & FURNITURE):
        return name, _PARTLY if whole & FURNITURE or (last & FURNITURE and not whole & CONTENT) else _HINTS
    if whole & FURNITURE:
        return name, _NAMED
    return name, _PARTLY if others or last & FURNITURE or name == "form" else _NOTHING


def read_page(page: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(items, texts): ("tag", name and marks) and ("text", "") in turn, and the texts in turn."""
    items, texts = [], []
    for kind, name, rest in tokens_of(page):
        if kind == "text":
            items.append(("text", ""))
            texts.append(rest)
        elif kind == "close":
            items.append(("tag", "/" + name))
        else:
            items.append(("tag", ".".join((name, *_marks(rest))) if rest else name))
    return items, texts


class Places:
    """The open elements while items pass by; those numbered in ``doubted`` are not taken for furniture."""

    def __init__(self, doubted: frozenset[int] = frozenset()) -> None:
        self.stack: list[tuple[str, int, int, int]] = []  # name, role, what it tells, number
        self.breaks = True
        self.doubted = doubted
        self.opened = 0

    def tag(self, item: str) -> None:
        if item[0] == "/":
            name = item[1:]
            self.breaks |= name not in INLINE
            _close(self.stack, name, frozenset())
            return
        name, tells = _element_of(item)
        if name in CLOSES_P:
            _close(self.stack, "p", _P_BARRIERS)
        for other in CLOSES.get(name, ()):
            _close(self.stack, other, _ITEM_BARRIERS)
        self.breaks |= name not in INLINE
        if name in VOID:
            return
        role = self.stack[-1][1] if self.stack else 0
        if tells == _IS_OUTSIDE:
            if name != "header" or not role & MAIN_ROLE or "~" in item:  # an article's own header holds its title
                role |= OUTSIDE_ROLE
        elif tells >= _PARTLY:
            if self.opened not in self.doubted:
                role |= DOUBT_ROLE
        elif tells == _IS_MAIN:
            role |= MAIN_ROLE
        elif tells == _HINTS:
            role |= HINT_ROLE
        self.stack.append((name, role, tells, self.opened))
        self.opened += 1

    def text(self) -> tuple[int, bool]:
        """The role of a text here, and whether a block border stands before it."""
        broken, self.breaks = self.breaks, False
        return (self.stack[-1][1] if self.stack else 0), broken

    def path(self) -> str:
        """The names of the open elements that are no part of a line."""
        return "/".join(name for name, *_ in self.stack if name not in INLINE)


def is_main(role: int) -> bool:
    """In a main region, and not among furniture there or around."""
    return role & (MAIN_ROLE | OUTSIDE_ROLE | DOUBT_ROLE) == MAIN_ROLE


def is_outside(role: int) -> bool:
    return bool(role & (OUTSIDE_ROLE | DOUBT_ROLE))


def disbelieved(items: list[tuple[str, str]], weights: list[float]) -> frozenset[int]:
    """The numbers of elements with furniture names, and forms, that are taken for page frames instead.

    For pages whose main regions all lie in such elements, or that have none. ``weights`` has a
    number for each text, 0 for blank ones. With main regions, the outermost element that holds the most
    of their text is meant, and those inside it around the region. Without, an element has to
    hold at least half of the text (half of the text of forms has to be running text, too), or nine
    tenths where its whole name is that of a page part, or be the largest where no text is left. Text in
    links and in elements such as ``nav`` counts for nothing. Names of adverts, notices and
    readers' words are always believed.
    """
    places, told = Places(), iter(weights)
    texts: list[tuple[float, list[tuple[str, int, int, int]]]] = []
    for kind, tag in items:
        if kind == "tag":
            places.tag(tag)
        elif (weight := next(told)) > 0 and not any(t == _IS_OUTSIDE and r & OUTSIDE_ROLE for _, r, t, _ in places.stack):
            texts.append((0.0 if any(e[0] == "a" for e in places.stack) else weight, list(places.stack)))
    doubts = [(weight, [e for e in stack if e[2] >= _PARTLY], stack) for weight, stack in texts]
    chains: dict[int, float] = {}
    around: dict[int, set[int]] = {}
    for weight, held, stack in doubts:
        if held and any(e[2] == _IS_MAIN for e in stack) and all(e[2] != _CERTAIN for e in held):
            inner = max(k for k, e in enumerate(stack) if e[2] == _IS_MAIN)
            chain = [e[3] for k, e in enumerate(stack) if e[2] >= _PARTLY and k < inner]
            if len(chain) == len(held):  # else it is furniture of the region itself
                chains[chain[0]] = chains.get(chain[0], 0.0) + weight
                around.setdefault(chain[0], set()).update(chain)
    if chains:
        return frozenset(around[max(chains, key=lambda k: (chains[k], -k))])
    total = sum(weight for weight, _, _ in doubts)
    inside: dict[int, float] = {}
    running: dict[int, float] = {}
    tells: dict[int, tuple[str, int]] = {}
    left = 0.0
    for weight, held, stack in doubts:
        certain = any(e[2] == _CERTAIN for e in held)
        left += weight if not held else 0.0
        for e in held if not certain else ():
            tells[e[3]] = e[0], e[2]
            inside[e[3]] = inside.get(e[3], 0.0) + weight
            if any(x[0] in RUNNING or x[2] == _HINTS for x in stack[stack.index(e) + 1 :]):
                running[e[3]] = running.get(e[3], 0.0) + weight
    page = {k for k, (name, _) in tells.items() if name != "form" or 2 * running.get(k, 0.0) >= inside[k] > 0}
    out = {k for k in page if inside[k] > 0 and inside[k] >= (0.9 if tells[k][1] == _NAMED else 0.5) * total}
    if not out and not left and page and max(inside[k] for k in page) > 0:
        most = max(page, key=lambda k: (inside[k], -k))
        out = {k for _, held, _ in doubts if any(e[3] == most for e in held) for e in held if (k := e[3]) in page and inside[k] >= inside[most]}
    return frozenset(out)


def _close(stack: list, name: str, barriers: frozenset[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == name:
            del stack[k:]
            return
        if stack[k][0] in barriers:
            return


# ------------------------------------------------------------------ wrappers
# A wrapper is a list of items: ("tag", name), ("text", hash), ("slot",), ("plus", items), ("maybe", items)

SLOT = ("slot",)
#: How deep groups nest.
DEPTH = 3


def stream_of(items: list[tuple[str, str]], texts: list[str]) -> list[tuple]:
    """The items that wrappers are learned from: tags, and hashes of texts that are not blank."""
    out: list[tuple] = []
    told = iter(texts)
    for item in items:
        if item[0] == "tag":
            out.append(item)
        else:
            text = " ".join(next(told).split())
            if text:
                out.append(("text", xxh3_64_intdigest(text) & 0x7FFFFFFFFFFFFFFF))
    return out


def _match(item: tuple, stream: list[tuple], at: int) -> int | None:
    """Where the stream stands after an item, or None."""
    kind = item[0]
    if kind in ("tag", "text"):
        return at + 1 if at < len(stream) and stream[at] == item else None
    if kind == "slot":
        return at + 1 if at < len(stream) and stream[at][0] == "text" else at
    if kind == "maybe":
        end = _match_all(item[1], stream, at)
        return at if end is None else end
    end = _match_all(item[1], stream, at)
    if end is None:
        return None
    while True:
        more = _match_all(item[1], stream, end)
        if more is None or more == end:
            return end
        end = more


def _match_all(items, stream: list[tuple], at: int) -> int | None:
    for item in items:
        at = _match(item, stream, at)
        if at is None:
            return None
    return at


def _square(tail: list[tuple], stream: list[tuple], at: int, depth: int) -> tuple[int, list[tuple], int] | None:
    """A repetition: what the wrapper ends with stands once more in the stream.

    Looks for the last tag before the mismatch further on in the stream; the part up to it is
    a candidate square, which has to match the wrapper's end, read backwards.
    """
    if not tail or at >= len(stream) or stream[at][0] != "tag" or depth >= DEPTH:
        return None
    last = tail[-1]
    if last[0] != "tag":
        return None
    for end in range(at, len(stream)):
        if stream[end] == last:
            part = stream[at : end + 1]
            if len(part) < 2 or len(part) > len(tail):
                if len(part) > len(tail):
                    break
                continue
            old = tail[len(tail) - len(part) :]
            if all(a == b or (a[0] in ("text", "slot") and b[0] == "text") for a, b in zip(old, part, strict=True)):
                merged = [a if a == b else SLOT for a, b in zip(old, part, strict=True)]
                return len(part), merged, end + 1
    # elements of one name that differ inside
    end = _element(stream, at)
    size = _element_before(tail)
    if end is None or not size or tail[-size] != stream[at] or stream[end - 1] != last:
        return None
    old, part = tail[len(tail) - size :], stream[at:end]
    merged = generalize(list(old), part, depth + 1)
    return (size, merged, end) if _match_all(merged, part, 0) == len(part) else None


def _element(items, at: int) -> int | None:
    """The end of the element that starts here, where its tags are balanced."""
    if at >= len(items) or items[at][0] != "tag" or items[at][1][0] == "/":
        return None
    name, depth = items[at][1].split(".")[0], 0
    for k in range(at, len(items)):
        if items[k][0] == "tag":
            own = items[k][1]
            depth += (own.split(".")[0] == name) - (own == "/" + name)
            if not depth:
                return k + 1
    return None


def _element_before(items) -> int:
    """How many items the element takes that ends here, 0 if none does."""
    if not items or items[-1][0] != "tag" or items[-1][1][0] != "/":
        return 0
    name, depth = items[-1][1][1:], 0
    for k in range(len(items) - 1, -1, -1):
        if items[k][0] == "tag":
            own = items[k][1]
            depth += (own == "/" + name) - (own.split(".")[0] == name)
            if not depth:
                return len(items) - k
    return 0


def _widened(group: tuple, stream: list[tuple], at: int, depth: int) -> tuple[tuple, int] | None:
    """A group that also matches the element of the stream which begins as the group does, and where that ends."""
    if group[0] not in ("plus", "maybe") or depth >= DEPTH or at >= len(stream) or group[1][0] != stream[at]:
        return None
    end = _element(stream, at)
    if end is None or stream[end - 1] != group[1][-1]:
        return None
    part = stream[at:end]
    wider = generalize(list(group[1]), part, depth + 1)
    return ((group[0], tuple(wider)), end) if _match_all(wider, part, 0) == len(part) else None


def generalize(wrapper: list[tuple], stream: list[tuple], depth: int = 0) -> list[tuple]:
    """The wrapper made to match ``stream`` as well."""
    out: list[tuple] = []
    i = at = 0
    while i < len(wrapper) or at < len(stream):
        if i < len(wrapper):
            item = wrapper[i]
            end = _match(item, stream, at)
            if end is None or (end == at and item[0] == "maybe" and (i + 1 == len(wrapper) or _match(wrapper[i + 1], stream, at) is None)):
                wider = _widened(item, stream, at, depth)
                if wider and (after := _match(wider[0], stream, at)) not in (None, at):
                    item, end = wider[0], after
            if end is not None:
                out.append(item)
                i, at = i + 1, end
                continue
            if item[0] == "text" and at < len(stream) and stream[at][0] == "text":
                out.append(SLOT)
                i, at = i + 1, at + 1
                continue
        if out and out[-1][0] == "plus" and (wider := _widened(out[-1], stream, at, depth)):
            out[-1], at = wider
            continue
        # a repeated group in the stream
        found = _square(out, stream, at, depth)
        if found:
            size, merged, end = found
            while (more := _repeat(merged, stream, end)) is not None:
                merged, end = more
            out[len(out) - size :] = [("plus", tuple(merged))]
            at = end
            continue
        # or in the wrapper: what it holds once more than the stream
        found = _square(out, [x for x in wrapper[i:]], 0, depth) if i < len(wrapper) and wrapper[i][0] == "tag" else None
        if found:
            size, merged, end = found
            out[len(out) - size :] = [("plus", tuple(merged))]
            i += end
            continue
        # an optional part: the nearest place where both go on alike
        skip_w, skip_s = _resume(wrapper, i, stream, at)
        if skip_w:
            part = wrapper[i : i + skip_w]
            out.append(part[0] if len(part) == 1 and part[0][0] in ("maybe", "slot") else ("maybe", tuple(part)))
        if skip_s:
            part = stream[at : at + skip_s]
            slots = [SLOT if x[0] == "text" else x for x in part]
            out.extend(slots if all(x is SLOT for x in slots) else [("maybe", tuple(slots))])
        i, at = i + skip_w, at + skip_s
    return out


def _repeat(square: list[tuple], stream: list[tuple], at: int) -> tuple[list[tuple], int] | None:
    part = stream[at : at + len(square)]
    if len(part) == len(square) and all(a == b or (a[0] in ("text", "slot") and b[0] == "text") for a, b in zip(square, part, strict=True)):
        return [a if a == b else SLOT for a, b in zip(square, part, strict=True)], at + len(square)
    return None


def _resume(wrapper: list[tuple], i: int, stream: list[tuple], at: int) -> tuple[int, int]:
    """How many items of either side to leave out so that both go on with the same tag."""
    ahead: dict[tuple, int] = {}
    for k in range(len(wrapper) - i):
        if wrapper[i + k][0] == "tag":
            ahead.setdefault(wrapper[i + k], k)
    best = None
    for m in range(len(stream) - at):
        if best is not None and m >= sum(best):
            break
        k = ahead.get(stream[at + m])
        if k is not None and (k or m) and (best is None or k + m < sum(best)):
            best = (k, m)
    return best or (len(wrapper) - i, len(stream) - at)


def infer_wrapper(streams: list[list[tuple]]) -> list[tuple]:
    """A wrapper that every stream was aligned with, in the order given."""
    wrapper: list[tuple] = list(streams[0]) if streams else []
    for stream in streams[1:]:
        wrapper = generalize(wrapper, stream)
    return wrapper


def with_roles(wrapper: list[tuple]) -> list:
    """The wrapper as nested lists, every text with its role, and whether it varies."""
    places = Places()

    def walk(items) -> list:
        out = []
        for item in items:
            if item[0] == "tag":
                places.tag(item[1])
                out.append(["tag", item[1]])
            elif item[0] == "text":
                out.append(["text", item[1], places.text()[0]])
            elif item[0] == "slot":
                out.append(["slot", 0, places.text()[0] | VARIES])
            else:
                out.append([item[0], walk(item[1])])
        return out

    return walk(wrapper)


def _keys(paths: list[str], texts: list[str]) -> list[int]:
    """Texts at their places, as constants are counted; what repeats on a page is told apart by its turn."""
    turns: dict[tuple[str, str], int] = {}
    keys = []
    for path, text in zip(paths, texts, strict=True):
        at = path, " ".join(text.split())
        turns[at] = turn = turns.get(at, -1) + 1
        keys.append(xxh3_64_intdigest(f"{turn}\0{at[0]}\0{at[1]}") & 0x7FFFFFFFFFFFFFFF)
    return keys


def candidate_keys(items: list[tuple[str, str]], texts: list[str]) -> list[int]:
    """The keys of a page's texts but those in elements such as ``nav``; none where the page has a main region."""
    places, told, roles, paths, said = Places(), iter(texts), [], [], []
    for kind, tag in items:
        if kind == "tag":
            places.tag(tag)
            continue
        text = next(told)
        if text and not text.isspace():
            role, _ = places.text()
            if is_main(role):
                return []
            roles.append(role)
            paths.append(places.path())
            said.append(text)
    return sorted(key for key, role in zip(_keys(paths, said), roles, strict=True) if not role & OUTSIDE_ROLE)


#: Steps of a compiled wrapper: a tag or text has to stand there, a text may, or there are two ways on.
_TAG, _TEXT, _SLOT, _WAYS = range(4)


def compiled(wrapper: list) -> list[tuple]:
    """A wrapper with roles as steps (kind, value, role); (_WAYS, first, second) tries the first way first."""
    steps: list[tuple] = []

    def add(items: list) -> None:
        for item in items:
            kind = item[0]
            if kind == "tag":
                steps.append((_TAG, item[1], 0))
            elif kind == "text":
                steps.append((_TEXT, item[1], item[2]))
            elif kind == "slot":
                steps.append((_SLOT, None, item[2]))
            else:
                start = len(steps)
                if kind == "maybe":
                    steps.append(())
                add(item[1])
                if kind == "maybe":
                    steps[start] = (_WAYS, start + 1, len(steps))
                else:
                    steps.append((_WAYS, start, len(steps) + 1))

    add(wrapper)
    return steps


def roles_of(wrapper: list, stream: list[tuple]) -> list[int] | None:
    """The role of every text of a stream, as the wrapper has it; None if it does not match."""
    return follow(compiled(wrapper), stream)


def follow(steps: list[tuple], stream: list[tuple]) -> list[int] | None:
    """``roles_of`` of a compiled wrapper.

    Exact: where a way ends, the last choice is taken back. A choice that failed at a place
    is never tried there again, so the work stays under choices times items.
    """
    roles: list[int] = []
    back: list[tuple[int, int, int]] = []  # step, place in the stream, roles told by then
    tried: set[tuple[int, int]] = set()
    step = at = 0
    end, size = len(steps), len(stream)
    while True:
        if step == end:
            if at == size:
                return roles
        else:
            kind, value, role = steps[step]
            if kind == _WAYS:
                if (step, at) not in tried:
                    tried.add((step, at))
                    back.append((role, at, len(roles)))
                    step = value
                    continue
            elif kind == _SLOT:
                if at < size and stream[at][0] == "text":
                    if (step, at) not in tried:  # the text may also belong to what follows
                        tried.add((step, at))
                        back.append((step + 1, at, len(roles)))
                    roles.append(role)
                    at += 1
                step += 1
                continue
            elif at < size and stream[at][1] == value and (stream[at][0] == "tag") == (kind == _TAG):
                if kind == _TEXT:
                    roles.append(role)
                step, at = step + 1, at + 1
                continue
        if not back:
            return None
        step, at, told = back.pop()
        del roles[told:]


def regex_of(wrapper) -> str:
    """The wrapper in the notation of regular expressions: #TEXT for slots."""
    out = []
    for item in wrapper:
        if item[0] == "tag":
            out.append(f"<{item[1]}>")
        elif item[0] == "text":
            out.append(f"t{item[1]:x}")
        elif item[0] == "slot":
            out.append("#TEXT")
        else:
            out.append(f"({regex_of(item[1])}){'+' if item[0] == 'plus' else '?'}")
    return "".join(out)


# ------------------------------------------------------------------ extraction


#: What a text counts that is the same on every page of a host, against one that varies.
CONSTANT_WEIGHT = 0.01
#: Share of its text in links from which a list or block without main region is a menu, and its links at least.
LINK_SHARE, LINKS = 0.8, 3


def menus(items: list[tuple[str, str]], texts: list[str]) -> set[int]:
    """The numbers of texts in lists, tables and blocks that are little more than links."""
    places, told = Places(), iter(texts)
    held: dict[int, list] = {}  # element: characters, those in links, texts of links, numbers of texts
    n = -1
    for kind, tag in items:
        if kind == "tag":
            places.tag(tag)
            continue
        text = next(told)
        n += 1
        size = len(text.strip())
        linked = size > 0 and any(e[0] == "a" for e in places.stack)
        for name, _, _, number in places.stack if size else ():
            if name in ("ul", "ol", "dl", "table", "div", "section", "p"):
                own = held.setdefault(number, [0, 0, 0, []])
                own[0] += size
                own[1] += size * linked
                own[2] += linked
                own[3].append(n)
    return {k for size, inside, links, numbers in held.values() if links >= LINKS and inside >= LINK_SHARE * size for k in numbers}


def main_text(page: str, steps: list[tuple] | None = None, constants: frozenset[int] = frozenset()) -> str:
    """The main text of a page: its blocks in order, joined by one space.

    What varies comes from the wrapper (``steps``, compiled), or is everything where that is missing or
    does not match; roles are those of the page's way through it. With a main region, its texts are taken. Otherwise names of furniture are
    weighed (``disbelieved``), texts that vary over the host's pages counting 100 times those that do
    not; then a main region is taken if there is one, or the elements with names of main text where
    they hold at least half of what is left, or what is left without ``constants`` and ``menus``;
    neither of those takes the last text. A page of furniture only has the empty text.
    """
    items, texts = read_page(page)
    places, own, paths = Places(), [], []
    for kind, tag in items:
        if kind == "tag":
            places.tag(tag)
        else:
            own.append(places.text())
            paths.append(places.path() if constants else "")
    real = [k for k, t in enumerate(texts) if t and not t.isspace()]
    found = follow(steps, stream_of(items, texts)) if steps else None
    if found is None or len(found) != len(real):
        found = [VARIES] * len(real)
    found = [own[k][0] | (role & VARIES) for k, role in zip(real, found, strict=True)]
    roles = [role for role, _ in own]
    for k, role in zip(real, found, strict=True):
        roles[k] = role
    chosen = is_main
    if not any(map(is_main, found)):
        sizes = [0.0] * len(texts)
        keys = dict(zip(real, _keys([paths[k] for k in real], [texts[k] for k in real]), strict=True)) if constants else {}
        for k in real:
            sizes[k] = len(texts[k].strip()) * (1.0 if roles[k] & VARIES and keys.get(k) not in constants else CONSTANT_WEIGHT)
        again = Places(disbelieved(items, sizes)) if any(role & DOUBT_ROLE for role in found) else None
        if again is not None and again.doubted:
            at = 0
            for kind, tag in items:
                if kind == "tag":
                    again.tag(tag)
                else:
                    roles[at], at = again.text()[0], at + 1
        inside = [k for k in real if not is_outside(roles[k])]
        if not any(is_main(roles[k]) for k in real):
            chosen = lambda role: not is_outside(role)
            hinted = [k for k in inside if roles[k] & HINT_ROLE]
            if hinted and 2 * sum(sizes[k] for k in hinted) >= sum(sizes[k] for k in inside):
                chosen = lambda role: role & HINT_ROLE and not is_outside(role)
            else:
                for gone in ({k for k in inside if keys.get(k) in constants}, menus(items, texts)):
                    left = [k for k in inside if k not in gone]
                    if left:
                        for k in gone:
                            roles[k] |= OUTSIDE_ROLE
                        inside = left
    parts, broken = [], True
    for k, (text, (_, border)) in enumerate(zip(texts, own, strict=True)):
        broken |= border
        blank = not text or text.isspace()
        if (blank and is_outside(roles[k])) or (not blank and not chosen(roles[k])):
            broken = True
            continue
        if broken:
            parts.append(" ")
            broken = False
        parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


@dataclass(frozen=True)
class Settings:
    """``pages`` of each host that its wrapper does not match yet, different ones, are aligned in a round.

    What ``rounds`` leave unmatched is dealt into parts of about ``part_pages``, all of which are aligned.
    """

    pages: int = 6
    rounds: int = 12
    part_pages: int = 64
    #: Bytes of all wrappers up to which they are broadcast; beyond, they are joined.
    broadcast_bytes: int = 32 << 20


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def _number_of(stream: list[tuple]) -> int:
    """A hash of a stream."""
    return xxh3_64_intdigest(json.dumps(stream)) & 0x7FFFFFFFFFFFFFFF


def read_streams(pages: DataFrame) -> DataFrame:
    """A row per host and different stream of its pages: host, stream (a hash), tags, texts and candidate keys."""
    hosted = _hosted(pages).where("page_id is not null").select("host", "html")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [read_page(p) for p in batch.column(1).to_pylist()]
        made = [stream_of(*r) for r in read]
        kinds = [[t[1] if t[0] == "tag" else "" for t in s] for s in made]
        hashes = [[t[1] for t in s if t[0] == "text"] for s in made]
        columns = [batch.column(0), pa.array(map(_number_of, made), pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array([candidate_keys(*r) for r in read], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["host", "stream", "tags", "texts", "keys"])

    read = map_batches(hosted, run, "host string, stream bigint, tags array<string>, texts array<bigint>, keys array<bigint>")
    return staged(read.dropDuplicates(["host", "stream"]), "streams")


def host_constants(streams: DataFrame) -> DataFrame:
    """host and constants (keys as JSON): what every different stream without a main region has, of two or more."""
    plain = streams.where("size(keys) > 0")
    counts = plain.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    every = counts.join(plain.groupBy("host").agg(F.count("*").alias("of")), "host").where("n = of and of > 1")
    return every.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("key"))).alias("constants"))


def _items(tags: list[str], texts: list[int]) -> list[tuple]:
    told = iter(texts)
    return [("tag", t) if t else ("text", next(told)) for t in tags]


def _unmarked(roles: list) -> list[tuple]:
    """The wrapper that ``with_roles`` made these nested lists of."""
    return [(x[0], tuple(_unmarked(x[1]))) if x[0] in ("plus", "maybe") else SLOT if x[0] == "slot" else (x[0], x[1]) for x in roles]


def _aligned(sample: DataFrame) -> DataFrame:
    """The wrappers of (host, part, stream, tags, texts, pages, roles) rows, made to match these streams as well.

    A row without stream only brings the wrapper to go on from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            row = {"host": key[0], "part": key[1], "pages": pages, "wrapper": regex_of(wrapper), "roles": json.dumps(with_roles(wrapper))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("host", pa.string()), ("part", pa.int64()), ("pages", pa.int32()), ("wrapper", pa.string()), ("roles", pa.string())]))

        key, wrapper, steps, pages = None, [], None, 0
        for batch in batches:
            for host, part, number, tags, texts, before, roles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, part) != key:
                    if key is not None:
                        yield made()
                    key, pages = (host, part), before or 0
                    wrapper = _unmarked(json.loads(roles)) if roles else _items(tags, texts)
                    steps = compiled(with_roles(wrapper))
                if number is None:
                    continue
                stream, pages = _items(tags, texts), pages + 1
                if follow(steps, stream) is None:  # else an earlier one of this sample has made the wrapper match it
                    wrapper = generalize(wrapper, stream)
                    steps = compiled(with_roles(wrapper))
        if key is not None:
            yield made()

    placed = sample.select("host", "part", "stream", "tags", "texts", "pages", "roles")
    return placed.repartition("host", "part").sortWithinPartitions("host", "part", F.col("stream").asc_nulls_first()).mapInArrow(run, "host string, part bigint, pages int, wrapper string, roles string")


def _maybe_broadcast(wrappers: DataFrame, settings: Settings) -> DataFrame:
    size = wrappers.agg(F.sum(F.length("host") + sum(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in wrappers.columns if c != "host"))).first()[0] or 0
    return F.broadcast(wrappers) if size <= settings.broadcast_bytes else wrappers


def learn_wrappers(streams: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per host with part 0, and one for each of its further ``parts``, mostly none.

    Columns: host, part, parts, streams aligned, the wrapper as text and with its roles (as JSON). Every
    stream of every host is matched in every round; of those that do not match, some of each host
    are aligned with its wrapper, until all match. A stream still left after ``rounds`` belongs to the
    part ``1 + stream % parts`` of its host, whose wrapper is made to match all of these.
    """

    def unmatched(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
        return batch.select([0, 1, 2, 3]).filter(pa.array([follow(_steps(roles), _items(tags, texts)) is None for tags, texts, roles in rows], pa.bool_()))

    none = {"pages": F.lit(None).cast("int"), "roles": F.lit(None).cast("string")}
    left, wrappers = streams.select("host", "stream", "tags", "texts"), None
    order = Window.partitionBy("host").orderBy("stream")
    for _ in range(settings.rounds):
        sample = left.withColumn("k", F.row_number().over(order)).where(F.col("k") <= settings.pages).drop("k").withColumn("part", F.lit(0).cast("long"))
        if wrappers is None:
            wrappers = staged(_aligned(sample.withColumns(none)), "wrappers")
        else:
            wider = staged(_aligned(sample.join(wrappers.select("host", "pages", "roles"), "host")), "wrappers")
            wrappers = staged(wrappers.join(wider, "host", "left_anti").unionByName(wider), "wrappers")
        tried = left.join(_maybe_broadcast(wrappers.select("host", "roles"), settings), "host").select("host", "stream", "tags", "texts", "roles")
        left = staged(map_batches(tried, unmatched, "host string, stream bigint, tags array<string>, texts array<bigint>"), "unmatched")
        if left.isEmpty():
            return wrappers.withColumn("parts", F.lit(0).cast("long"))
    parts = left.groupBy("host").agg(F.ceil(F.count("*") / settings.part_pages).cast("long").alias("parts"))
    own = staged(wrappers.join(parts, "host", "left").fillna(0, ["parts"]), "wrappers")
    dealt = left.join(parts, "host").withColumns({"part": F.col("stream") % F.col("parts") + 1, **none}).drop("parts")
    begun = own.where("parts > 0").select("host", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"), "pages", "roles")
    further = staged(_aligned(dealt.unionByName(begun, allowMissingColumns=True)), "wrappers")
    return own.unionByName(further.join(parts, "host"))


@lru_cache(maxsize=256)
def _steps(roles: str) -> list[tuple]:
    return compiled(json.loads(roles))


@lru_cache(maxsize=256)
def _constants(keys: str) -> frozenset[int]:
    return frozenset(json.loads(keys))


def _place(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pages with the part of their host whose wrapper they are matched against: 0 where the host's own matches."""
    parts = []
    for page, roles, of in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5)), strict=True):
        stream = stream_of(*read_page(page))
        parts.append(1 + _number_of(stream) % of if follow(_steps(roles), stream) is None else 0)
    return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(parts, pa.int64())], ["page_id", "url", "html", "host", "part"])


def _with_wrappers(hosted: DataFrame, wrappers: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    return hosted.join(_maybe_broadcast(wrappers, settings), keys, "left").select("page_id", "url", "host", "html", "roles", "constants")


def extract_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, host, text and n_chars of every page, from its whole html.

    A null or empty html has the empty text. Pages without a host form a host of their own;
    rows without page_id are not learned from. Repeated rows give a row each; an empty table
    an empty result; other columns are ignored.
    """
    hosted = _hosted(pages)
    streams = read_streams(pages)
    wrappers = staged(learn_wrappers(streams, settings).join(host_constants(streams), "host", "left").select("host", "part", "parts", "roles", "constants"), "wrappers")
    own = wrappers.where("part = 0").select("host", "roles", "constants")
    if wrappers.where("parts > 0").isEmpty():
        joined = _with_wrappers(hosted, own, ["host"], settings)
    else:
        parted = wrappers.where("part = 0 and parts > 0").select("host", "roles", "parts")
        placed = map_batches(hosted.join(_maybe_broadcast(parted, settings), "host").select(*hosted.columns, "roles", "parts"), _place, "page_id bigint, url string, html string, host string, part bigint")
        among = wrappers.where("parts > 0").drop("parts")
        joined = _with_wrappers(hosted.join(parted.select("host"), "host", "left_anti"), own, ["host"], settings).unionByName(_with_wrappers(placed, among, ["host", "part"], settings))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, _steps(w) if w else None, _constants(c) if c else frozenset()) for p, w, c in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "host", "text", "n_chars"])

    return map_batches(joined, run, "page_id bigint, url string, host string, text string, n_chars bigint")


def op5_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
