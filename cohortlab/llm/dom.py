"""Leaf blocks of raw web pages: their text, their ancestors and features of both.

A page is read once, tag by tag, with a stack of open elements. A leaf block is a stretch of text that no
block-level tag interrupts. Work and memory grow with the page, not with its depth: each open element
carries the features of its ancestors as a bit set of fixed size.
"""

from __future__ import annotations

import html
import re
import zlib

#: Fixed values of HTML: elements that end a block, have no end tag, hold no page text, or end one another.
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table
    tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style title textarea template noscript iframe object svg math canvas audio video noembed noframes".split())
HEAD = set("base link meta script style title noscript template".split())
ENDS_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
             "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
TWINS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
         "thead": {"tr", "td", "th", "tbody", "tfoot"}, "tbody": {"tr", "td", "th", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
#: Elements whose names say what their text is for.
SEMANTIC = set("article main nav header footer aside form section dialog figure table blockquote body".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")
ENDS = re.compile(r"[.!?…:;]['\"”’»)\]]*$")

#: Features are numbers below FEATURES; those of the ancestors are below ANCESTRY.
ANCESTRY, FEATURES = 1024, 8192


def _ancestor_feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % ANCESTRY


def _feature(name: str) -> int:
    return ANCESTRY + zlib.crc32(name.encode("utf-8", "surrogatepass")) % (FEATURES - ANCESTRY)


class Element:
    __slots__ = ("name", "bits", "near", "outer", "inside_link", "mark", "_features")

    def __init__(self, name: str, parent: Element | None, attributes: str, mark: str | None):
        self.name = name
        bits = 1 << _ancestor_feature("<" + name)
        for found in NAMES.finditer(attributes) if attributes else ():
            for piece in PIECE.findall(found[1] or found[2] or found[3] or ""):
                piece = piece.lower()
                bits |= 1 << _ancestor_feature("." + (piece[:-1] if len(piece) > 2 and piece.endswith("s") else piece))
        if attributes and HIDDEN.search(attributes):
            bits |= 1 << _ancestor_feature("hidden")
        self.bits = bits | (parent.bits if parent else 0)
        semantic = name in SEMANTIC
        self.near = name if semantic else parent.near if parent else ""
        self.outer = (parent.near if parent else "") if semantic else parent.outer if parent else ""
        self.inside_link = name == "a" or bool(parent and parent.inside_link)
        self.mark = mark if mark is not None else parent.mark if parent else None
        self._features = None

    def features(self) -> list[int]:
        """Of the element and its ancestors: names and words of classes, ids and roles."""
        if self._features is None:
            bits, out = self.bits, []
            while bits:
                low = bits & -bits
                out.append(low.bit_length() - 1)
                bits ^= low
            out.append(_feature("near " + self.near))
            out.append(_feature(f"near {self.outer} {self.near}"))
            out.append(_feature("leaf " + self.name))
            out.append(_feature(f"leaf {self.near} {self.name}"))
            self._features = out
        return self._features


def blocks_of(page: str | None, marks: re.Pattern | None = None) -> list[tuple[str, int, Element]]:
    """(text, characters inside links, element) of the leaf blocks in page order. Character references are
    decoded, white space is one space, blocks without text are left out. With ``marks``, an element's
    attributes may say what its blocks are (``Element.mark``)."""
    page = page or ""
    out: list[tuple[str, int, Element]] = []
    root = Element("html", None, "", None)
    stack, open_names = [root], {"html": 1}
    parts: list[str] = []
    linked: list[str] = []
    owner = root

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, len(" ".join("".join(linked).split())), owner))
            parts.clear()
            linked.clear()

    def pop():
        gone = stack.pop()
        open_names[gone.name] -= 1

    def say(text):
        nonlocal owner
        if open_names.get("head"):
            return
        if not parts:
            if text.isspace():
                return
            k = len(stack) - 1
            while stack[k].name not in BLOCK:
                k -= 1
            owner = stack[k]
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if stack[-1].inside_link:
            linked.append(text)

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at:found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if name in BLOCK or name == "body":
                flush()
            if name in ("html", "body"):
                continue
            if not open_names.get(name):
                if name == "p" or name == "br":
                    flush() if name == "p" else say(" ")
                continue
            if name not in BLOCK:
                # an inline end tag closes nothing beyond the block it stands in
                k = len(stack) - 1
                while stack[k].name != name and stack[k].name not in BLOCK:
                    k -= 1
                if stack[k].name != name:
                    continue
            while stack[-1].name != name:
                pop()
            pop()
            continue
        if name in SILENT:
            if not found[3].rstrip().endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if open_names.get("head") and name not in HEAD and name not in ("head", "html"):
            while open_names["head"]:
                pop()
        if name == "br":
            say(" ")
            continue
        if name in ("html", "body") and open_names.get(name):
            continue
        if name in BLOCK:
            flush()
            if open_names.get("p"):
                # a block ends the paragraph it would stand in
                k = len(stack) - 1
                while k and stack[k].name != "p" and stack[k].name not in BLOCK:
                    k -= 1
                if stack[k].name == "p":
                    while len(stack) > k:
                        pop()
            if name in ENDS_SAME:
                same, limit = TWINS.get(name, {name}) | {name}, ENDS_SAME[name]
                k = len(stack) - 1
                while k and stack[k].name not in same and stack[k].name not in limit and stack[k].name not in SEMANTIC and stack[k].name != "div":
                    k -= 1
                while k and stack[k].name in same:
                    while len(stack) > k:
                        pop()
                    k = len(stack) - 1
        if name in VOID:
            continue
        mark = None
        if marks is not None and (m := marks.search(found[3])):
            mark = m[1]
        stack.append(Element(name, stack[-1], found[3], mark))
        open_names[name] = open_names.get(name, 0) + 1
    flush()
    return out


def _size(n: int) -> int:
    return min(n, 3) if n < 4 else n.bit_length() + 1


def block_features(blocks: list[tuple[str, int, Element]]) -> list[list[int]]:
    """The features of each block: its ancestors, its size, links, marks and place, words of short blocks, and the sizes of
    the blocks beside it."""
    last = len(blocks) - 1
    sizes = [_size(text.count(" ") + 1) for text, _, _ in blocks]
    links = [0 if not linked else 1 + min(3, 4 * linked // (len(text) + 1)) for text, linked, _ in blocks]
    out = []
    for k, (text, _, element) in enumerate(blocks):
        size, ends = sizes[k], bool(ENDS.search(text[-8:]))
        names = [f"size {size}", f"link {links[k]}", f"ends {ends} {size > 5}", f"shape {size} {links[k]} {ends}",
                 f"comma {min(2, text.count(','))} {size > 5}", f"upper {text[:1].isupper()}", f"leaf size {element.name} {size}",
                 f"before {sizes[k - 1] if k else 'none'}", f"after {sizes[k + 1] if k < last else 'none'}",
                 f"links beside {links[k - 1] if k else 'none'} {links[k + 1] if k < last else 'none'}",
                 f"place {min(k, 3)}", f"rest {min(last - k, 3)}", "bias"]
        if text[:1] in "©|" or "©" in text:
            names.append("copyright sign")
        if size <= 5:
            names += ["word " + w for w in {w.lower() for w in LETTERS.findall(text)}]
        out.append(element.features() + [_feature(x) for x in names])
    return out
