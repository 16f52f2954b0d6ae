"""A forgiving HTML reader: tags to a small tree, in one pass whose time is linear in the page."""

from __future__ import annotations

import html
import re

#: Fixed values of HTML: elements without content, elements whose content is raw text, block elements, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH = frozenset(("p",))
#: Where an implied end must not reach beyond.
SCOPE = frozenset("ul ol dl table article section main div body html aside nav footer header form".split())

#: Elements whose ids are anchors of what they say, and do not name a part of the page; so are those of inline elements inside.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p".split())

_ENDED = PARAGRAPH.union(*ENDS.values())
#: A tag without quotes; the others take the scanner's longer way.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*)([^>\"']*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_MARKS = frozenset(("class", "id", "role"))


class Node:
    """An element: tag, mark (class, id and role words; ids that are anchors begin with #), children: nodes and strings."""

    __slots__ = ("tag", "mark", "children")

    def __init__(self, tag: str, mark: str):
        self.tag, self.mark, self.children = tag, mark, []


class Scanner:
    """Tags of a page, one after the other.  A quote opens a value only behind an equals sign and if it is closed somewhere.

    Each character is looked at a bounded number of times: where the last quotes and the last > stand is known from the start,
    and behind a tag that only ends inside quotes, quotes mean nothing for the rest of the page.
    """

    def __init__(self, text: str):
        self.text, self.quoted = text, True
        self.last = {c: text.rfind(c) for c in ">\"'"}

    def tag_end(self, at: int) -> int:
        """Where the tag that is open at `at` ends, or -1."""
        text, start = self.text, at
        while self.quoted:
            m = _STOP.search(text, at)
            if m is None:
                self.quoted = False
                break
            c, at = m[0], m.start()
            if c == ">":
                return at
            before = at - 1
            while before > start and text[before].isspace():
                before -= 1
            at = text.find(c, at + 1) + 1 if text[before] == "=" and at < self.last[c] else at + 1
        return text.find(">", start)

    def tags(self, at: int = 0):
        """(start, end, name or "", closes, attributes) of the next tag, comment or declaration; send() moves on."""
        text, last = self.text, self.last[">"]
        while 0 <= (i := text.find("<", at)) < last:
            m = _PLAIN.match(text, i)
            if m:
                found = (i, m.end(), m[2].lower(), m[1] != "", m[3])
            elif text.startswith("<!--", i):
                end = text.find("-->", i + 4)
                found = (i, end + 3 if end >= 0 else len(text), "", False, "")
            elif text.startswith("<![CDATA[", i):
                end = text.find("]]>", i)
                found = (i, end + 3 if end >= 0 else len(text), "", False, "")
            elif text[i + 1 : i + 2] in ("!", "?"):
                found = (i, text.find(">", i) + 1, "", False, "")
            else:
                closes = text.startswith("/", i + 1)
                m = _NAME.match(text, i + 1 + closes)
                end = self.tag_end(m.end()) if m else -1
                if end < 0:
                    at = i + 1
                    continue
                found = (i, end + 1, m[0].lower(), closes, text[m.end() : end])
            at = (yield found) or found[1]


def parse(text: str) -> Node:
    """The tree of a page.  Never fails: stray end tags are ignored, open elements end with their parents."""
    root = Node("#root", "")
    stack, at, n = [root], 0, len(text)
    # open elements by tag: all, those inside the innermost scope, and the inline ones inside the innermost block
    opened: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]
    inline: list[dict[str, int]] = [{}]

    def count(where: dict[str, int], tag: str, by: int) -> None:
        where[tag] = where.get(tag, 0) + by

    def push(node: Node) -> None:
        tag = node.tag
        stack.append(node)
        count(opened, tag, 1)
        if tag in SCOPE:
            scopes.append({})
        elif tag in _ENDED:
            count(scopes[-1], tag, 1)
        if tag in INLINE:
            count(inline[-1], tag, 1)
        else:
            inline.append({})

    def close(tags: frozenset | set) -> None:
        """Ends the innermost open element of these tags, which there is, and all inside."""
        while True:
            tag = stack.pop().tag
            count(opened, tag, -1)
            if tag in SCOPE:
                scopes.pop()
            elif tag in _ENDED:
                count(scopes[-1], tag, -1)
            if tag in INLINE:
                count(inline[-1], tag, -1)
            else:
                inline.pop()
            if tag in tags:
                return

    scanner = Scanner(text).tags()
    found = next(scanner, None)
    while found:
        start, end, tag, closes, attrs = found
        if start > at:
            stack[-1].children.append(text[at:start])
        at = end
        if closes:
            if (inline[-1] if tag in INLINE else opened).get(tag, 0) > 0:  # an inline end does not close the block around
                close({tag})
        elif tag:
            # a list item ends the one before, a block an open paragraph
            ends = ENDS.get(tag) or (PARAGRAPH if tag not in INLINE and tag not in RAW else ())
            if scopes[-1] and any(scopes[-1].get(x, 0) > 0 for x in ends):
                close(ends)
            node = Node(tag, _mark(attrs, tag, stack) if "=" in attrs else "")
            stack[-1].children.append(node)
            if tag in RAW:
                e = _RAW_END[tag].search(text, at)
                node.children.append(text[at : e.start() if e else n])
                at = e.end() if e else n
            elif tag not in VOID and not attrs.endswith("/"):
                push(node)
        try:
            found = scanner.send(at)
        except StopIteration:
            break
    if at < n:
        stack[-1].children.append(text[at:])
    return root


def _mark(attrs: str, tag: str, stack: list[Node]) -> str:
    said = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)]
    found = [(name, word) for name, value in said if name in _MARKS for word in value.lower().split()]
    if any(name == "id" for name, _ in found):
        around = tag if tag not in INLINE else next((x.tag for x in reversed(stack) if x.tag not in INLINE), "")
        if around in TEXTS:
            found = [(name, "#" + word if name == "id" else word) for name, word in found]
    return " ".join(dict.fromkeys(word for _, word in found))


_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def clean(parts: list[str]) -> str:
    """Text of a block: references decoded, white space as one space, trimmed."""
    s = "".join(parts)
    return " ".join((html.unescape(s) if "&" in s else s).split())
