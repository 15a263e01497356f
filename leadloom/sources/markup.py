"""Reading one page of HTML inside a task: elements in document order and CSS matches.

Only what card rules need: type, class and attribute conditions joined by descent.
"""

import re
from html import unescape
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSHOWN = frozenset(["script", "style", "template"])
_COMPOUND = re.compile(r"([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([\^*]?=)'([^']*)'(?: (i))?)?\]")
# Markup that can be read in one way only: lower-case tags with quoted attributes, closed comments, text.
_VALUE = r'[^"<>&]*(?:&(?:amp|lt|gt|quot|#[0-9]+);[^"<>&]*)*'
_PIECE = re.compile(
    rf"""(<([a-z][a-z0-9]*)((?:[ \n\t]+[a-z][a-z0-9-]*="{_VALUE}")*)>|</([a-z][a-z0-9]*)>|<!--(?!-?>)[^-]*(?:-(?!-)[^-]*)*-->|[^<]+)"""
)
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())  # whose content is no markup


class Page(HTMLParser):
    """Parallel lists, one entry per element: tag, attributes, parent, end, text span."""

    def __init__(self, html):
        self.tags, self.attrs, self.parents, self.ends, self.spans = [], [], [], [], []
        self.texts, self._open, self._hidden = [], [], 0
        if not self._read_plain(html):
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
        self._close_to(0)

    def _read_plain(self, html):
        """Reads a page of nothing but plain markup, several times as fast as the parser; False: the parser has to."""
        pieces = _PIECE.findall(html)
        if sum([len(piece[0]) for piece in pieces]) != len(html) or not _RAW.isdisjoint([piece[1] for piece in pieces]):
            return False
        for piece, tag, attrs, end in pieces:
            if tag:
                found = _ATTRIBUTE.findall(attrs)
                self.handle_starttag(tag, [(k, unescape(v)) for k, v in found] if "&" in attrs else found)
            elif end:
                self.handle_endtag(end)
            elif piece[0] != "<":
                self.handle_data(unescape(piece) if "&" in piece else piece)
        return True

    def handle_starttag(self, tag, attrs):
        me = len(self.tags)
        values = {k: v or "" for k, v in attrs}
        if "class" in values:
            values["class"] = " ".join(values["class"].split())
        self.tags.append(tag)
        self.attrs.append(values)
        self.parents.append(self._open[-1] if self._open else -1)
        self.ends.append(me + 1)
        self.spans.append((len(self.texts), len(self.texts)))
        if tag not in _VOID:
            self._open.append(me)
            self._hidden += tag in _UNSHOWN

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[depth]] == tag:
                self._close_to(depth)
                return

    def handle_data(self, data):
        if not self._hidden:
            self.texts.append(data)

    def _close_to(self, depth):
        for element in self._open[depth:]:
            self._hidden -= self.tags[element] in _UNSHOWN
            self.ends[element] = len(self.tags)
            self.spans[element] = (self.spans[element][0], len(self.texts))
        del self._open[depth:]

    def text(self, element):
        start, end = self.spans[element]
        return "".join(self.texts[start:end])

    def read(self, element, order):
        """First non-empty of the named attributes or the text; empty if there is none."""
        for name in order:
            value = self.text(element) if name == "text" else self.attrs[element].get(name, "")
            if value:
                return value
        return ""

    def matches(self, element, steps):
        """Whether an element fits the last step and its ancestors fit the earlier ones."""
        if not self._fits(element, steps[-1]):
            return False
        above, need = self.parents[element], len(steps) - 2
        while need >= 0 and above >= 0:
            if self._fits(above, steps[need]):
                need -= 1
            above = self.parents[above]
        return need < 0

    def _fits(self, element, step):
        attrs = self.attrs[element]
        for tag, cls, name, op, value, fold in step:
            if tag and self.tags[element] != tag:
                return False
            if cls and (cls not in (classes := attrs.get("class", "")) or cls not in classes.split(" ")):
                return False
            if name:
                if name not in attrs:
                    return False
                have = attrs[name].lower() if fold else attrs[name]
                want = value.lower() if fold else value
                if op == "=" and have != want:
                    return False
                if op == "^=" and not have.startswith(want):
                    return False
                if op == "*=" and want not in have:
                    return False
        return True


def compile_selector(selector):
    """Steps of a selector; spaces inside brackets belong to the condition."""
    return [_COMPOUND.findall(step) for step in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector)]
