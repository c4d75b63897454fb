"""What a page says: title, description, keywords, links and plain text, in one linear pass over its tokens."""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(
    r"""(?is)<!--.*?(?:-->|\Z)"""
    r"""|<(script|style|template)\b[^>]*+(?:>.*?(?:</\1\s*+[^<>]*+>|\Z)|\Z)"""
    r"""|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<[!?/][^<>]*+>"""
    r"""|([^<]++|<)"""
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?+""")
_SPACES = re.compile(r"[ \t\r\n\f]+")
_PARAGRAPHS = frozenset(
    "h1 h2 h3 h4 h5 h6 blockquote p div article section header footer nav main aside ul ol dl table form pre body".split()
)
_LINES = frozenset("br li tr dt dd hr option".split())


def attributes(inside: str) -> dict[str, str]:
    """Decoded attributes of a start tag, first ones first; names in lower case."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(inside):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return found


class PageText:
    """The facts of one page; an unclosed comment or script goes to the end of the page."""

    def __init__(self, html: str):
        self.title: str | None = None
        self.metas: dict[str, str] = {}
        self.links: list[str] = []
        self._line: list[str] = []
        self._lines: list[str] = []
        title: list[str] | None = None
        head = False
        pre = 0
        for token in _TOKEN.finditer(html):
            text = token.group(5)
            if text is not None:
                if title is not None:
                    title.append(text)
                elif pre:
                    first, *more = text.replace("\r\n", "\n").split("\n")
                    self._line.append(first)
                    for part in more:
                        self._break(kept=True)
                        self._line.append(part)
                elif not head:
                    self._line.append(_SPACES.sub(" ", text))
                continue
            name = token.group(3)
            if name is None:
                continue
            name, closing = name.lower(), token.group(2) == "/"
            if name == "title":
                if closing and title is not None and self.title is None:
                    self.title = _SPACES.sub(" ", unescape("".join(title))).strip()
                title = None if closing else []
            elif name == "head":
                head = not closing
            elif name == "body":
                head = False
            elif name == "meta" and not closing:
                values = attributes(token.group(4))
                if "content" in values:
                    self.metas.setdefault(values.get("name", "").lower(), values["content"])
            elif name in ("a", "area", "link") and not closing:
                target = attributes(token.group(4)).get("href")
                if target is not None:
                    self.links.append(target.strip())
            if name == "pre":
                if closing and pre and self._line:
                    self._break(kept=True)
                pre = max(0, pre + (-1 if closing else 1))
            if name in _PARAGRAPHS:
                self._break()
                if self._lines and self._lines[-1]:
                    self._lines.append("")
            elif name in _LINES and not closing:
                self._break()
        self._break()
        while self._lines and not self._lines[-1]:
            self._lines.pop()
        self.text = unescape("\n".join(self._lines))

    def _break(self, kept: bool = False) -> None:
        """End the line; a blank one stays only in preformatted text."""
        line = "".join(self._line)
        line = line.rstrip() if kept else _SPACES.sub(" ", line).strip()
        if line or kept:
            self._lines.append(line)
        self._line = []
