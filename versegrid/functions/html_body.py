"""Body text of one page, found by a container rule.

Markup is read with the standard-library HTML reader and an element stack. End
tags close up to the nearest open element of their name and are ignored when none
is open; void elements close at once; script, style, template and ruby annotation
strings are not text.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import NamedTuple

# Void elements and elements whose strings are not text.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split())
HIDDEN = frozenset("script style template rt rp".split())


class BodyRule(NamedTuple):
    """Which pages a rule takes and where their body is.

    ``mode`` is ``text`` (all text of the container), ``paragraphs`` (its ``p``
    descendants joined by a blank, the one with id ``skip_id`` counting as empty)
    or ``next`` (the first ``next_tag`` without a class after the container's
    start tag). The container is the first element whose ``by`` (``id``,
    ``class`` or ``tag``) is ``value``.
    """

    site: str
    url_regex: str
    mode: str
    by: str
    value: str
    next_tag: str = "div"
    skip_id: str | None = None


# Address patterns and containers of the supported sites, in order.
SITE_RULES = (
    BodyRule("metrolyrics", r"^http://www.metrolyrics.com/[a-z0-9-]+-lyrics-[a-z0-9-]+\.html",
             "paragraphs", "id", "lyrics-body-text", skip_id="mid-song-discussion"),
    BodyRule("lyricscom", r"^http://www.lyrics.com/[a-z0-9-]+-lyrics-[a-z0-9-]+\.html",
             "text", "id", "lyrics"),
    BodyRule("lyricsmode", r"^http://www.lyricsmode.com/lyrics/([a-z]|0-9)/[a-z0-9_]+/[a-z0-9_]+\.html",
             "text", "id", "lyrics_text"),
    BodyRule("azlyrics", r"^http://www.azlyrics.com/lyrics/[a-z0-9]+/[a-z0-9]+\.html",
             "next", "class", "lyricsh"),
)


class _Finished(Exception):
    pass


class _BodyReader(HTMLParser):
    def __init__(self, rule: BodyRule):
        super().__init__(convert_charrefs=True)
        self.rule = rule
        self.open: list[str] = []
        self.hidden = 0
        self.anchored = False
        self.depth: int | None = None  # stack height just below the container
        self.found = False
        self.pieces: list[str] = []
        self.paragraphs: list[list] = []  # [first piece, end piece or None, skipped, stack height]

    def _is_container(self, tag: str, attrs: dict) -> bool:
        by, value = self.rule.by, self.rule.value
        if by == "tag":
            return tag == value
        given = attrs.get(by)
        if given is None:
            return False
        return given == value or (by == "class" and value in given.split())

    def handle_starttag(self, tag, attrs):
        self._start(tag, dict(attrs), tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, dict(attrs), True)

    def _start(self, tag, attrs, closes_at_once):
        if not self.found:
            if self.rule.mode == "next" and not self.anchored:
                self.anchored = self._is_container(tag, attrs)
                starts = False
            elif self.rule.mode == "next":
                starts = tag == self.rule.next_tag and "class" not in attrs
            else:
                starts = self._is_container(tag, attrs)
            if starts:
                self.found = True
                self.depth = len(self.open)
        elif self.rule.mode == "paragraphs" and tag == "p":
            skipped = self.rule.skip_id is not None and attrs.get("id") == self.rule.skip_id
            end = len(self.pieces) if closes_at_once else None
            self.paragraphs.append([len(self.pieces), end, skipped, len(self.open)])
        self.open.append(tag)
        self.hidden += tag in HIDDEN
        if closes_at_once:
            self._pop()

    def handle_endtag(self, tag):
        if tag in self.open:
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag = self.open.pop()
        self.hidden -= tag in HIDDEN
        height = len(self.open)
        if tag == "p":
            for paragraph in reversed(self.paragraphs):
                if paragraph[1] is None and paragraph[3] == height:
                    paragraph[1] = len(self.pieces)
                    break
        if self.depth is not None and height == self.depth:
            raise _Finished
        return tag

    def handle_data(self, data):
        if self.depth is not None and not self.hidden:
            self.pieces.append(data)

    def result(self) -> str | None:
        if not self.found:
            return None
        if self.rule.mode != "paragraphs":
            return "".join(self.pieces)
        return " ".join("" if skipped else "".join(self.pieces[first:end])
                        for first, end, skipped, _ in self.paragraphs)


def page_body(html: str | None, rule: BodyRule) -> str | None:
    """The body of ``html``, or None without the rule's container."""
    if html is None:
        return None
    reader = _BodyReader(rule)
    try:
        reader.feed(html)
        reader.close()
    except _Finished:
        pass
    except AssertionError:  # the reader's answer to broken declarations
        return None
    return reader.result()
