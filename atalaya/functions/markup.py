"""The markup of a page, found in time that grows with its length, however broken it is."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property
from typing import NamedTuple

#: A tag without "<" in it: a try ends at the next "<", so all tries together read the page once.
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'<]*+)(?=[\s/>])((?:[^'"<>]|"[^"<]*+"|'[^'<]*+')*+)>""")
NAME = re.compile(r"[^\s/>]*+")


class Token(NamedTuple):
    start: int
    end: int
    closing: bool
    #: Empty for comments, declarations and marked sections.
    tag: str
    attributes: str
    #: What a marked section (CDATA) holds.
    content: str


class Markup:
    """Tags, comments and declarations of a page, one after another.

    Quoted attribute values may hold ">". Where the quotes of a tag do not pair up before the page ends, the tag ends
    at its next ">", or with ``quoted_only`` it is no tag but text. A comment without an end lasts to the end.
    """

    def __init__(self, html: str, quoted_only: bool = False, sections: bool = False) -> None:
        self.html, self.quoted_only, self.sections = html, quoted_only, sections
        self.dead: set[int] = set()  # places outside quotes from where no ">" outside quotes follows
        self.name = (0, 0)  # the last stretch of name characters
        self.ends: dict[str, tuple[int, tuple[int, int] | None]] = {}

    def _places(self, char: str) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(char), self.html)]

    @cached_property
    def places(self) -> dict[str, list[int]]:
        return {c: self._places(c) for c in ">\"'"}

    def _find(self, char: str, at: int) -> int:
        places = self.places[char]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else len(self.html)

    def _name_end(self, at: int) -> int:
        if not self.name[0] <= at < self.name[1]:
            self.name = (at, NAME.match(self.html, at).end())
        return self.name[1]

    def _quoted_end(self, at: int) -> int:
        """The place of the first ">" outside quotes, -1 where there is none."""
        passed, size = [], len(self.html)
        while True:
            gt, double, single = (self._find(c, at) for c in ">\"'")
            if gt < min(double, single):
                return gt
            if (quote := min(double, single)) == size:
                break
            if (close := self._find(self.html[quote], quote + 1)) == size or close + 1 in self.dead:
                break
            passed.append(at := close + 1)
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> Token | None:
        """The first token from a place on."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if found := PLAIN_TAG.match(html, start):
                return Token(start, found.end(), bool(found[1]), found[2], found[3], "")
            at = start + 1
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return Token(start, end + 3 if end >= 0 else len(html), False, "", "", "")
            if (gt := self._find(">", at)) == len(html):
                if (at := html.find("<!--", at)) < 0:
                    return None
                continue
            if html.startswith(("<!", "<?"), start):
                if self.sections and html.startswith("<![CDATA[", start) and (end := html.find("]]>", start + 9)) >= 0:
                    return Token(start, end + 3, False, "", "", html[start + 9 : end])
                return Token(start, gt + 1, False, "", "", "")
            first = at + html.startswith("/", at)
            if not (html[first : first + 1].isascii() and html[first : first + 1].isalpha()):
                continue
            name_end = self._name_end(first)
            end = self._quoted_end(name_end)
            if end < 0 and not self.quoted_only:
                end = self._find(">", name_end)
            if end >= 0:
                return Token(start, end + 1, first > at, html[first:name_end], html[name_end:end], "")
        return None

    def end_of(self, tag: str, at: int) -> tuple[int, int] | None:
        """Where the next end tag of an element begins and ends, from a place on; None where there is none.

        An end tag without ">" ends with the page, one place beyond it.
        """
        since, found = self.ends.get(tag, (at, (-1, -1)))
        if at < since or found and found[0] < at:
            opened = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.html, at)
            if found := opened and (opened.start(), opened.end()):
                gt = self.html.find(">", found[1])
                found = (found[0], (gt if gt >= 0 else len(self.html)) + 1)
            self.ends[tag] = (at, found)
        return found
