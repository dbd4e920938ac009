"""The selectors that rules are written in: parsed once, then tested on the nodes of a page.

Grammar: compounds of tag, class, id and attribute tests (quoted values may hold blanks and commas), descendant and
child steps, comma lists. Anything else raises ``ValueError``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_PART = re.compile(
    r"""\s*(?P<step>[>,])\s*|(?P<blank>\s+)|(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$]?=)\s*(?:"(?P<two>[^"]*)"|'(?P<one>[^']*)'|(?P<bare>[^\]\s]*))\s*)?\]""",
    re.X,
)


@dataclass(frozen=True)
class Compound:
    """Tests of one node; ``child`` says that the step before it is its parent, not just above it."""

    tag: str | None = None
    tests: tuple[tuple[str, str, str], ...] = ()
    child: bool = False

    def matches(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag == "#text" or self.tag and tag != self.tag:
            return False
        for name, op, value in self.tests:
            own = attrs.get(name)
            if own is None:
                return False
            if op == "~=":
                good = value in own.split()
            elif op == "=":
                good = own == value
            elif op == "^=":
                good = own.startswith(value)
            elif op == "$=":
                good = own.endswith(value)
            else:
                good = op == "" or value in own
            if not good:
                return False
        return True


def parse(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """The choices of a selector, each its steps from the outermost to the node itself."""
    text = selector.strip()
    choices: list[tuple[Compound, ...]] = []
    steps: list[Compound] = []
    tag: str | None = None
    tests: list[tuple[str, str, str]] = []
    child = any_part = False

    def end_compound() -> None:
        nonlocal tag, any_part, child
        if not any_part:
            raise ValueError(f"selector not supported: {selector!r}")
        steps.append(Compound(tag, tuple(tests), child))
        tests.clear()
        tag, any_part, child = None, False, False

    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m["tag"] and any_part:
            raise ValueError(f"selector not supported: {selector!r}")
        at = m.end()
        if m["step"] or m["blank"]:
            end_compound()
            if m["step"] == ",":
                choices.append(tuple(steps))
                steps.clear()
            child = m["step"] == ">"
            continue
        any_part = True
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["cls"]:
            tests.append(("class", "~=", m["cls"]))
        elif m["id"]:
            tests.append(("id", "=", m["id"]))
        else:
            value = next((m[k] for k in ("two", "one", "bare") if m[k] is not None), "")
            tests.append((m["attr"].lower(), m["op"] or "", value))
    end_compound()
    return (*choices, tuple(steps))
