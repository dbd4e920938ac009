"""Items of all sources in one pass: every capture is read by the rule of its own source.

Captures meet the rules in an equi join; the Arrow step that reads a page or a JSON body also applies the row's
selectors, paths and patterns, each distinct rule being compiled once per worker. Only items come back.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import asdict
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atalaya.functions.dom import TEXT, _Nodes
from atalaya.functions.selectors import Compound, parse
from atalaya.functions.text import BLANKS

PAGES = ("html_static", "browser", "curl_cffi", "wp_ajax")
JSON = "json_api"
ITEM_FIELDS = [
    "identificador", "titulo", "descripcion", "enlace", "estado", "fecha_apertura", "fecha_cierre", "monto", "region", "grupo",
]
ITEM = T.StructType([T.StructField("pos", T.IntegerType())] + [T.StructField(f, T.StringType()) for f in ITEM_FIELDS])
READ = T.StructType([T.StructField("motivo", T.StringType()), T.StructField("items", T.ArrayType(ITEM))])
ARROW_ITEM = pa.struct([("pos", pa.int32())] + [(f, pa.string()) for f in ITEM_FIELDS])
ARROW_READ = pa.struct([("motivo", pa.string()), ("items", pa.list_(ARROW_ITEM))])
Item = dict[str, object]


#: Rules and selectors that a worker keeps.
MOST_RULES = 4096


class BadRule(ValueError):
    """What is wrong with a rule."""


def _text(value: str | None) -> str | None:
    return (value or "").strip(BLANKS) or None


def python_pattern(pattern: str) -> re.Pattern:
    """A rule's pattern, whose named groups may stand in Java's form."""
    return re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))


def _finder(pattern: str | None) -> Callable[[str | None], str | None]:
    """Group 1 of the first match, or the match of a pattern without groups; no match gives None."""
    if not pattern:
        return lambda text: text
    compiled = python_pattern(pattern)

    def find(text: str | None) -> str | None:
        found = compiled.search(text) if text else None
        return _text(found[1] if compiled.groups else found[0]) if found else None

    return find


#: Selectors that a worker has parsed; many rules share them.
_SELECTORS: dict[str, tuple[tuple[Compound, ...], ...]] = {}


def _parsed(selector: str) -> tuple[tuple[Compound, ...], ...]:
    if not isinstance(selector, str):
        raise TypeError(selector)
    if (found := _SELECTORS.get(selector)) is None:
        if len(_SELECTORS) >= MOST_RULES:
            _SELECTORS.clear()
        found = _SELECTORS[selector] = parse(selector)
    return found


class RulePage(_Nodes):
    """A page's nodes with selectors over them."""

    def __init__(self, html: str) -> None:
        super().__init__(html)
        self.by_tag: dict[str, list[int]] = {}
        for at, tag in enumerate(self.tag):
            self.by_tag.setdefault(tag, []).append(at)
        self.texts = self.by_tag.get(TEXT, [])
        self.matched: dict[str, list[int]] = {}

    @cached_property
    def by_class(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for at, named in enumerate(self.named):
            if "class" in named:
                for one in set(named["class"].split()):
                    found.setdefault(one, []).append(at)
        return found

    @cached_property
    def elements(self) -> list[int]:
        return [at for at, tag in enumerate(self.tag) if tag != TEXT]

    @cached_property
    def pieces(self) -> list[str]:
        return [(self.text[at] or "").strip(BLANKS) for at in self.texts]

    def _places(self, last: Compound) -> Sequence[int]:
        """The nodes that a step can match, ascending."""
        if last.tag:
            return self.by_tag.get(last.tag, ())
        named = next((value for _, op, value in last.tests if op == "~="), None)
        return self.elements if named is None else self.by_class.get(named, ())

    def hit(self, at: int, steps: tuple[Compound, ...]) -> bool:
        if not steps[-1].matches(self.tag[at], self.named[at]):
            return False
        if len(steps) == 1:
            return True
        above = self.parent[at]
        while above >= 0:
            if self.hit(above, steps[:-1]):
                return True
            if steps[-1].child:
                return False
            above = self.parent[above]
        return False

    def all(self, selector: str) -> list[int]:
        """All nodes that a selector matches, in page order; each selector is tried once on a page."""
        if (found := self.matched.get(selector)) is None:
            choices = _parsed(selector)
            found = [at for steps in choices for at in self._places(steps[-1]) if self.hit(at, steps)]
            self.matched[selector] = found = found if len(choices) == 1 else sorted(set(found))
        return found

    def first(self, selector: str, above: int) -> int | None:
        """The first match below an element."""
        found = self.all(selector)
        i = bisect_right(found, above)
        return found[i] if i < len(found) and found[i] <= self.last[above] else None

    def text_of(self, at: int, separator: str = "") -> str:
        return separator.join(self.pieces[bisect_left(self.texts, at) : bisect_right(self.texts, self.last[at])])


class _PageRule:
    """Selectors and patterns of one source's list pages."""

    FIELDS = ("descripcion", "estado", "fecha_cierre", "monto", "region")

    def __init__(self, doc: dict) -> None:
        named = doc.get("selectores")
        if not isinstance(named, dict) or not all(named.get(k) for k in ("contenedor_items", "identificador", "titulo")):
            raise BadRule("faltan_selectores")
        try:
            _parsed(box := named["contenedor_items"])
            self.box = box
            self.named = {k: v for k, v in named.items() if v and k != "contenedor_items"}
            self.below = {v for v in self.named.values() if v != "self" and not v.startswith("attr:")}
            for selector in self.below:
                _parsed(selector)
        except (ValueError, TypeError, AttributeError):
            raise BadRule("selector_invalido") from None
        patterns = doc.get("normalizadores") or {}
        given = {f: p["regex_extraction"] for f, p in patterns.items() if isinstance(p, dict) and p.get("regex_extraction")}
        try:
            self.find = {f: _finder(given.get(f)) for f in ("titulo", "fecha_cierre", "monto", "region")}
        except (re.error, OverflowError, TypeError):
            raise BadRule("patron_invalido") from None
        self.whole_text = [f for f in ("fecha_cierre", "monto") if f in given]

    def _node(self, page: RulePage, box: int, selector: str) -> int | None:
        return page.first(selector, box) if selector in self.below else box

    def _value(self, page: RulePage, box: int, name: str) -> str | None:
        selector = self.named.get(name)
        if not selector:
            return None
        if selector.startswith("attr:"):
            return _text(page.named[box].get(selector.removeprefix("attr:")))
        at = self._node(page, box, selector)
        return None if at is None else _text(page.text_of(at))

    def _link(self, page: RulePage, box: int) -> str | None:
        selector, at = self.named.get("link_detalle"), None
        if selector:
            at = self._node(page, box, selector)
        if at is None and page.tag[box] == "a":
            at = box
        return None if at is None else _text(page.named[at].get("href"))

    def read(self, body: str) -> tuple[str | None, list[Item]]:
        page = RulePage(body)
        items: list[Item] = []
        pos = -1
        for pos, box in enumerate(page.all(self.box)):
            found: Item = {f: self._value(page, box, f) for f in self.FIELDS}
            title = self._value(page, box, "titulo")
            title = self.find["titulo"](title) or title
            same = self.named["identificador"] == self.named["titulo"]
            if not title:
                continue
            for f in ("fecha_cierre", "monto", "region"):
                found[f] = self.find[f](found[f])  # type: ignore[arg-type]
            for f in self.whole_text:
                found[f] = found[f] or self.find[f](page.text_of(box))
            found |= {
                "pos": pos, "titulo": title, "enlace": self._link(page, box),
                "identificador": title if same else self._value(page, box, "identificador"),
            }
            items.append(found)
        return ("sin_items" if pos >= 0 and not items else None), items


def at_path(value: object, path: str | None) -> object:
    """The value a dot path leads to; at a list a step is a position, at an object a name."""
    for part in path.split(".") if path else ():
        if isinstance(value, list):
            inside = part.lstrip("-").isdigit() and -len(value) <= int(part) < len(value)
            value = value[int(part)] if inside else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def _strict(body: str) -> object:
    def refuse(name: str) -> object:
        raise ValueError(name)

    return json.loads(body, parse_constant=refuse)


def _as_text(value: object) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dict | list):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None if value is None else _text(str(value))


class _JsonRule:
    """Dot paths of one source's responses."""

    def __init__(self, doc: dict) -> None:
        named = doc.get("json_mapping")
        if not isinstance(named, dict) or not (named.get("identificador") and named.get("titulo")):
            raise BadRule("falta_json_mapping")
        named = {k: v for k, v in named.items() if isinstance(v, str)}
        self.root = named.get("root_path")
        self.paths = {"enlace": named.get("link_detalle"), "grupo": named.get("agrupar_por")}
        self.paths |= {f: named.get(f) for f in ITEM_FIELDS if f not in self.paths}

    def read(self, body: str) -> tuple[str | None, list[Item]]:
        try:
            doc = _strict(body)
        except (ValueError, RecursionError):
            return "json_invalido", []
        listed = at_path(doc, self.root)
        if not isinstance(listed, list):
            return "raiz_no_es_lista", []
        items: list[Item] = [
            {f: _as_text(at_path(x, p)) if p else None for f, p in self.paths.items()} | {"pos": n} for n, x in enumerate(listed)
        ]
        if any(x["identificador"] is None or x["titulo"] is None for x in items):
            return "item_incompleto", []
        return None, items


def compiled(strategy: str, document: str) -> _PageRule | _JsonRule | str:
    """A source's rule, or what is wrong with it."""
    doc = json.loads(document)
    try:
        return _JsonRule(doc) if strategy == JSON else _PageRule(doc)
    except BadRule as fault:
        return str(fault)


#: Rules that a worker has compiled; not more than a few megabytes.
_RULES: dict[tuple[str, str], _PageRule | _JsonRule | str] = {}


def _rule(strategy: str, document: str) -> _PageRule | _JsonRule | str:
    if (rule := _RULES.get((strategy, document))) is None:
        if len(_RULES) >= MOST_RULES:
            _RULES.clear()
        rule = _RULES[strategy, document] = compiled(strategy, document)
    return rule


def _inner_page(body: str) -> str:
    """``html`` of a JSON wrapper, or the body itself where it is not one."""
    try:
        inner = _strict(body)
    except (ValueError, RecursionError):
        return body
    return inner["html"] if isinstance(inner, dict) and isinstance(inner.get("html"), str) else body


def _read_one(body: str | None, strategy: str | None, document: str | None) -> tuple[str | None, list[Item]]:
    if document is None:
        return "sin_regla", []
    if strategy != JSON and strategy not in PAGES:
        return "estrategia_desconocida", []
    rule = _rule(strategy, document)
    if isinstance(rule, str):
        return rule, []
    body = body or ""
    return rule.read(_inner_page(body) if strategy == "wp_ajax" else body)


def _read_batch(bodies: pa.Array, strategies: pa.Array, documents: pa.Array) -> pa.Array:
    """Items of each body of a batch by the rule beside it, and the reason where there are none to be had."""
    rows = zip(bodies.to_pylist(), strategies.to_pylist(), documents.to_pylist(), strict=True)
    return pa.array([dict(zip(("motivo", "items"), _read_one(*row), strict=True)) for row in rows], ARROW_READ)


read_items = F.arrow_udf(_read_batch, READ)


def rule_document(rule: object) -> str:
    """An ``HtmlRule`` or ``JsonMapping`` as the JSON text of a rule document."""
    fields = {k: v for k, v in asdict(rule).items() if v is not None}  # type: ignore[call-overload]
    patterns = fields.pop("patrones", None)
    if patterns is None:
        return json.dumps({"json_mapping": fields}, sort_keys=True)
    return json.dumps({"selectores": fields, "normalizadores": {f: {"regex_extraction": p} for f, p in patterns.items()}}, sort_keys=True)


def with_items(captures: DataFrame, body: Column, strategy: Column, document: Column) -> DataFrame:
    """Captures with ``items`` and ``reject_reason``, the body being read once."""
    row = F.struct(read_items(body, strategy, document).alias("leido"))
    return captures.select("*", F.inline(F.array(row))).select("*", "leido.items", F.col("leido.motivo").alias("reject_reason")).drop("leido")
