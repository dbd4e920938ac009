"""The markup reader: what it finds, and that its time grows with the page, however broken."""

import json
import time

import pytest

from atalaya.functions.dom import _Nodes, readable
from atalaya.functions.markup import Markup
from atalaya.operators.extract_html import _cards_of, _links_of
from atalaya.operators.extract_rules import _read_one

SIZE = 1_000_000
HOSTILE = ["<b", "<a ", '<a "', "<a '", "<!--", "<!", "<", "<a x=", "</script", "<script></script", "<a " + "x" * 24_000]


def tokens(html, **how):
    markup, at, out = Markup(html, **how), 0, []
    while found := markup.next(at):
        out.append((html[found.start : found.end], found.closing, found.tag, found.attributes))
        at = found.end
    return out


def test_tokens():
    assert tokens("a<P>b</p ><br/>") == [("<P>", False, "P", ""), ("</p >", True, "p", " "), ("<br/>", False, "br", "/")]
    assert tokens('<a title="x > y" b>z') == [('<a title="x > y" b>', False, "a", ' title="x > y" b')]
    assert tokens("<a title='<b>'>") == [("<a title='<b>'>", False, "a", " title='<b>'")]
    assert tokens("1 < 2 <3> <-- <>") == []
    assert [t[0] for t in tokens("<!-- <p> --><!doctype html><?x y?><!-- open <p>")] == ["<!-- <p> -->", "<!doctype html>", "<?x y?>", "<!-- open <p>"]
    assert tokens('<a b="c>d<p>') == [('<a b="c>', False, "a", ' b="c'), ("<p>", False, "p", "")]
    assert tokens('<a b="c>d<p>', quoted_only=True) == [("<p>", False, "p", "")]
    assert tokens("<p>x</p", quoted_only=True) == [("<p>", False, "p", "")]
    assert [m[2] for m in tokens("<![CDATA[ <p> ]]><b>", sections=True)] == ["", "b"]


def test_end_of():
    markup = Markup("<script>a</scripts>b</SCRIPT x>c</script>d</script")
    assert markup.end_of("script", 8) == (20, 31) and markup.end_of("script", 21) == (32, 41)
    assert markup.end_of("script", 35) == (42, 51) and markup.end_of("script", 45) is None and markup.end_of("script", 8) == (20, 31)


@pytest.mark.parametrize("unit", HOSTILE)
@pytest.mark.parametrize("tail", ["", ">", "\">'"])
def test_hostile_pages_are_read_in_linear_time(unit, tail):
    html = "<p>x</p>" + unit * (SIZE // len(unit)) + tail
    start = time.process_time()
    page = _Nodes(html)
    assert time.process_time() - start < 4
    assert page.tag[0] == "p" and page.text[1] == "x"


def test_end_tags_of_nothing_under_many_open_elements():
    start = time.process_time()
    page = _Nodes("<b>" * 100_000 + "</i>" * 100_000 + "x")
    assert time.process_time() - start < 4 and len(page.tag) == 100_001


def test_broken_page_keeps_its_text():
    assert readable("<p>one</p><b<b<b two", frozenset(), frozenset()) == ["one", "<b<b<b two"]
    assert readable("<script>if (a<b) {}</script>x<style>p{}", frozenset({"script", "style"}), frozenset()) == ["x"]


def test_nested_containers_cost_no_more_than_their_page():
    n = 3000
    rule = json.dumps({"selectores": {"contenedor_items": "div.item", "identificador": "attr:data-id", "titulo": "h2.t", "descripcion": ".no, .item .no", "estado": "b.no"}})
    start = time.perf_counter()
    reason, items = _read_one("<div class='item' data-id=7>" * n + "<h2 class=t>x &amp; y</h2>", "html_static", rule)
    assert time.perf_counter() - start < 10
    assert reason is None and [x["pos"] for x in items] == list(range(n)) and {(x["identificador"], x["titulo"]) for x in items} == {("7", "x & y")}


def test_links_and_cards_of_a_page():
    html = "<a>no</a><a href=''>y</a><div style='x background-color:y'><h2> A <b>b</b></h2><a class='c'>n</a><a class='btn c' href='/p'>Ver <i>ya</i></a></div>"
    assert _links_of(html) == [{"pos": 0, "href": "", "texto": "y"}, {"pos": 1, "href": "/p", "texto": "Verya"}]
    assert _cards_of(html) == [{"pos": 0, "titulo": "Ab", "href": "/p", "_p": None}]
