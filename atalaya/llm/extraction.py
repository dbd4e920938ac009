"""Main text of pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.functions.markup import Markup
from atalaya.llm.common import rows_of, whole_text

#: Lines that one window sums over.
WINDOW = 3
#: Letters and digits that a window must hold for a surge, or the most that any window of the page holds if that is less.
SURGE = 20
# Element names and the words in class, id and role that mark what is not the article.
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROOTS = frozenset(("html", "body", "article", "main"))
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer discussion footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "notices overlay pagination popup promo related reply replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: A name begins where its stretch of name characters does, so a long stretch without a value is read once.
ATTRIBUTE = re.compile(r"""(?<![^\s"'=<>/])([^\s"'=<>/]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z]+")
NO_LETTERS = re.compile(r"[\W_]+")


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return True
    if tag in ROOTS or not attributes:
        return False
    if re.search(r"(?:^|\s)hidden(?:$|[\s=/])", re.sub(ATTRIBUTE, " ", attributes)):
        return True
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and HINTS & set(WORD.findall(value)) or name == "role" and value in ROLES:
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, bool, bool, int]]:
    """Lines of a page with markup stripped: (text, is boilerplate, is in an article, letters and digits outside links)."""
    lines: list[tuple[str, bool, bool, int]] = []
    parts: list[str] = []
    loose = at = articles = link = 0
    dropped, depth = "", 0
    markup = Markup(page, quoted_only=True, sections=True)

    def end_line() -> None:
        nonlocal loose
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, bool(dropped), articles > 0, loose))
        parts.clear()
        loose = 0

    def add(text: str) -> None:
        nonlocal loose
        if text:
            parts.append(text)
            loose += 0 if link else len(NO_LETTERS.sub("", text))

    while True:
        found = markup.next(at)
        add(html.unescape(page[at : found.start if found else len(page)]))
        if not found:
            break
        at, tag, closing, attributes = found.end, found.tag.lower(), found.closing, found.attributes
        add(found.content)
        if not tag:
            continue
        if tag in RAW and not closing:
            end = markup.end_of(tag, at)
            at = end[1] if end and end[1] <= len(page) else at if attributes.rstrip().endswith("/") else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag in BLOCKS:
            end_line()
        if dropped:
            if tag == dropped:
                depth += -1 if closing else 1
                if not depth:
                    end_line()
                    dropped = ""
        elif not closing and tag not in VOID and is_boilerplate(tag, attributes, articles > 0):
            end_line()
            dropped, depth = tag, 1
        elif tag in ("article", "main"):
            articles = max(0, articles + (-1 if closing else 1))
    end_line()
    return lines


def main_text(page: str, window: int = WINDOW) -> tuple[str, int, int]:
    """Main text, first and last kept line (-1 where nothing is kept).

    Every line weighs its letters and digits outside links; boilerplate lines weigh nothing. Where a page has article
    elements, their lines weigh as a surge at least, links and all, and what lies outside them weighs nothing: there
    the elements decide. A surge is where the sum over a window reaches SURGE, a dive where it falls back to
    zero; a stretch also holds the lines before its surge back to the last zero. All stretches with a surge are kept.
    """
    lines = page_lines(page)
    if not lines:
        return "", -1, -1
    marked = any(inside and not dropped for _, dropped, inside, _ in lines)
    usable = np.array([not dropped and (inside or not marked) for _, dropped, inside, _ in lines])
    weight = np.array([len(t) + SURGE if inside else loose for t, _, inside, loose in lines]) * usable
    sums = np.convolve(weight, np.ones(window, np.int64)).astype(np.int64)
    up = np.flatnonzero((sums > 0) & (np.concatenate([[0], sums[:-1]]) == 0))
    down = np.flatnonzero((sums > 0) & (np.concatenate([sums[1:], [0]]) == 0)) - window + 1
    if not len(up):
        return "", -1, -1
    surge = np.maximum.reduceat(sums, up) >= min(SURGE, sums.max())
    stretches = list(zip(up[surge].tolist(), down[surge].tolist(), strict=True))
    kept = [lines[i][0] for a, b in stretches for i in range(a, b + 1) if usable[i]]
    return "\n\n".join(kept), stretches[0][0], stretches[-1][1]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, first_line, last_line for every page.

    Null or empty html, and pages without main text, give an empty text and lines -1. Unclosed elements end with
    the page. Repeated rows are read each for itself; other columns of pages are not needed.
    """
    kinds = "page_id long, url string, text string, n_chars long, first_line long, last_line long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_of(batches):
            texts, first, last = zip(*(main_text(x) for x in table.column("data").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("page_id").combine_chunks(),
                    table.column("url").combine_chunks(),
                    pa.array(texts, pa.string()),
                    *(pa.array(x, pa.int64()) for x in (list(map(len, texts)), first, last)),
                ],
                ["page_id", "url", "text", "n_chars", "first_line", "last_line"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole_text("html").alias("data"))
    return rows.mapInArrow(run, kinds)
