"""The end of a page series, found while its pages come in, in any order.

State is a few numbers per run and per page that waits; bodies never enter it. A page comes out once all pages before
it have come and none of them has ended the series, so what follows need not wait for the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from atalaya import fixed_values as fixed
from atalaya.sources.paging import RUN

KEPT = "fuente_id string, run_id string, page bigint"


@dataclass(frozen=True)
class StopRule:
    """What a page says about its series: it ends before the page, it ends with the page, how many pages there are.

    ``unknown``: the number of pages where the first one never comes; none means no limit.
    """

    before: Column | None = None
    after: Column | None = None
    limit: Column | None = None
    unknown: int | None = None


def short_pages(size: int) -> StopRule:
    """Ends with the first page of fewer than ``size`` items, or before one that is not a list."""
    return StopRule(before=F.col("n_items").isNull(), after=F.col("n_items") < size)


def declared_total() -> StopRule:
    """As many pages as the first one declares (none declared: one); an empty page ends the series."""
    declared = F.greatest(F.coalesce(F.col("total_pages"), F.lit(1)), F.lit(1))
    return StopRule(after=F.col("n_items") == 0, limit=F.when(F.col("page") == 1, declared), unknown=1)


def found_count(page_size: int = fixed.FOUND_PAGE_SIZE) -> StopRule:
    """As many pages as the count that the first one found needs; ends before an empty page."""
    enough = F.when((F.col("page") == 1) & (F.col("found") > 0), F.ceil(F.col("found") / page_size))
    return StopRule(before=F.coalesce(F.col("html"), F.lit("")) == "", limit=enough)


class Series(StatefulProcessor):
    """Per run: the next page to come out, the limit, whether the series has ended; the pages that wait, by number."""

    def __init__(self, unknown: int | None, quiet_ms: int) -> None:
        self.unknown, self.quiet_ms = unknown, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("serie", "siguiente bigint, limite bigint, terminada boolean, ultima bigint")
        self.waiting = handle.getMapState("pendientes", "page bigint", "antes boolean, despues boolean, limite bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, limit, ended, last = self.run.get() if self.run.exists() else (1, None, False, 0)
        new: dict[int, tuple] = {}
        for chunk in rows:
            last = max(last, int(chunk["milis"].max()))
            for page, before, after, most in chunk[["page", "antes", "despues", "limite"]].itertuples(index=False, name=None):
                page, most = int(page), None if pd.isna(most) else int(most)
                old = new.get(page, (False, False, None))
                both = [m for m in (old[2], most) if m is not None]
                new[page] = (bool(old[0] or before), bool(old[1] or after), max(both, default=None))
        out = []
        while not ended and (following in new or self.waiting.containsKey((following,))):
            if following in new:
                facts = new.pop(following)
            else:
                facts = self.waiting.getValue((following,))
            if self.waiting.containsKey((following,)):
                self.waiting.removeKey((following,))
            limit, ended = self._walk(following, facts, limit, out)
            following += 1
        if ended:
            self.waiting.clear()
        else:
            for page, facts in new.items():
                if page >= following and not self.waiting.containsKey((page,)):
                    self.waiting.updateValue((page,), facts)
        self.run.update((following, limit, ended, last))
        self.handle.registerTimer(last + self.quiet_ms)
        if out:
            yield self._kept(key, out)

    @staticmethod
    def _walk(page: int, facts: tuple, limit: int | None, out: list[int]) -> tuple[int | None, bool]:
        """Take the next page of a series if it belongs to it; the limit, and whether the series ends here."""
        before, after, most = facts
        limit = most if limit is None else limit
        if before or (limit is not None and page > limit):
            return limit, True
        out.append(page)
        return limit, bool(after) or page == limit

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A quiet run is closed: the pages behind a gap come out too, by the same rule."""
        if not self.run.exists():
            return
        following, limit, ended, last = self.run.get()
        if last + self.quiet_ms > timerValues.getCurrentWatermarkInMs():
            return
        out: list[int] = []
        if following == 1 and limit is None:
            limit = self.unknown
        for (page,), facts in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            if ended:
                break
            limit, ended = self._walk(page, facts, limit, out)
        self.waiting.clear()
        self.run.clear()
        if out:
            yield self._kept(key, out)

    @staticmethod
    def _kept(key, pages: list[int]) -> pd.DataFrame:
        return pd.DataFrame([(*key, p) for p in pages], columns=[*RUN, "page"])

    def close(self) -> None:
        pass


def stream_pages(
    pages: DataFrame, rule: StopRule, max_pages: int | None = None, delay: str = "1 hour", quiet_hours: float = 12
) -> DataFrame:
    """Run and number of every page that counts, each once, as soon as the pages before it are there.

    ``pages``: a stream with the run, ``page`` (from 1), ``fecha_captura`` and what ``rule`` reads. Pages behind a gap wait,
    and come out when the watermark (``delay`` behind the newest capture) is ``quiet_hours`` past the run's last page; then the
    run's state goes, and a run that comes again after that begins anew. So closed runs equal the batch operators over
    all their pages. Of a page that landed again the first copy counts (copies in one trigger: any that ends the series, and the
    largest limit). Rows without a page number or capture time are left out; null runs are a run like any other.
    Bodies stay where they landed: join them to the result by run and page.
    """
    limits = [rule.limit, None if max_pages is None else F.lit(max_pages)]
    limits = [c.cast("bigint") for c in limits if c is not None] + [F.lit(None).cast("bigint")] * 2
    before, after = (F.lit(False) if c is None else F.coalesce(c, F.lit(False)) for c in (rule.before, rule.after))
    facts = pages.select(
        *[F.col(k).cast("string").alias(k) for k in RUN],
        F.col("page").cast("bigint").alias("page"),
        F.col("fecha_captura").cast("timestamp").alias("instante"),
        F.unix_millis(F.col("fecha_captura").cast("timestamp")).alias("milis"),
        before.alias("antes"),
        after.alias("despues"),
        F.least(*limits).alias("limite"),
    )
    timed = facts.where("page >= 1 and instante is not null").withWatermark("instante", delay)
    unknown = min((n for n in (rule.unknown, max_pages) if n is not None), default=None)
    series = Series(unknown, int(quiet_hours * 3_600_000))
    return timed.groupBy(*RUN).transformWithStateInPandas(series, KEPT, "Append", "EventTime")
