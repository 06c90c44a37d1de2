"""What the stages of a pipeline take and bring: times by label, and counts of rows that come with a job of their own accord."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class Stages:
    """Times and counts of one run, by label; a label that comes up again is added to."""

    def __init__(self, title: str):
        self.title, self.began = title, time.perf_counter()
        self.ms: dict[str, float] = {}
        self._seen: dict[str, list[Observation]] = {}

    @contextmanager
    def stage(self, label: str) -> Iterator[None]:
        """Time a block, whether it ends well or not. Spark works when a result is asked for, so time where that is done."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.ms[label] = self.ms.get(label, 0.0) + (time.perf_counter() - began) * 1000

    def observed(self, df: DataFrame, label: str, text: str | None = None, document: str | None = None) -> DataFrame:
        """df; whatever job runs through it counts its rows, characters of text and, by sketch, distinct documents."""
        own = Observation()
        self._seen.setdefault(label, []).append(own)
        counts = [F.count(F.lit(1)).alias("rows")]
        if text:
            counts.append(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("characters"))
        if document:
            counts.append(F.approx_count_distinct(document, 0.01).alias("documents"))
        return df.observe(own, *counts)

    def counts(self) -> dict[str, dict[str, int]]:
        """Counts by label, added up; to be asked for when the jobs are done (it waits for them)."""
        out: dict[str, dict[str, int]] = {}
        for label, seen in self._seen.items():
            total = out.setdefault(label, {})
            for one in seen:
                for name, n in one.get.items():
                    total[name] = total.get(name, 0) + n
        return out

    def done(self) -> float:
        """Log a summary; the milliseconds in all."""
        total = (time.perf_counter() - self.began) * 1000
        log.info("\n".join([f"{self.title}: {total:.0f} ms", *(f"  {k}: {v:.0f} ms" for k, v in self.ms.items())]))
        return total
