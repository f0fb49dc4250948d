"""Metrics of a collection, gathered while it is computed for another purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Metrics:
    """Named metrics over the rows that pass: counters, distributions, latest and extreme values, sets of strings, histograms."""

    def __init__(self, name: str, **metrics: dict[str, Column]):
        self.observation, self.metrics = Observation(name), metrics

    @staticmethod
    def counter(what: Column | None = None) -> dict[str, Column]:
        """Rows, rows for which a condition holds, or the sum of a number."""
        return {"": F.count(F.lit(1)) if what is None else F.sum(what.cast("bigint"))}

    @staticmethod
    def total(value: str) -> dict[str, Column]:
        return {"": F.sum(value)}

    @staticmethod
    def distribution(value: str) -> dict[str, Column]:
        return {"count": F.count(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}

    @staticmethod
    def gauge(value: str, ts: str) -> dict[str, Column]:
        """The value of the latest row."""
        return {"": F.max_by(value, ts)}

    @staticmethod
    def extremes(value: str, n: int) -> dict[str, Column]:
        """The n largest and smallest distinct values; n is to be small."""
        values = F.sort_array(F.collect_set(value))
        return {"top": F.slice(F.reverse(values), 1, n), "bottom": F.slice(values, 1, n)}

    @staticmethod
    def strings(value: str) -> dict[str, Column]:
        return {"": F.array_sort(F.collect_set(value))}

    @staticmethod
    def histogram(value: str, edges: list[float]) -> dict[str, Column]:
        bounds = [None, *edges, None]
        inside = lambda lo, hi: (F.lit(True) if lo is None else F.col(value) >= lo) & (F.lit(True) if hi is None else F.col(value) < hi)
        return {str(k): F.count_if(inside(lo, hi)) for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}

    def observe(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *(c.alias(f"{name}.{part}" if part else name) for name, parts in self.metrics.items() for part, c in parts.items()))

    def get(self) -> dict:
        """The values, once an action has run over the observed DataFrame."""
        got, out = self.observation.get, {}
        for name, parts in self.metrics.items():
            out[name] = got[name] if "" in parts else {p: got[f"{name}.{p}"] for p in parts}
        return out
