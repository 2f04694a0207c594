"""Statistics of a run, taken on the stages that run anyway: no job and no scan of their own."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import InputError
from ..session import pin


class RunStatistics:
    """Measures by stage, observed while ``pinned`` writes the stage's table, with the seconds that took."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}
        self._seconds: dict[str, float] = {}

    def pinned(self, stage: str, df: DataFrame, measures: dict[str, Column]) -> DataFrame:
        """``df`` in the shared folder; ``measures`` are aggregates over its rows."""
        if stage in self._seen:
            raise InputError(f"stage {stage} is observed already")
        self._seen[stage] = Observation(stage)
        began = time.perf_counter()
        out = pin(df.observe(self._seen[stage], *[F.coalesce(m.cast("double"), F.lit(0.0)).alias(name) for name, m in measures.items()]))
        self._seconds[stage] = time.perf_counter() - began
        return out

    def values(self, stage: str) -> dict[str, float]:
        return self._seen[stage].get

    def rows(self, spark: SparkSession, seconds: bool = False) -> DataFrame:
        """``stage, measure, value``: one row a measure; with ``seconds`` also the time of each stage, which no two runs share."""
        made = [(stage, name, value) for stage in self._seen for name, value in self.values(stage).items()]
        made += [(stage, "seconds", taken) for stage, taken in self._seconds.items() if seconds]
        return spark.createDataFrame(made, "stage string, measure string, value double")


def lengths(column: str, buckets: int = 24) -> dict[str, Column]:
    """Count, sum, mean, exact median, extremes and a histogram by powers of two of a column of lengths."""
    c = F.col(column)
    histogram = {f"from_{1 << k}_below_{2 << k}": F.count_if((c >= 1 << k) & (c < 2 << k)) for k in range(buckets)}
    return {"rows": F.count("*"), "bases": F.sum(c), "mean": F.avg(c), "median": F.percentile(c, F.lit(0.5)), "shortest": F.min(c), "longest": F.max(c), "empty": F.count_if(c == 0)} | histogram


def by_value(column: str, values) -> dict[str, Column]:
    """How many rows have each of the stated values."""
    return {f"{column}_{v}": F.count_if(F.col(column) == v) for v in values}


def seed_measures(max_frequency: int, times: str | None = None) -> dict[str, Column]:
    """Of ``minimiser_frequency``, or of frequencies with ``times`` as the number of minimisers: distinct minimisers, their places, those that the bound leaves, and the pairs that a join of them can give at most."""
    n, w = F.col("frequency"), F.lit(1).cast("long") if times is None else F.col(times)
    kept = n <= max_frequency
    return {
        "unique_minimisers": F.sum(w), "observations": F.sum(w * n), "discarded_minimisers": F.sum(F.when(~kept, w)), "retained_observations": F.sum(F.when(kept, w * n)),
        "pair_bound": F.sum(F.when(kept, w * F.expr("frequency * (frequency - 1) div 2"))), "most_frequent": F.max(n),
    }


def guard_seed_pairs(statistics: RunStatistics, stage: str, max_seed_pairs: int | None) -> None:
    """Stops a run before its self-join of seeds if the bound that ``stage`` observed is above ``max_seed_pairs``."""
    bound = int(statistics.values(stage)["pair_bound"])
    if max_seed_pairs is not None and bound > max_seed_pairs:
        raise InputError(f"seed pairs may reach {bound}, more than {max_seed_pairs}")
