"""An ordered set of detectors that can be switched off, with a second wave that sees the first one's results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = ("transaction_id", "detector", "suspicious", "confidence", "risk_score", "findings", "patterns")


class Detector(NamedTuple):
    """run(transactions, results so far or None) -> the columns of RESULT but for `detector`."""

    name: str
    run: Callable[[DataFrame, DataFrame | None], DataFrame]
    deferred: bool = False


class Registry:
    """Detectors in order. A name that is registered again replaces the older one where it stands."""

    def __init__(self):
        self.detectors: list[Detector] = []
        self.off: set[str] = set()
        self.failures: dict[str, str] = {}

    def register(self, detector: Detector, position: int | None = None) -> None:
        names = self.names()
        if detector.name in names:
            self.detectors[names.index(detector.name)] = detector
        else:
            self.detectors.insert(len(names) if position is None else position, detector)

    def unregister(self, name: str) -> None:
        self.detectors = [d for d in self.detectors if d.name != name]

    def switch(self, name: str, on: bool) -> None:
        self.off = self.off - {name} if on else self.off | {name}

    def names(self) -> list[str]:
        return [d.name for d in self.detectors]

    def run(self, t: DataFrame) -> DataFrame | None:
        """The results of all detectors that are on, one row a transaction and detector; None without any. Those that
        are deferred come last, one by one, and see the results before them. A detector whose plan can't be made,
        for want of a column for instance, is left out and reported in `failures`; an error in a row fails the job."""
        self.failures, done = {}, []
        on = [d for d in self.detectors if d.name not in self.off]
        for d in [d for d in on if not d.deferred] + [d for d in on if d.deferred]:
            seen = reduce(DataFrame.unionByName, done) if done and d.deferred else None
            try:
                done.append(d.run(t, seen).withColumn("detector", F.lit(d.name)).select(*RESULT))
            except Exception as error:  # noqa: BLE001  whatever a detector raises is reported
                self.failures[d.name] = f"{type(error).__name__}: {error}"
        return reduce(DataFrame.unionByName, done) if done else None
