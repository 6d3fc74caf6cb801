"""Incremental gap fill as keyed state: what was seen near a place is kept with the place.

An extension, beside ``gap_fill``, which reads the directory again for every batch.  Pins
are dealt to all cells within reach of them.  The state of a cell holds the directory pins
and all pins that arrived there; a pin is a gap if its own cell knows none of its class
within the radius.  So of pins that arrive near each other the first is the gap, within one
batch the one with the smallest id, whether or not a directory pin matched it.

State lives in the checkpoint: a query that is started again goes on where it stopped and
tells no gap twice.  Needs the state store that keyed state is built on
(``spark.sql.streaming.stateStore.providerClass`` of RocksDB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pinfold.functions.geo import DEGREE_M, EARTH_M, cell
from pinfold.operators.cells import within_reach
from pinfold.runtime import ship_package

PIN = "row_id bigint, rel int, lat double, lon double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _dealt(pins: DataFrame, radius_m: float, per_degree: float) -> DataFrame:
    """Pins in all cells within reach; ``home`` marks their own."""
    own = (cell("lat", per_degree) == F.col("ci")) & (cell("lon", per_degree) == F.col("cj"))
    near = within_reach(pins.select("row_id", F.col("rel").cast("int").alias("rel"), "lat", "lon"), radius_m, per_degree)
    return near.select("ci", "cj", "row_id", "rel", "lat", "lon", own.alias("home"))


def metres(a: float, b: float, c: float, d: float) -> float:
    half = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(half)))


class CellProcessor(StatefulProcessor):
    """The pins of one cell and its surroundings, by class."""

    def __init__(self, radius_m: float) -> None:
        self.radius_m = radius_m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "rel int", "pins array<struct<lat: double, lon: double>>")

    def _of(self, rel: int) -> list:
        return [(p[0], p[1]) for p in self.known.getValue((rel,))[0]] if self.known.containsKey((rel,)) else []

    def _learn(self, rows: list, telling: bool) -> list[tuple]:
        gaps, by_class = [], {}
        for row_id, rel, lat, lon, home in sorted(rows):
            near = by_class.setdefault(rel, self._of(rel))
            if telling and home and not any(metres(lat, lon, y, x) <= self.radius_m for y, x in near):
                gaps.append((row_id, rel, lat, lon))
            near.append((lat, lon))
        for rel, near in by_class.items():
            self.known.updateValue((rel,), (near,))
        return gaps

    @staticmethod
    def _rows(frames: Iterator[pd.DataFrame]) -> list:
        return [r for f in frames for r in f[["row_id", "rel", "lat", "lon", "home"]].itertuples(index=False, name=None)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        gaps = self._learn(self._rows(rows), True)
        yield pd.DataFrame(gaps, columns=["row_id", "rel", "lat", "lon"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._learn(self._rows(iter([initialState])), False)

    def close(self) -> None:
        pass


def keyed_gap_fill(external: DataFrame, directory: DataFrame, radius_m: float = 250.0) -> DataFrame:
    """The streaming table ``row_id, rel, lat, lon`` of the gaps among ``external`` pins.

    Cells are a little wider than the radius, so a pin is dealt to nine at most away from
    the poles.  The directory is read once, when the query first starts.
    """
    ship_package(external.sparkSession)
    per_degree = DEGREE_M / (radius_m * 1.05)
    key = ["ci", "cj"]
    held = _dealt(directory, radius_m, per_degree).groupBy(*key)
    return _dealt(external, radius_m, per_degree).groupBy(*key).transformWithStateInPandas(
        statefulProcessor=CellProcessor(radius_m), outputStructType=PIN, outputMode="Append", timeMode="None", initialState=held
    )
