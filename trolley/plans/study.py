"""One basket study: lines → clean baskets → item counts → mined tables.

A study is built lazily and kept per (application, folder, spec) and state of
the input files (paths, lengths, modification times): a table that was written
anew gives a new study, and the one of the old files is released. The clean
baskets and the mined tables are checkpointed once (and kept cached), the
item counts are cached, and every dashboard query reads them. Baskets and
item counts depend on the source and the item alone: studies that differ in
thresholds share them, so moving a slider scans nothing again.
``MiningResult.filtered`` derives stricter settings without re-mining.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from trolley.operators import baskets as B
from trolley.operators import items as I
from trolley.operators.mining import MiningParams, MiningResult, mine
from trolley.session import delete_path, materialize
from trolley.sources import tables


@dataclass(frozen=True)
class BasketSpec:
    """Where baskets come from and how they are mined."""

    source: str = "orders"  # "orders": lineitem ⋈ part; "events": user events
    item: str = "p_brand"  # part column for "orders"
    min_support: float = 0.005
    min_confidence: float = 0.1
    num_partitions: int | None = None  # FP-growth item groups; default: input partitions

    def params(self) -> MiningParams:
        return MiningParams(self.min_support, self.min_confidence, self.num_partitions)


DEFAULT_SPEC = BasketSpec()


class Study:
    def __init__(self, spark: SparkSession, sf_dir: str, spec: BasketSpec = DEFAULT_SPEC, base: "Study | None" = None):
        self.base = base  # whose baskets and item counts are used
        self.spark = spark
        self.sf_dir = sf_dir
        self.spec = spec
        self._baskets: DataFrame | None = None
        self._counts: DataFrame | None = None
        self._mined: MiningResult | None = None
        self._memo: dict[str, DataFrame] = {}
        self.folders: list[str] = []  # written under the shared folder; removed by release()
        self._lock = threading.RLock()
        self._given: DataFrame | None = None
        self._params = spec.params()

    @classmethod
    def of_baskets(cls, baskets: DataFrame, params: MiningParams) -> "Study":
        """A study over clean ``(basket_id, items)`` baskets from anywhere,
        e.g. a folded and cleaned wide CSV (``wide_csv_study``)."""
        spec = BasketSpec(source="frame", item="", min_support=params.min_support, min_confidence=params.min_confidence)
        s = cls(baskets.sparkSession, "", spec)
        s._given = baskets
        s._params = params
        return s

    def lines(self) -> DataFrame:
        if self.spec.source == "orders":
            return tables.order_lines(self.spark, self.sf_dir, self.spec.item)
        if self.spec.source == "events":
            return tables.user_events(self.spark, self.sf_dir)
        raise ValueError(f"unknown basket source {self.spec.source!r}")

    @property
    def baskets(self) -> DataFrame:
        if self.base is not None:
            return self.base.baskets
        with self._lock:
            if self._baskets is None:
                b = self._given if self._given is not None else B.from_lines(self.lines(), "basket", "item")
                # Every view reads the baskets: write them once to the shared
                # checkpoint folder (when named) so that a lost executor costs a
                # re-read of those files, not a re-scan and re-shuffle of the lines.
                self._baskets = materialize(b)
            return self._baskets

    @property
    def item_counts(self) -> DataFrame:
        if self.base is not None:
            return self.base.item_counts
        base = self.baskets
        with self._lock:
            if self._counts is None:
                self._counts = I.item_counts(base).persist(StorageLevel.MEMORY_AND_DISK)
            return self._counts

    @property
    def mined(self) -> MiningResult:
        base = self.baskets
        with self._lock:
            if self._mined is None:
                self._mined = mine(base, self._params)
            return self._mined

    def memo(self, key: str, build) -> DataFrame:
        """A derived frame built once per study (``build(study)``)."""
        with self._lock:
            if key not in self._memo:
                self._memo[key] = build(self)
            return self._memo[key]

    def release(self) -> None:
        for df in (self._baskets, self._counts):
            if df is not None:
                df.unpersist(blocking=False)
        if self._mined is not None:
            self._mined.unpersist()
        self._baskets = self._counts = self._mined = None
        self._memo.clear()
        for folder in self.folders:
            delete_path(self.spark, folder)
        self.folders.clear()


def wide_csv_study(
    spark: SparkSession,
    path: str,
    params: MiningParams | None = None,
    drop_blank: bool = False,
    multi_line: bool = False,
    on_bad_count: str = "raise",
) -> Study:
    """The dashboard's own input: a wide transaction CSV, read, folded and
    cleaned, as a study (mined at ``params``, default 0.02 / 0.3).

    ``multi_line`` reads quoted newlines; ``on_bad_count="drop"`` leaves out
    rows whose count is no number (``bad_count_rows`` reports them)."""
    from trolley.sources.wide_csv import read_wide_csv

    wide = read_wide_csv(spark, path, multi_line=multi_line)
    baskets = B.clean(B.fold_wide(wide, on_bad_count=on_bad_count), drop_blank=drop_blank)
    return Study.of_baskets(baskets, params or MiningParams())


_STUDIES: dict[tuple, Study] = {}
_GUARD = threading.Lock()


def study(spark: SparkSession, sf_dir: str, spec: BasketSpec = DEFAULT_SPEC) -> Study:
    """The study for this session's application, folder and spec, of the files as they are now.

    Studies of one source and item share the baskets of the first; entries of
    applications that have stopped are dropped, those of files that have
    changed since are released."""
    app, folder = spark.sparkContext.applicationId, sf_dir.rstrip("/")
    lines = BasketSpec(source=spec.source, item=spec.item)
    state = tables.state(spark, sf_dir, spec.source)
    with _GUARD:
        for key in [k for k in _STUDIES if k[0] != app]:
            del _STUDIES[key]
        for key in [k for k in _STUDIES if k[1] == folder and k[2].source == spec.source and k[3] != state]:
            _STUDIES.pop(key).release()
        base = _STUDIES.get((app, folder, lines, state))
        if base is None:
            base = _STUDIES[app, folder, lines, state] = Study(spark, sf_dir, lines)
        found = _STUDIES.get((app, folder, spec, state))
        if found is None:
            found = _STUDIES[app, folder, spec, state] = Study(spark, sf_dir, spec, base)
        return found


def release_all() -> None:
    with _GUARD:
        for s in _STUDIES.values():
            s.release()
        _STUDIES.clear()
