"""Weather cells as keyed state: rolling features from a buffer that days are merged into, and alerts by timers.

The state of a cell is the last rows of its archive and a summary of the older ones (``Buffer``, made from a table by
``weather.folded``). A changed day replaces or joins its row; what leaves the buffer is merged into the summary. Features, the
age of the trigger included, come from the state alone, so no batch reads the archive. A timer two days after a cell's last day,
in event time, reports it once as stale; a later day reports it as fresh again. Cells that are watched and have no day are reported as
soon as time has begun to pass.

Days may come late, repeated and in any order; of several values of one day the one with the highest ``batch`` counts. A day that
is older than a full buffer cannot be merged, as the summary does not tell its rows apart; it is reported (``late``), and the cell's state is to be folded
from the archive again. With a buffer of more rows than the days of lateness of ``daily_stream`` that does not happen to days of a stream. Needs the state store
that keeps states on disk: ``configure``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import weather

ROWS, DAY_MS = 32, 86_400_000
STATE = "day array<int>, precip array<double>, temp array<double>, moist array<double>, older_temp double, older_moist double, older_since int, alerted boolean"
FIELDS = ("day", "precip", "temp", "moist", "older_temp", "older_moist", "older_since")


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class Buffer:
    """The newest rows (newest first) and a summary of the older ones: their newest known temperature and moisture, and how many of
    them are newer than the newest with a trigger's rain (None: there is no such row)."""

    day: list[int] = field(default_factory=list)
    precip: list[float] = field(default_factory=list)
    temp: list[float | None] = field(default_factory=list)
    moist: list[float | None] = field(default_factory=list)
    older_temp: float | None = None
    older_moist: float | None = None
    older_since: int | None = None

    def put(self, day: int, precip: float, temp: float | None, moist: float | None, rows: int = ROWS) -> bool:
        """Merges a day; False if it is older than a full buffer."""
        at = next((k for k, d in enumerate(self.day) if d <= day), len(self.day))
        new = at == len(self.day) or self.day[at] != day
        if new and at == len(self.day) and at >= rows:
            return False
        for values, value in ((self.day, day), (self.precip, precip), (self.temp, temp), (self.moist, moist)):
            if new:
                values.insert(at, value)
            else:
                values[at] = value
        if len(self.day) > rows:
            self._age(*(values.pop() for values in (self.day, self.precip, self.temp, self.moist)))
        return True

    def _age(self, day: int, precip: float, temp: float | None, moist: float | None) -> None:
        """The oldest row of the buffer becomes the newest of the older ones."""
        self.older_temp = self.older_temp if temp is None else temp
        self.older_moist = self.older_moist if moist is None else moist
        if precip >= weather.TRIGGER_MM:
            self.older_since = 0
        elif self.older_since is not None:
            self.older_since += 1

    def features(self, windows: list[int]) -> dict:
        known = lambda values, older: next((v for v in values if v is not None), older)
        since = next((k for k, p in enumerate(self.precip) if p >= weather.TRIGGER_MM), None)
        if since is None and self.older_since is not None:
            since = len(self.day) + self.older_since
        recent = [t for t in self.temp[: weather.SHOCK_ROWS] if t is not None]
        rain = {f"rain_{n}": sum(self.precip[:n]) for n in windows}
        return {"last_day": self.day[0], **rain, "temp": known(self.temp, self.older_temp), "moist": known(self.moist, self.older_moist), "recent": max(recent, default=None), "days_since_trigger": since}


def due(last_day: int) -> int:
    """When a cell falls behind: as the second day after its last one begins. The watermark stays a millisecond behind that time,
    for rows at the watermark itself count as late."""
    return (last_day + 2) * DAY_MS - 1


def _plain(v):
    """None instead of the missing values of pandas."""
    return None if v is None or v != v else v


class CellWatch(StatefulProcessor):
    """Merges changed days into the state of their cell. Rows out have a kind: features, stale, fresh or late."""

    def __init__(self, windows: list[int], rows: int = ROWS, key: str = "meteo_cell_id"):
        if rows < max([*windows, weather.SHOCK_ROWS]):
            raise ValueError("the buffer is shorter than a window")
        self.windows, self.rows, self.key = windows, rows, key
        self.columns = ["kind", "last_day", *(f"rain_{n}" for n in windows), "temp", "moist", "recent", "days_since_trigger"]

    def schema(self) -> str:
        return f"{self.key} string, kind string, last_day int, " + "".join(f"rain_{n} double, " for n in self.windows) + "temp double, moist double, recent double, days_since_trigger int"

    def init(self, handle) -> None:
        self.handle, self.cell = handle, handle.getValueState("cell", STATE)

    def _load(self) -> tuple[Buffer, bool, int | None]:
        """The buffer, whether the cell is reported as stale, and its timer: a cell has one until it is reported."""
        row = self.cell.get()
        if row is None:
            return Buffer(), False, None
        values = [list(v or []) for v in row[:4]]
        return Buffer(*values, *row[4:7]), bool(row[7]), None if row[7] else due(values[0][0]) if values[0] else 1

    def _save(self, b: Buffer, alerted: bool) -> None:
        self.cell.update((b.day, b.precip, b.temp, b.moist, b.older_temp, b.older_moist, b.older_since, alerted))

    def _watch(self, last_day: int | None, old: int | None = None) -> None:
        """One timer for a cell: at the beginning of the second day after its last one; at once without any. ``old`` is the one there."""
        at = 1 if last_day is None else due(last_day)
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _rows(self, key, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{self.key: key[0], **dict.fromkeys(self.columns), **r} for r in rows], columns=[self.key, *self.columns], dtype=object)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        lists = [[_plain(v) for v in (() if r[c] is None else r[c])] for c in FIELDS[:4]]
        b = Buffer([int(d) for d in lists[0]], *lists[1:], _plain(r["older_temp"]), _plain(r["older_moist"]), None if _plain(r["older_since"]) is None else int(r["older_since"]))
        self._save(b, False)
        self._watch(b.day[0] if b.day else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b, alerted, timer = self._load()
        latest: dict[int, tuple] = {}
        for part in rows:
            for r in zip(*(part[c] for c in ("day", "batch", "precip_mm", "soil_temp_c", "soil_moist")), strict=True):
                if r[0] not in latest or latest[r[0]][1] <= r[1]:
                    latest[r[0]] = r
        out = []
        for day, _, *values in sorted(latest.values()):
            if not b.put(int(day), *map(_plain, values), rows=self.rows):
                out.append({"kind": "late", "last_day": int(day)})
        last = b.day[0]
        out.append({"kind": "features", **b.features(self.windows)})
        if alerted:
            alerted = due(last) <= timerValues.getCurrentWatermarkInMs()
            out.append({"kind": "stale" if alerted else "fresh", "last_day": last})
        if not alerted:
            self._watch(last, timer)
        self._save(b, alerted)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b, *_ = self._load()
        self._save(b, True)
        yield self._rows(key, [{"kind": "stale", "last_day": b.day[0] if b.day else None}])

    def close(self) -> None:
        pass


def watch(changes: DataFrame, profile: DataFrame, watched: DataFrame | None = None, archive: DataFrame | None = None, key: str = "meteo_cell_id", rows: int = ROWS) -> DataFrame:
    """Stream of key, kind and raw features from a stream of changed days (key, date, precip_mm, soil_temp_c, soil_moist, now, batch). Event
    time is ``now``, the time that the feed has come to; it never falls, so no change is too late. The cells of ``watched``, and what
    ``archive`` holds of all cells, are in the state from the beginning."""
    processor = CellWatch(weather.windows(profile), rows, key)
    days = changes.withColumn("day", F.unix_date("date")).withWatermark("now", "1 millisecond")
    start = None if archive is None else weather.folded(archive, rows, key)
    if watched is not None:
        cells = watched.select(key).distinct()
        start = cells.join(weather.folded(_no_days(cells, key), rows, key) if start is None else start, key, "full_outer")
    return days.groupBy(key).transformWithStateInPandas(processor, processor.schema(), "Update", "EventTime", None if start is None else start.groupBy(key))


def _no_days(cells: DataFrame, key: str) -> DataFrame:
    return cells.where("false").select(key, F.lit(None).cast("date").alias("date"), *[F.lit(None).cast("double").alias(c) for c in ("precip_mm", "soil_temp_c", "soil_moist")])


def features(events: DataFrame, profile: DataFrame, key: str = "meteo_cell_id") -> DataFrame:
    """What ``weather.features`` gives, from rows of kind features (one a cell)."""
    rows = events.where("kind = 'features'").withColumn("last_date", F.date_from_unix_date("last_day"))
    return weather.finished(rows, profile, key)


def latest(events: DataFrame, kinds: list[str], key: str = "meteo_cell_id") -> DataFrame:
    """The row of each cell with the highest batch among those of the kinds."""
    rest = [c for c in events.columns if c not in (key, "batch")]
    return events.where(F.col("kind").isin(kinds)).groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("e")).select(key, "e.*")


def stale(events: DataFrame, key: str = "meteo_cell_id") -> DataFrame:
    """key, last_date of the cells whose last report says stale."""
    found = latest(events, ["stale", "fresh"], key).where("kind = 'stale'")
    return found.select(key, F.date_from_unix_date("last_day").alias("last_date"))
