"""Direction of walkers as a stream: the rules of trailnet.operators.navigation with their state between micro-batches.

Positions are a list state of bounded length, the rest a value state. A key that has been silent is forgotten by a timer. A table of known walkers
can be the initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import navigation as N

_MIND = "mean_sq double, still_at long, moving_at long, motion string, a_lat double, a_lon double, k_lat double, k_lon double, course double, heading double, yaw double, reference double"


class Navigator(StatefulProcessor):
    """Rows of a micro-batch go in the order of ms; each comes out with the outputs of navigation.direction."""

    def __init__(self, idle_ms: int, step) -> None:
        self.idle_ms, self.step = idle_ms, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "lat double, lon double")
        self.mind = handle.getValueState("mind", _MIND)

    def _load(self) -> N.Direction | None:
        if not self.mind.exists():
            return None
        mean, still, moving, motion, alat, alon, klat, klon, *rest = self.mind.get()
        return N.Direction((mean, still, moving, motion) if motion else None, tuple(map(tuple, self.history.get())), None if alat is None else (alat, alon), None if klat is None else (klat, klon), *rest)

    def _save(self, d: N.Direction) -> None:
        none = (None, None)
        self.mind.update((*(d.moving or (None, None, None, None)), *(d.accepted or none), *(d.kept or none), d.course, d.heading, d.yaw, d.reference))
        if d.history:
            self.history.put(list(d.history))
        else:
            self.history.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._load()
        for row in sorted(rows, key=lambda r: r.ms):
            given = row.asDict()
            state, out = self.step(state, given)
            yield Row(**given, **out)
        self._save(state)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.mind.clear()
        self.history.clear()
        return iter(())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        at = (initialState.lat, initialState.lon)
        seen = None if None in at else at
        self._save(N.Direction((0.0, None, None, initialState.motion or "UNKNOWN"), (seen,) if seen else (), seen, seen, initialState.course, initialState.course))


def navigate(df: DataFrame, key: str = "user_id", known: DataFrame | None = None, idle_ms: int = 15 * 60 * 1000, **options) -> DataFrame:
    """A streaming df(key, ms, kind, lat, lon, accuracy, magnitude_sq, x, y) with the outputs of navigation.direction(options).

    known(key, motion, lat, lon, course): where walkers are at first, one row each. A key is forgotten idle_ms (of processing time) after its last rows. Rows
    of a later micro-batch come after all of the earlier ones. Needs a state store with column families (RocksDB).
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(N.OUTPUTS).fields])
    first = known.groupBy(key) if known is not None else None
    return df.groupBy(key).transformWithState(Navigator(idle_ms, N.direction(**options)), schema, "Append", "ProcessingTime", first)
