"""Direction along a walk: fixes, accelerations and camera yaws of one key in their order, and the playback of accepted positions as curves.

Rules are functions step(state, row) -> (state, output), as in folds; their state is of bounded size. The batch form is folds.fold, the streaming form
trailnet.streaming.navigator.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from .folds import haversine, motion

#: Spacing of kept points, length of way a course is taken from, positions remembered, accuracy of a good fix, least size of a usable rotation.
SPACING_M, BASELINE_M, HISTORY, ACCURACY_M, LEAST_ROTATION = 1.5, 10.0, 80, 25.0, 0.18
#: Milliseconds of a curve, its share of the time between fixes, share of the newest leg in the bearing it ends with, length of its tangents.
SHORTEST_MS, LONGEST_MS, SHARE, NEWEST, TANGENT = 420, 900, 0.82, 0.72, 0.55

FIX, ACCELERATION, ROTATION = "fix", "acceleration", "rotation"
OUTPUTS = "accepted boolean, kept boolean, motion string, course double, heading double"


def bearing(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    lat1, lon1, lat2, lon2 = map(math.radians, (lat1, lon1, lat2, lon2))
    y = math.sin(lon2 - lon1) * math.cos(lat2)
    return math.degrees(math.atan2(y, math.cos(lat1) * math.sin(lat2) - math.sin(lat1) * math.cos(lat2) * math.cos(lon2 - lon1))) % 360.0


def turn(start: float, end: float) -> float:
    """In (-180, 180]."""
    by = (end - start) % 360.0
    return by - 360.0 if by > 180.0 else by


@dataclass(frozen=True)
class Direction:
    """What is known of one walker: the state of motion, the last positions, course, heading, camera yaw and the yaw that goes with the course."""

    moving: tuple | None = None
    history: tuple = ()
    accepted: tuple | None = None
    kept: tuple | None = None
    course: float | None = None
    heading: float | None = None
    yaw: float | None = None
    reference: float | None = None

    @property
    def motion(self) -> str:
        return self.moving[3] if self.moving else "UNKNOWN"


def course_of(history: tuple, baseline_m: float) -> float | None:
    """The bearing to the newest position from the latest one at least baseline_m back along the way; None where the way is shorter."""
    way = 0.0
    for newer, older in zip(history[::-1], history[-2::-1]):
        way += haversine(*older, *newer)
        if way >= baseline_m:
            return bearing(*older, *history[-1])
    return None


def direction(spacing_m: float = SPACING_M, baseline_m: float = BASELINE_M, history: int = HISTORY, accuracy_m: float = ACCURACY_M):
    """accepted, kept: of a fix, whether it counts and whether it is a point of the track; motion; course and heading in degrees or None.

    row: ms, kind, and of a fix lat, lon, accuracy, of an acceleration magnitude_sq, of a rotation its world axes x and y. The first good fix counts, later
    ones while MOVING. Going over to MOVING forgets the positions but for the last accepted one; at rest the camera's turn since then is added to the course.
    A row of another kind, or with a null where its kind needs a value, changes nothing.
    """

    def fix(s: Direction, row) -> tuple[Direction, bool, bool]:
        here, accuracy = (row["lat"], row["lon"]), row.get("accuracy")
        if None in here or not (accuracy is None or accuracy <= accuracy_m) or (s.accepted and s.motion != "MOVING"):
            return s, False, False
        kept = s.kept is None or haversine(*s.kept, *here) >= spacing_m
        if s.accepted is None:
            return replace(s, accepted=here, kept=here), True, True
        past = s.history if s.history and haversine(*s.history[-1], *here) < spacing_m else (*s.history, here)[-history:]
        course = course_of(past, baseline_m)
        course = s.course if course is None else course
        return replace(
            s, accepted=here, kept=here if kept else s.kept, history=past, course=course, reference=s.reference if s.yaw is None else s.yaw, heading=s.heading if course is None else course
        ), True, kept

    def acceleration(s: Direction, row) -> Direction:
        if row["magnitude_sq"] is None:
            return s
        moving, _ = motion(s.moving, row)
        then, s = s.motion, replace(s, moving=moving)
        if s.motion == then:
            return s
        if s.motion == "MOVING":
            return replace(s, history=(s.accepted,) if s.accepted else ())
        return replace(s, reference=s.yaw, heading=s.heading if s.course is None else s.course)

    def rotation(s: Direction, row) -> Direction:
        x, y = row["x"], row["y"]
        if x is not None and y is not None and math.hypot(x, y) >= LEAST_ROTATION:
            s = replace(s, yaw=math.degrees(math.atan2(x, y)) % 360.0)
        if s.motion != "STATIONARY" or s.yaw is None:
            return s
        reference = s.yaw if s.reference is None else s.reference
        base = s.heading if s.course is None else s.course
        return replace(s, reference=reference, heading=None if base is None else (base + turn(reference, s.yaw)) % 360.0)

    def step(state, row):
        s, accepted, kept = state or Direction(), False, False
        if row["kind"] == FIX:
            s, accepted, kept = fix(s, row)
        elif row["kind"] == ACCELERATION:
            s = acceleration(s, row)
        elif row["kind"] == ROTATION:
            s = rotation(s, row)
        return s, {"accepted": accepted, "kept": kept, "motion": s.motion, "course": s.course, "heading": s.heading}

    return step


def curve_at(a: tuple, b: tuple, start: float, end: float, t: float) -> tuple[float, float]:
    """The position at the share t of a curve from a to b that leaves by the bearing start and arrives by end."""
    scale = max(0.2, math.cos(math.radians((a[0] + b[0]) / 2)))
    up, across = b[0] - a[0], (b[1] - a[1]) * scale
    size = math.hypot(up, across) * TANGENT
    leave, whole, arrive = t**3 - 2 * t**2 + t, 3 * t**2 - 2 * t**3, t**3 - t**2
    start, end = math.radians(start), math.radians(end)
    north = leave * math.cos(start) * size + whole * up + arrive * math.cos(end) * size
    east = leave * math.sin(start) * size + whole * across + arrive * math.sin(end) * size
    return a[0] + north, a[1] + east / scale


def curve_bearing(a: tuple, b: tuple, start: float, end: float, t: float) -> float:
    scale = max(0.2, math.cos(math.radians((a[0] + b[0]) / 2)))
    up, across = b[0] - a[0], (b[1] - a[1]) * scale
    size = math.hypot(up, across) * TANGENT
    leave, whole, arrive = 3 * t**2 - 4 * t + 1, 6 * t - 6 * t**2, 3 * t**2 - 2 * t
    start, end = math.radians(start), math.radians(end)
    north = leave * math.cos(start) * size + whole * up + arrive * math.cos(end) * size
    east = leave * math.sin(start) * size + whole * across + arrive * math.sin(end) * size
    return bearing(*a, *b) if math.hypot(north, east) < 1e-12 else math.degrees(math.atan2(east, north)) % 360.0


PLAYBACK = "from_lat double, from_lon double, start_bearing double, end_bearing double, duration_ms long"


@dataclass(frozen=True)
class Playback:
    """The last three points (ms, lat, lon), the curve that is shown, what was shown last, and whether the walker stood still."""

    points: tuple = ()
    curve: tuple | None = None
    shown: tuple | None = None
    pointing: float | None = None
    departure: float | None = None
    still: bool = False


def _shown_at(p: Playback, ms: int) -> Playback:
    """p with what its curve shows at ms; at its end the departure heading has been used up."""
    if p.curve is None:
        return p
    begun, a, b, start, end, duration = p.curve
    t = min(1.0, max(0.0, (ms - begun) / duration))
    if t >= 1.0:
        return replace(p, curve=None, shown=b, pointing=end, departure=None)
    return replace(p, shown=curve_at(a, b, start, end, t), pointing=curve_bearing(a, b, start, end, t))


def playback(state, row):
    """The curve that an accepted position begins: where from, its bearings and its duration; nulls for the first position and for one no later than the last.

    row: ms, lat, lon, and of the walker motion, course, heading. A curve begins where the last one has come to, leaves by the departure heading (taken when the
    walker sets off, with what the camera has turned at rest), or as what is shown points, and ends by the way of the last two legs.
    """
    p, out = state or Playback(), dict.fromkeys(("from_lat", "from_lon", "start_bearing", "end_bearing", "duration_ms"))
    ms, here, still, course, heading = int(row["ms"]), (row["lat"], row["lon"]), row["motion"] == "STATIONARY", row["course"], row["heading"]
    p = _shown_at(p, ms)
    if p.still and not still:
        base = course if p.pointing is None else p.pointing
        if base is not None:
            leaving = (base + (turn(course, heading) if course is not None and heading is not None else 0.0)) % 360.0
            p = replace(p, departure=leaving, pointing=leaving)
    p = replace(p, still=still)
    if None in here or (p.points and ms <= p.points[-1][0]):
        return p, out
    points, last = (*p.points, (ms, *here))[-3:], p.points[-1] if p.points else None
    p = replace(p, points=points)
    if last is None:
        return replace(p, shown=here, pointing=p.pointing if course is None else course), out
    direct = bearing(*p.shown, *here)
    start = p.departure if p.departure is not None else direct if p.pointing is None else p.pointing
    before = bearing(*points[0][1:], *last[1:]) if len(points) == 3 else None
    end = direct if before is None else (before + turn(before, direct) * NEWEST) % 360.0
    duration = max(SHORTEST_MS, min(LONGEST_MS, math.floor((ms - last[0]) * SHARE + 0.5)))
    out = {"from_lat": p.shown[0], "from_lon": p.shown[1], "start_bearing": start, "end_bearing": end, "duration_ms": duration}
    return replace(p, curve=(ms, p.shown, here, start, end, duration)), out
