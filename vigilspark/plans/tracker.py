"""A tracker over the frames of one session: order guard, association with the frame before, one class a track, one end a track.

State: the place of the last frame, its source, and live tracks with their box, class, last detection,
score and how many frames they have been missing.
"""

from __future__ import annotations

from dataclasses import dataclass

ACTIVE, LOST, TERMINATED = "active", "lost", "terminated"


@dataclass(frozen=True)
class TrackPolicy:
    """floor: overlap that a match must exceed; buffer: frames that a track may be missing; start: score that begins a track."""

    floor: float = 0.1
    buffer: int = 2
    start: float = 0.0
    allow_class_switch: bool = False


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of boxes (x_min, y_min, x_max, y_max)."""
    width, height = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if width <= 0 or height <= 0:
        return 0.0
    both = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


class Tracker:
    def __init__(self, policy: TrackPolicy):
        self.policy = policy
        self.last: tuple | None = None
        self.source: str | None = None
        self.tracks: dict[int, dict] = {}
        self.next_id = 1

    def guard(self, frame_id, index: int, at: int, source) -> str | None:
        """What is wrong with a frame's place, or None; a refused frame changes nothing."""
        if None in (frame_id, index, at):
            return "incomplete_frame"
        if self.last is not None:
            if source != self.source:
                return "foreign_source"
            if frame_id == self.last[0]:
                return "duplicate_frame"
            if index <= self.last[1]:
                return "index_not_advancing"
            if at < self.last[2]:
                return "time_regression"
        else:
            self.source = source
        self.last = (frame_id, index, at)
        return None

    def matches(self, detections: list[dict]) -> dict[int, dict]:
        """Track -> detection: tracks of the highest score first (then the oldest), each with the free detection that overlaps most (then the first)."""
        free, out = list(detections), {}
        for track_id, t in sorted(self.tracks.items(), key=lambda x: (-x[1]["score"], x[0])):
            best, found = self.policy.floor, None
            for d in free:
                if (share := overlap(t["box"], d["box"])) > best and (self.policy.allow_class_switch or d["class_name"] == t["class_name"]):
                    best, found = share, d
            if found is not None:
                free.remove(found)
                out[track_id] = found
        return out

    def step(self, detections: list[dict]) -> list[tuple[int, str, str, bool]]:
        """(track, detection, state, matched) of a frame that passed the guard; detections: detection_id, class_name, score, box."""
        matched, out = self.matches(detections), []
        taken = {id(d) for d in matched.values()}
        for track_id in list(self.tracks):
            t = self.tracks[track_id]
            d = matched.get(track_id)
            if d is not None:
                t.update(box=d["box"], class_name=d["class_name"], score=d["score"], detection_id=d["detection_id"], missing=0)
                out.append((track_id, d["detection_id"], ACTIVE, True))
                continue
            t["missing"] += 1
            if t["missing"] > self.policy.buffer:
                del self.tracks[track_id]
                out.append((track_id, t["detection_id"], TERMINATED, False))
            else:
                out.append((track_id, t["detection_id"], LOST, False))
        for d in detections:
            if id(d) not in taken and d["score"] >= self.policy.start:
                self.tracks[self.next_id] = dict(d, missing=0)
                out.append((self.next_id, d["detection_id"], ACTIVE, True))
                self.next_id += 1
        return out
