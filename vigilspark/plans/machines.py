"""State machines over one key's rows, used alike by batch folds and streams.

Every machine follows one discipline. A row's place is (event time, frame). Compared
with the key's watermark, a later row is applied; the same place is deduplicated; an
earlier one within the reorder window is reordered (only last_seen may grow); an older
one is late. States are plain dicts of numbers, strings and lists. Times are microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

APPLIED, DEDUPLICATED, REORDERED, LATE, ILLEGAL, INVALID = "applied", "deduplicated", "reordered", "late", "illegal", "invalid_input"
INFINITE = 1 << 62


@dataclass(frozen=True)
class Policy:
    """Durations in seconds."""

    reorder_window: float = 60.0
    entry_confirmation: int = 2
    exit_confirmation: int = 3
    minimum_dwell: float = 10.0
    exit_grace: float = 30.0
    occlusion_tolerance: float = 60.0
    dwell_minimum: float = 0.0
    movement_threshold: float = 0.0
    movement_enter: float = 0.0
    movement_exit: float = 0.0
    movement_qualification: float = 0.0
    waiting_qualification: float = 0.0
    waiting_contexts: tuple[str, ...] = field(default=())
    history: int = 8

    def __post_init__(self):
        if self.movement_exit > self.movement_enter:
            raise ValueError("movement_exit must not exceed movement_enter")
        if self.entry_confirmation < 1 or self.exit_confirmation < 1:
            raise ValueError("confirmation counts begin at 1")


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


#: Legal transitions of presence: state -> states that may follow.
PRESENCE = {
    "absent": ("absent", "entering", "present"),
    "entering": ("entering", "present", "absent"),
    "present": ("present", "exiting", "absent"),
    "exiting": ("exiting", "present", "absent"),
}


class Machine:
    """place() applies the ordering discipline, step() the machine's own table."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def initial(self) -> dict:
        return {"t": None, "frame": None, "last_seen": None, "history": []}

    def place(self, state: dict, t: int, frame: str) -> str:
        if state["t"] is None or (t, frame) > (state["t"], state["frame"]):
            return APPLIED
        if (t, frame) == (state["t"], state["frame"]):
            return DEDUPLICATED
        return REORDERED if state["t"] - t <= micros(self.policy.reorder_window) else LATE

    def apply(self, state: dict, row: dict) -> tuple[dict, dict]:
        """New state and result (status and the step's outputs). A row without a place changes nothing."""
        if row["t"] is None or row["frame"] is None:
            return state, {"status": INVALID}
        status = self.place(state, row["t"], row["frame"])
        if status == REORDERED:
            state = state | {"last_seen": max(state["last_seen"], row["t"])}
        if status != APPLIED:
            return state, {"status": status}
        changed, out = self.step(state, row)
        if out.get("status") == ILLEGAL:
            return state, out
        new = state | changed | {"t": row["t"], "frame": row["frame"], "last_seen": row["t"]}
        if self.policy.history:
            new["history"] = [*state["history"], out.get("to", "")][-self.policy.history :]
        return new, {"status": APPLIED} | out

    def step(self, state: dict, row: dict) -> tuple[dict, dict]:
        raise NotImplementedError


class Presence(Machine):
    """Rows have kind: present, absent, not_observed or session_closed."""

    def initial(self) -> dict:
        return super().initial() | {"state": "absent", "since": None, "last_present": None, "entry": 0, "exit": 0, "occlusion": "not_observed", "missing_since": None}

    def step(self, state: dict, row: dict) -> tuple[dict, dict]:
        p, t, kind, at = self.policy, row["t"], row["kind"], state["state"]
        new = {"entry": 0, "exit": 0, "occlusion": "not_observed", "missing_since": None, "since": state["since"]}
        gap = INFINITE if state["last_present"] is None else t - state["last_present"]
        held = state["since"] is None or t - state["since"] >= micros(p.minimum_dwell)
        to, reason = at, "observed_stay"
        if kind == "session_closed":
            to, reason = "absent", "session_closed"
        elif kind == "present":
            if at in ("absent", "entering"):
                count = state["entry"] + 1 if at == "entering" else 1
                if count >= p.entry_confirmation:
                    to, reason = "present", "enter_confirmed"
                else:
                    to = "entering"
                    new |= {"entry": count, "occlusion": "observed"}
            else:
                to = "present"
                new["occlusion"] = "observed"
        elif at == "entering":
            to = "absent"
        elif at == "exiting":
            if state["exit"] + 1 >= p.exit_confirmation:
                to, reason = "absent", "exit_confirmed"
            else:
                new["exit"] = state["exit"] + 1
                if kind == "not_observed":
                    new["occlusion"] = "temporarily_missing"
        elif at == "present" and kind == "absent":
            if held and (state["last_present"] is None or gap >= micros(p.exit_grace)):
                if p.exit_confirmation == 1:
                    to, reason = "absent", "exit_confirmed"
                else:
                    to = "exiting"
                    new["exit"] = 1
        elif at == "present" and kind == "not_observed":
            if held and gap >= micros(p.occlusion_tolerance):
                to, reason = "absent", "missing_expired"
            else:
                new |= {"occlusion": "temporarily_missing", "missing_since": t if state["missing_since"] is None else state["missing_since"]}
        if to not in PRESENCE[at] and kind != "session_closed":
            return {}, {"status": ILLEGAL}
        if to != at or kind == "session_closed":
            new["since"] = t
        if kind == "present":
            new["last_present"] = t
        new["state"] = to
        return new, {"from": at, "to": to, "reason": reason}


class Classification(Machine):
    """Rows have distance (None for a track's first row): moving or stationary with hysteresis and qualification."""

    def initial(self) -> dict:
        return super().initial() | {"state": "unknown", "pending": None, "started": None}

    def step(self, state: dict, row: dict) -> tuple[dict, dict]:
        p, t, d, at = self.policy, row["t"], row["distance"], state["state"]
        if d is None:
            return {}, {"from": at, "to": at, "started": None}
        if d != d:  # not a number fits no threshold
            return {}, {"status": ILLEGAL}
        none = {"pending": None, "started": None}
        if at == "unknown":
            to = "moving" if d > p.movement_enter else "stationary"
            return none | {"state": to}, {"from": at, "to": to, "started": None}
        target = "moving" if d > p.movement_enter else "stationary" if d < p.movement_exit else None
        if target is None or target == at:
            return none, {"from": at, "to": at, "started": None}
        started = state["started"] if state["pending"] == target else None
        if started is not None:
            if t - started >= micros(p.movement_qualification):
                return none | {"state": target}, {"from": at, "to": target, "started": started}
            return {}, {"from": at, "to": at, "started": None}
        if not p.movement_qualification:
            return none | {"state": target}, {"from": at, "to": target, "started": None}
        return {"pending": target, "started": t}, {"from": at, "to": at, "started": None}


class Waiting(Machine):
    """Rows have presence (enter_confirmed, stay, or a loss: exit_confirmed, missing_expired, session_closed, absent), movement and context."""

    LOSSES = ("exit_confirmed", "missing_expired", "session_closed")

    def initial(self) -> dict:
        return super().initial() | {"state": "not_waiting", "candidate": None, "start": None}

    def step(self, state: dict, row: dict) -> tuple[dict, dict]:
        p, t, at = self.policy, row["t"], state["state"]
        reason = None
        if row["presence"] in self.LOSSES:
            reason = row["presence"]
        elif row["movement"] != "stationary":
            reason = "movement_exceeded"
        elif row["presence"] not in ("enter_confirmed", "stay"):
            reason = "not_present"
        elif row["context"] is None or row["context"] not in p.waiting_contexts:
            reason = "context_not_declared"
        if reason:
            out = {"from": at, "to": "not_waiting", "reason": reason, "interval_start": None, "interval_end": None}
            if at == "waiting":
                out |= {"interval_start": state["start"], "interval_end": t}
            return {"state": "not_waiting", "candidate": None, "start": None}, out
        candidate = t if state["candidate"] is None else state["candidate"]
        if at == "waiting":
            return {}, {"from": at, "to": at, "reason": "stay", "interval_start": state["start"], "interval_end": None}
        if t - candidate >= micros(p.waiting_qualification):
            return {"state": "waiting", "candidate": candidate, "start": t}, {"from": at, "to": "waiting", "reason": "confirmed", "interval_start": t, "interval_end": None}
        return {"state": "candidate", "candidate": candidate}, {"from": at, "to": "candidate", "reason": "qualifying", "interval_start": None, "interval_end": None}


class Occupancy(Machine):
    """Rows have track and change (enter, exit or stay), for one scope: deduplicated by track, ordered by the scope.

    The state is changed in place: it holds a place for each track, and who is inside. listed: results name those inside.
    """

    def __init__(self, policy: Policy, listed: bool = True):
        super().__init__(policy)
        self.listed = listed

    def initial(self) -> dict:
        return super().initial() | {"positions": {}, "occupied": set()}

    def apply(self, state: dict, row: dict) -> tuple[dict, dict]:
        track, at = row["track"], (row["t"], row["frame"])
        if track is None or None in at:
            return state, {"status": INVALID}
        if state["positions"].get(track) == at:
            return state, {"status": DEDUPLICATED}
        if state["t"] is not None and at < (state["t"], state["frame"]):
            return state, {"status": REORDERED if state["t"] - row["t"] <= micros(self.policy.reorder_window) else LATE}
        occupied = state["occupied"]
        before, inside = len(occupied), track in occupied
        if row["change"] in ("enter", "exit"):
            if (row["change"] == "enter") == inside:
                return state, {"status": ILLEGAL}
            (occupied.add if row["change"] == "enter" else occupied.remove)(track)
        state["positions"][track] = at
        state |= {"t": row["t"], "frame": row["frame"], "last_seen": row["t"]}
        out = {"status": APPLIED, "previous_count": before, "delta": len(occupied) - before, "occupancy_count": len(occupied)}
        return state, out | {"occupied_tracks": sorted(occupied)} if self.listed else out
