"""Decision tables and golden timelines of the state machines."""

import pytest

from vigilspark.plans.machines import Classification, Occupancy, Policy, Presence, Waiting

S = 1_000_000


def run(machine, rows):
    state, out = machine.initial(), []
    for r in rows:
        state, got = machine.apply(state, r)
        out.append(got)
    return state, out


def at(t, **more):
    return {"t": round(t * S), "frame": f"{round(t * 1000):09d}"} | more


def test_occupancy_slice():
    """Ten frames a second: inside from frame 7, outside from 28; confirmed at 8 and 30."""
    p = Policy(reorder_window=5, entry_confirmation=2, exit_confirmation=2, minimum_dwell=1.0, exit_grace=0.15, occlusion_tolerance=0.5)
    rows = [at(f / 10, kind="present" if f <= 27 else "absent") for f in range(7, 31)]
    _, out = run(Presence(p), rows)
    confirmed = {f: o["reason"] for f, o in zip(range(7, 31), out, strict=True) if o["reason"] != "observed_stay"}
    assert confirmed == {8: "enter_confirmed", 30: "exit_confirmed"}


def test_movement_hysteresis():
    p = Policy(movement_enter=0.15, movement_exit=0.05, movement_qualification=2)
    xy = [(0.10, 0.10), (0.11, 0.11), (0.30, 0.10), (0.50, 0.10), (0.72, 0.10), (0.71, 0.11), (0.70, 0.11), (0.70, 0.12)]
    d = [None] + [((a - c) ** 2 + (b - e) ** 2) ** 0.5 for (a, b), (c, e) in zip(xy[1:], xy, strict=False)]
    _, out = run(Classification(p), [at(t, distance=x) for t, x in enumerate(d)])
    assert [o["to"] for o in out] == ["unknown"] + ["stationary"] * 3 + ["moving"] * 3 + ["stationary"]
    assert {t: o["started"] and o["started"] // S for t, o in enumerate(out) if o["from"] != o["to"]} == {1: None, 4: 2, 7: 5}


def test_waiting_timeline():
    c = Classification(Policy(movement_enter=0.25, movement_exit=0.125, movement_qualification=2))
    x = [0.25, 0.3125, 0.375, 0.4375, 0.5, 0.5625, 0.875, 0.9375]
    _, moves = run(c, [at(t, distance=None if not t else x[t] - x[t - 1]) for t in range(8)])
    w = Waiting(Policy(waiting_qualification=3, waiting_contexts=("lobby",)))
    state, out = run(w, [at(t, presence="stay" if t else "enter_confirmed", movement=moves[t]["to"], context="lobby") for t in range(8)])
    assert [o["to"] for o in out] == ["not_waiting"] + ["candidate"] * 3 + ["waiting"] * 4
    assert (state["candidate"] // S, state["start"] // S) == (1, 4)


@pytest.mark.parametrize("kind,reason", [("session_closed", "session_closed"), ("present", "enter_confirmed")])
def test_instant_entry_and_close(kind, reason):
    _, out = run(Presence(Policy(entry_confirmation=1)), [at(0, kind=kind)])
    assert out[0]["reason"] == reason


def test_order_of_arrival():
    m = Presence(Policy(reorder_window=10))
    _, out = run(m, [at(100, kind="present"), at(100, kind="present"), at(95, kind="present"), at(80, kind="present"), at(101, kind="present")])
    assert [o["status"] for o in out] == ["applied", "deduplicated", "reordered", "late", "applied"]


def test_missing_expires_only_on_a_row():
    p = Policy(entry_confirmation=1, minimum_dwell=0, occlusion_tolerance=60)
    _, out = run(Presence(p), [at(0, kind="present"), at(59, kind="not_observed"), at(60, kind="not_observed")])
    assert [o["reason"] for o in out] == ["enter_confirmed", "observed_stay", "missing_expired"]


def test_occupancy_of_tracks():
    m = Occupancy(Policy(reorder_window=10))
    rows = [at(1, track="a", change="enter"), at(1, track="b", change="enter"), at(1, track="b", change="enter"), at(2, track="c", change="exit"), at(3, track="a", change="exit"), at(2, track="b", change="stay")]
    state, out = run(m, rows)
    assert [o["status"] for o in out] == ["applied", "applied", "deduplicated", "illegal", "applied", "reordered"]
    assert state["occupied"] == {"b"} and out[4]["occupancy_count"] == 1


def test_bad_policy():
    with pytest.raises(ValueError):
        Policy(movement_enter=0.1, movement_exit=0.2)
