"""The live rules on single passes: the two-hour seal from both sides, suspensions, late sides; the loop and its heartbeat."""

import pandas as pd

from contestry.streaming import live

T0 = pd.Timestamp("2026-01-01 20:00")


def one(minutes=0, state="in", period=1, clock="4:00", a=None, b=None, cancelled=False, suspended=False, wants=(True, True)):
    return {"ts": T0 + pd.Timedelta(minutes=minutes), "state": state, "period": period, "clock": clock, "stats_a": a, "stats_b": b, "wants_a": wants[0], "wants_b": wants[1], "cancelled": cancelled, "suspended": suspended}


def walk(*passes):
    now, kinds = live.NOTHING, []
    for p in passes:
        now, got = live.apply_pass(now, p)
        kinds.append(got)
    return now, kinds


def test_seal_refuses_for_two_hours_and_then_takes_one_correction():
    sealed = one(0, "post", 3, "0:00", "a1", "b1")
    now, kinds = walk(sealed, one(120, "post", 3, "0:00", "a2", "b2"))
    assert now[4:7] == ("a1", "b1", True) and kinds[1] == []
    now, kinds = walk(sealed, one(121, "post", 3, "0:00", "a2", "b2"), one(122, "post", 3, "0:00", "a3", "b3"))
    assert now[4:7] == ("a2", "b2", True) and kinds[1:] == [["write", "sample"], []]


def test_seal_needs_every_side_that_can_come():
    assert not walk(one(0, "post", a="a1"))[0][6]
    assert not walk(one(0, "in", a="a1", b="b1"), one(1, "post", a="a2"))[0][6]
    assert walk(one(0, "post", a="a1", wants=(True, False)))[0][6]
    assert not walk(one(0, "post", wants=(False, False)))[0][6]


def test_sides_merge_and_post_stays():
    now, kinds = walk(one(0, a="a1"), one(1, "post", b="b1"), one(2, "in", a="a2"))
    assert now[1] == "post" and now[4:6] == ("a2", "b1")
    assert kinds == [["write", "sample"]] * 3


def test_samples_begin_with_the_first_period_and_differ():
    _, kinds = walk(one(0, period=0, a="x"), one(1, period=None, a="x"), one(2, a="x"), one(3, a="x"), one(4, clock="3:00"), one(5, state="pre", a="y"))
    assert kinds == [["write"], ["write"], ["write", "sample"], ["write"], ["write", "sample"], []]
    assert walk(one(0))[1] == [["write"]]


def test_suspension_keeps_the_series():
    now, kinds = walk(one(0, a="x"), one(1, cancelled=True, suspended=True), one(2, a="x"))
    assert kinds == [["write", "sample"], ["drop"], ["write"]]
    _, kinds = walk(one(0, a="x"), one(1, cancelled=True), one(2, a="x"))
    assert kinds == [["write", "sample"], ["drop", "drop_series"], ["write", "sample"]]


def test_heartbeat_beats_once_a_minute_and_survives_failures():
    at, beats = [0.0], []

    def beat(query, now):
        beats.append(now)
        if now > 100:
            raise OSError

    heart = live.Heartbeat(beat, 60, lambda: at[0])
    for t in (0, 30, 59, 60, 61, 130, 200):
        at[0] = float(t)
        heart.tick("q")
    assert beats == [0, 60, 130, 200] and heart.failed == 2


def test_bounded_loop_goes_on_after_a_failure():
    at, started = [0.0], []

    class Query:
        def awaitTermination(self, left):  # noqa: N802
            at[0] += min(left, 10)
            if len(started) < 3:
                raise RuntimeError
            return False

        def stop(self):
            pass

    def start():
        started.append(at[0])
        return Query()

    assert live.run_bounded(start, 45, lambda: at[0], pause=0) == 2
    assert len(started) == 5
