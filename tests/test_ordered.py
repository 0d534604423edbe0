"""Passes by their own times: one, three and shuffled batches give the same rows; a reseal, an expiry and a late pass."""

import datetime as dt
import random

import pytest

from contestry.streaming import live, ordered

T0 = dt.datetime(2026, 1, 1, 20)


def one(bout, minutes, place, state="in", status="x", period=1, clock="4:00", a=None, b=None):
    return (bout, T0 + dt.timedelta(minutes=minutes), place, state, status, period, clock, a, b, True, True)


def plain(rows, ttl=48):
    """Every bout's passes one by one, deadlines between them."""
    import pandas as pd

    out = []
    for bout in {r[0] for r in rows}:
        state, asked = live.NOTHING, False
        own = sorted(r for r in rows if r[0] == bout)

        for r in [*own, None]:
            while state[0]:
                written = state[7] // 1000
                at, kind = (written + 2 * 3_600_000, "reseal_due") if state[6] and not asked else (written + ttl * 3_600_000, "expired")
                if r is not None and pd.Timestamp(r[1]).value // 10**6 <= at:
                    break
                out.append((bout, pd.Timestamp(at, unit="ms").to_pydatetime(), kind))
                state, asked = (live.NOTHING, False) if kind == "expired" else (state, True)
            if r is None:
                break
            p = dict(zip(("ts", "place", "state", "status", "period", "clock", "stats_a", "stats_b", "wants_a", "wants_b"), r[1:]))
            if p["state"] not in ("in", "post") and "CANCEL" not in p["status"]:
                continue
            p |= {"ts": pd.Timestamp(r[1]), "cancelled": "CANCEL" in p["status"], "suspended": False}
            state, kinds = live.apply_pass(state, p)
            asked = asked and "write" not in kinds and state[0]
            out += [(bout, r[1], k) for k in kinds]
    return sorted(out)


def passes():
    r = random.Random(2)
    rows = []
    for bout in range(6):
        t = 0
        for k in range(25):
            t += r.choice([1, 1, 2, 3, 130, 60 * 50 if k == 12 else 5])
            rows.append(one(bout, t, bout * 100 + k, r.choice(["pre", "in", "in", "post"]), r.choice(["x"] * 9 + ["STATUS_CANCELED"]), r.randint(0, 3), str(k % 3), r.choice([None, "a1", "a2"]), r.choice([None, "b1", "b2"])))
    return rows


@pytest.mark.parametrize("how", ["one", "three", "shuffled"])
def test_replay_is_the_same_in_any_batches(spark, tmp_path, how):
    rows = passes()
    arranged = sorted(rows, key=lambda r: r[1])
    n = {"one": 1, "three": 3, "shuffled": 5}[how]
    if how == "shuffled":
        random.Random(1).shuffle(arranged)
    folder = f"file://{tmp_path}/in"
    for i in range(n):
        part = arranged[i * len(arranged) // n : (i + 1) * len(arranged) // n]
        spark.createDataFrame(part, ordered.PASSES).coalesce(1).write.mode("append").parquet(folder)
    got = ordered.replay_folder(spark, folder, 1, delay="20 days" if how == "shuffled" else "10 minutes").collect()
    want = plain(rows)
    assert sorted((g["bout_id"], g["ts"], g["kind"]) for g in got) == want
    assert {k for _, _, k in want} == {"write", "sample", "drop", "drop_series", "reseal_due", "expired"}


def test_a_pass_behind_the_watermark_is_dropped(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for rows in ([one(1, 0, 1, a="a1")], [one(1, 100, 2, a="a2"), one(2, 95, 3, a="x")], [one(1, 200, 5, a="a4")], [one(1, 50, 4, a="late"), one(2, 198, 6, a="in time")]):
        spark.createDataFrame(rows, ordered.PASSES).coalesce(1).write.mode("append").parquet(folder)
    got = [(g["bout_id"], g["stats_a"]) for g in ordered.replay_folder(spark, folder, 1).filter("kind = 'write'").orderBy("bout_id", "ts").collect()]
    assert got == [(1, "a1"), (1, "a2"), (1, "a4"), (2, "x"), (2, "in time")]
