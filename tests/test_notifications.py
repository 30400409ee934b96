"""Notifications against a simulation that looks at every tick."""

import datetime as dt
import random

from lakeweave.operators import telemetry as tm

ALERTS = "alertname string, job string, severity string, fires_at timestamp_ntz, ends_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def ticked(alerts):
    groups, out = {}, []
    for name, job, sev, f, e in alerts:
        if f is not None and e is not None and e > f:
            receiver, *times = tm.NOTIFY.get(sev, tm.NOTIFY_DEFAULT)
            groups.setdefault((name, job, receiver, *times), []).append((f, e))
    for (name, job, receiver, wait, every, repeat), rows in groups.items():
        rows.sort()
        episodes = [[rows[0]]]
        for r in rows[1:]:
            episodes.append([r]) if r[0] >= max(e for _, e in episodes[-1]) else episodes[-1].append(r)
        for ep in episodes:
            tick, told, last = ep[0][0] + dt.timedelta(seconds=wait), ep[0][0] - dt.timedelta(seconds=1), None
            while tick < max(e for _, e in ep):
                active = [f for f, e in ep if f <= tick < e]
                new = [f for f in active if f > told]
                if new or active and tick - last >= dt.timedelta(seconds=repeat):
                    out.append((name, job, receiver, tick, "new" if new else "repeat", len(active), len(new)))
                    last = tick
                told, tick = tick, tick + dt.timedelta(seconds=every)
    return sorted(out, key=str)


def test_repeats_follow_the_last_one_sent(spark):
    t = lambda m: T0 + dt.timedelta(minutes=m)
    alerts = [("A", "j", "critical", t(m), t(210)) for m in range(0, 201, 50)] + [("B", "j", "critical", t(0), t(200))]
    got = sorted(map(tuple, tm.notifications(spark.createDataFrame(alerts, ALERTS)).collect()), key=str)
    assert got == ticked(alerts)
    sent = [(round((r[3] - T0).total_seconds() / 60, 2), r[4]) for r in got if r[0] == "A"]
    assert sent == [(0.17, "new"), (50.17, "new"), (100.17, "new"), (150.17, "new"), (200.17, "new")]
    sent = [(round((r[3] - T0).total_seconds() / 60, 2), r[4]) for r in got if r[0] == "B"]
    assert sent == [(0.17, "new"), (60.17, "repeat"), (120.17, "repeat"), (180.17, "repeat")]


def test_random_alerts_over_slices_and_odd_rows(spark):
    rng = random.Random(4)
    alerts = []
    for _ in range(400):
        f = T0 + dt.timedelta(seconds=rng.randrange(10 * 86400))
        alerts.append((rng.choice("AB"), rng.choice(["j", None]), rng.choice(["critical", "warning", None]), f, f + dt.timedelta(seconds=rng.choice([0, 5, 900, 40_000]))))
    alerts += [("A", "j", "critical", T0, T0 + dt.timedelta(days=5)), ("A", "j", "critical", None, T0), ("A", "j", "critical", T0, None)]
    df = spark.createDataFrame(alerts, ALERTS)
    for seconds in (3600, 86400, 10**7):
        got = sorted(map(tuple, tm.notifications(df, slice_seconds=seconds).collect()), key=str)
        assert got == sorted(ticked(alerts), key=str)
    assert tm.notifications(df.limit(0)).count() == 0
