"""State of the streams: pieces by bucket and by segment, and one run of a marked batch."""

import pandas as pd

from lakeweave.streaming import streams as st


class Handle:
    """Lists, values and timers of one key."""

    def __init__(self):
        self.lists, self.values, self.timers = {}, {}, []

    def getListState(self, name, schema):
        rows = self.lists.setdefault(name, [])
        return type("L", (), {"get": lambda s: iter(list(rows)), "appendList": lambda s, x: rows.extend(x), "clear": lambda s: rows.clear(),
                              "exists": lambda s: bool(rows), "put": lambda s, x: (rows.clear(), rows.extend(x))})()

    def getValueState(self, name, schema):
        v = self.values
        return type("V", (), {"get": lambda s: v.get(name), "exists": lambda s: name in v, "update": lambda s, x: v.__setitem__(name, x)})()

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_bucket_of_keys_is_one_call_and_one_piece_of_state():
    handle, state = Handle(), st._first_seen()
    state.init(handle)
    key = lambda n: n.to_bytes(16, "big")

    def batch(keys, ends, clock=0):
        rows = pd.DataFrame({"hash": [k if k is None else key(k) for k in keys], "payload": list(map(str, keys)), "ends": ends})
        return [x for part in state.handleInputRows((3,), iter([rows[:2], rows[2:]]), Clock(clock)) for x in part["again"]]
    assert batch([1, 2, 2, None, None, 3], [50, 90, 60, 0, 0, 0]) == [False, False, True, False, False, False]
    assert len(handle.lists["pieces"]) == 1 and handle.timers == [50]
    assert batch([1, 2, 3], [70, 70, 70]) == [True] * 3 and len(handle.lists["pieces"]) == 1
    list(state.handleExpiredTimer((3,), Clock(60), None))
    assert handle.timers == [50, 90]
    assert batch([1, 2, 3], [100, 100, 100]) == [False, True, True]  # the first key was over, the others are not
    list(state.handleExpiredTimer((3,), Clock(200), None))
    assert batch([1, 2, 3], [300, 300, 300]) == [False, False, True]  # a key without an end stays


def test_a_segments_events_wait_in_arrow_batches():
    handle, state = Handle(), st._segment_buffer(3600)
    state.init(handle)
    rows = pd.DataFrame({"source_system": "a", "seg_us": 0, "ts_us": range(500), "event_id": list(map(str, range(500))),
                         "query_id": [None, *map(str, range(499))], "template": "{}", "late": None})
    assert not list(state.handleInputRows(("a", 0), iter([rows]), Clock(0)))
    assert len(handle.lists["events"]) == 1 and handle.timers == [3_600_000]
    out = pd.concat(state.handleExpiredTimer(("a", 0), Clock(4_000_000), None))
    assert list(out["event_id"]) == list(rows["event_id"]) and out["query_id"].isna().sum() == 1 and not out["late"].any()
    assert not handle.lists["events"]


def test_a_marked_batch_is_run_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b
    marked = spark.range(10).selectExpr("id", "id % 3 = 0 AS _repeat").mapInArrow(count, "id long, _repeat boolean")
    path = st.stream_dir(spark, "marked")
    st.quarantine_batch(path, [], ["id"])(marked, 0)
    good, bad = spark.read.parquet(f"{path}/good"), spark.read.parquet(f"{path}/quarantine")
    assert runs.value == 10 and good.count() == 6 and [r.fail_reasons for r in bad.collect()] == [["duplicate:id"]] * 4
