import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from clipfold.operators import articles, artifacts, ledger, paging
from clipfold.operators.automata import moves, resolved_chains, states_before


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_states_before_match_a_loop(spark, chunk):
    rnd = random.Random(chunk)
    table = {"a": (1, 2, 0, 3), "b": (0, 0, 3, 3), "c": (2, 1, 1, 0)}
    runs = {k: [rnd.choice("abcx") for _ in range(rnd.choice([1, 5, 40, 90]))] for k in range(8)}
    rows = [(k, i, e) for k, events in runs.items() for i, e in enumerate(events)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "run int, at int, event string").withColumn("move", moves(F.col("event"), table))
    got = {(r.run, r["at"]): r.state for r in states_before(frame, ["run"], "at", "move", 4, 1, chunk).collect()}
    for k, events in runs.items():
        state = 1
        for i, e in enumerate(events):
            assert got[k, i] == state
            state = table.get(e, range(4))[state]
    assert states_before(frame.filter("false"), ["run"], "at", "move", 4).count() == 0


def test_chains_of_pointers(spark):
    n = 3000
    rows = [(0, 1, None, 1)] + [(i, None, i - 1, 1) for i in range(1, n)] + [(9000, None, None, 1), (9001, None, 9000, 0)]
    out = {r.i: r.v for r in resolved_chains(spark.createDataFrame(rows, "i int, v int, to int, flip int"), "i", "v", "to", "flip").collect()}
    assert [out[i] for i in range(n)] == [1 - i % 2 for i in range(n)] and out[9000] is None and out[9001] is None


def upserted(rows, stored):
    seen, out = set(stored), {}
    for i, *ids in rows:
        keys = {(k, v) for k, v in enumerate(ids) if v is not None}
        out[i] = "duplicate" if keys & seen else "inserted"
        if out[i] == "inserted":
            seen |= keys
    return out


def test_upsert_of_a_long_chain(spark):
    rows = [(i, i // 2, (i + 1) // 2) for i in range(4000)]  # each row shares one identity with the one before and one with the next
    frame, none = spark.createDataFrame(rows, "i int, a int, b int"), spark.createDataFrame([], "i int, a int, b int")
    got = {r.i: r.outcome for r in articles.upsert(frame, none, ["a", "b"], "i", most=20).collect()}
    assert got == upserted(rows, ())


@pytest.mark.parametrize("seed", range(2))
def test_upsert_with_three_identities(spark, seed):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice([None, *range(12)])
    rows = [(i, pick(), pick(), pick()) for i in range(60)]
    stored = [(3, None, 5)]
    frame = spark.createDataFrame(rows, "i int, a int, b int, c int")
    got = {r.i: r.outcome for r in articles.upsert(frame, spark.createDataFrame(stored, "a int, b int, c int"), ["a", "b", "c"], "i").collect()}
    assert got == upserted(rows, {(k, v) for row in stored for k, v in enumerate(row) if v is not None})


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_order_across_ranges(spark, parts):
    rnd = random.Random(parts)
    rows = [(i, rnd.randint(0, 30), rnd.randint(0, 2)) for i in range(80)]
    want = {b[0] for a, b in itertools.pairwise(rows) if b[1:] >= a[1:]}
    frame = spark.createDataFrame(rows, "place int, at int, id int")
    assert {r.place for r in paging.order_violations(frame, "at", "id", "place", parts).collect()} == want


def test_ledger_transitions(spark):
    events = {
        "good": [("prepare", "r", None, None, "none", "prepared"), ("prepare", "r", None, None, "reserved", "reserved"), ("finalize", "r", "a", None, "reserved", "completed"), ("finalize", "r", "a", None, "completed", "already_completed"), ("prepare", "r", None, None, "completed", "completed")],
        "early": [("finalize", "r", "a", None, "none", "INVOCATION_NOT_FOUND"), ("prepare", "r", None, None, "none", "prepared"), ("finalize", "r", None, None, "reserved", "INVALID_INVOCATION_AUDIT"), ("finalize", "r", "b", None, "reserved", "completed"), ("finalize", "r", "a", None, "completed", "INVOCATION_CONFLICT")],
        "other": [("prepare", "r", None, None, "none", "prepared"), ("prepare", "s", None, None, "reserved", "INVOCATION_CONFLICT"), ("finalize", "s", "a", None, "reserved", "INVOCATION_CONFLICT"), ("finalize", "r", "a", "LEASE_EXPIRED", "reserved", "LEASE_EXPIRED"), ("finalize", "r", "a", None, "reserved", "completed"), ("finalize", "r", None, None, "completed", "INVOCATION_CONFLICT")],
        "late": [("prepare", "r", None, "FENCE_MISMATCH", "none", "FENCE_MISMATCH"), ("prepare", "s", None, None, "none", "prepared"), ("prepare", "r", None, None, "reserved", "INVOCATION_CONFLICT")],
    }
    rows = [(k, i, *e[:4]) for k, x in events.items() for i, e in enumerate(x)]
    for chunk in (2, 200):
        out = ledger.transitions(spark.createDataFrame(rows, "call string, seq int, action string, request string, audit string, refused string"), ["call"], "seq", chunk)
        assert {(r.call, r.seq): (r.found, r.outcome) for r in out.collect()} == {(k, i): e[4:] for k, x in events.items() for i, e in enumerate(x)}


def test_journal_regressions(spark):
    t = lambda k: dt.datetime(2026, 8, k)
    base = dict(calls=1, unpriced=False, attempts=["a"], steps=[("collect", "succeeded", "x"), ("score", "running", None)], reason=None, at=t(1), version="v1")
    runs = {
        "ok": [base, base | {"calls": 2, "attempts": ["a", "b"], "steps": [("collect", "succeeded", "x"), ("score", "succeeded", "y")], "reason": "done", "at": t(2)}],
        "usage": [base, base | {"calls": 0}], "priced": [base | {"unpriced": True}, base], "attempts": [base, base | {"attempts": ["b", "a"]}], "shorter": [base, base | {"attempts": []}],
        "steps": [base, base | {"steps": [("collect", "succeeded", "z"), ("score", "running", None)]}], "stages": [base, base | {"steps": [("collect", "succeeded", "x")]}],
        "reason": [base | {"reason": "a"}, base | {"reason": None}], "time": [base | {"at": t(2)}, base], "version": [base, base | {"version": "v2"}], "gap": [base, None, base],
    }
    rows = [(k, i, (x["calls"], x["unpriced"]), x["attempts"], x["steps"], x["reason"], x["at"], x["version"]) for k, xs in runs.items() for i, x in enumerate(xs) if x]
    frame = spark.createDataFrame(rows, "run string, revision int, usage struct<model_calls int, has_unpriced_calls boolean>, attempts array<string>, steps array<struct<stage string, status string, output string>>, terminal_reason string, updated_at timestamp, version string")
    got = {(r.run, r.revision): r.violations for r in ledger.journal_regressions(frame, "run", ["version"]).collect()}
    want = {"usage": ["USAGE"], "priced": ["USAGE"], "attempts": ["ATTEMPTS"], "shorter": ["ATTEMPTS"], "steps": ["STEPS"], "stages": ["DEFINITION"], "reason": ["REASON"], "time": ["TIME"], "version": ["DEFINITION"]}
    assert got == {(k, 1): v for k, v in want.items()} | {("gap", 2): ["REVISION"]}


def test_streams_with_state_match_tables_and_restart(spark, tmp_path):
    from clipfold.streaming import state

    rnd = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    times = sorted(rnd.randint(0, 60) for _ in range(60))
    rows = [(i, "early" if i < 3 else f"s{rnd.randint(0, 9)}", start + dt.timedelta(hours=h)) for i, h in enumerate(times)]
    whole = spark.createDataFrame(rows, "id long, source string, ts timestamp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(stream, name):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(str(tmp_path / name))

    try:
        for k in range(2):  # a batch, a stop, and the rest from the checkpoint
            whole.filter((F.col("id") < 25) == (k == 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
            out = run(state.throttled(source, "source", "ts", "id", 6 * 3600), "throttled")
            held = source.select("source", F.col("ts").alias("at"), (F.col("ts") + F.expr("interval 10 hours")).alias("until"))
            gone = run(state.expired(held, "source", "until"), "expired")
        want = ledger.throttled(whole, "source", "ts", "id", 6 * 3600)
        assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        ends, emitted = {}, set()
        for part in (rows[:25], rows[25:]):
            for _, k, at in part:
                ends[k] = max(ends.get(k, at), at + dt.timedelta(hours=10))
            done = {(k, end) for k, end in ends.items() if end <= max(r[2] for r in part)}
            emitted |= done
            ends = {k: end for k, end in ends.items() if (k, end) not in done}
        assert {tuple(r) for r in gone.collect()} == emitted and gone.count() == len(emitted) > 1
        whole_until = whole.groupBy("source").agg(F.max(F.col("ts") + F.expr("interval 10 hours")).alias("until"))
        _, purged = artifacts.purged(whole_until, F.lit(rows[-1][2]), "until", "source", 1000)
        assert {(r.source, r.until) for r in purged.collect()} <= emitted  # what the table has lost by then
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
