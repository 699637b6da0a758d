"""Ledger and scheduler in keyed state, sinks that deliver once: one batch, many batches and restarts, against plain walks."""

import datetime as dt
import random

import pytest

from tidemark.plans import streams as P
from tidemark.streaming import events as S
from tidemark.streaming import keyed as K

EPOCH = dt.datetime(2024, 1, 1)
LIMITS = {"most_calls": 5, "most_per_tool": 3, "most_money": 1200, "lasts_us": 2 * K.DAY_US}


def written_events(spark, path, rows, files):
    """rows in files of equal length, in order of time."""
    step = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * step : (n + 1) * step], S.EVENTS).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def random_events(n, seed, users=5):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.randint(1, 25) * 60_000_000
        kind = rng.choice(["click", "view", "signup", "purchase", "error"])
        out.append((i, EPOCH + dt.timedelta(microseconds=at), rng.randrange(users), kind, 1.0, '{"k": %d}' % rng.randrange(100)))
    return out


def us(t):
    return int((t - EPOCH).total_seconds()) * 1_000_000 + t.microsecond + 1_704_067_200_000_000


def watermark(rows):
    return us(rows[-1][1]) // 1000 * 1000 - 3_600_000_000


def walked_ledger(rows):
    out, runs = [], {}
    for i, t, user, kind, _, props in rows:
        k, at = int(props[6:-1]), us(t)
        run = runs.setdefault(user, {"deadline": at + LIMITS["lasts_us"], "calls": {}, "charged": 0, "expired": False})
        calls = run["calls"]
        if at >= run["deadline"] and not run["expired"]:
            expire(out, user, run)
        op, call_id = {"purchase": "SETTLE", "error": "FAIL"}.get(kind, "ADMIT"), f"c{k % 20}"
        if op == "ADMIT":
            identity = ("search" if k % 3 == 0 else "fetch", f"f{k % 40}", k % 40 * 10)
            if call_id in calls:
                outcome = "REPLAYED" if calls[call_id]["identity"] == identity else "CONFLICT"
            elif at >= run["deadline"]:
                outcome = "DEADLINE"
            elif len(calls) >= LIMITS["most_calls"]:
                outcome = "CALLS"
            elif sum(c["identity"][0] == identity[0] for c in calls.values()) >= LIMITS["most_per_tool"]:
                outcome = "TOOL_CAP"
            elif run["charged"] + identity[2] > LIMITS["most_money"]:
                outcome = "MONEY"
            else:
                outcome = "ADMITTED"
                calls[call_id] = {"identity": identity, "end": None}
                run["charged"] += identity[2]
        else:
            end = ("SUCCEEDED", k % 7 * 25) if op == "SETTLE" else ("FAILED", None)
            call = calls.get(call_id)
            if call is None:
                outcome = "UNKNOWN_CALL"
            elif call["end"] is None:
                outcome, call["end"] = "SETTLED", end
                run["charged"] += (call["identity"][2] if end[1] is None else end[1]) - call["identity"][2]
            else:
                outcome = "SAME" if call["end"] == end else "CONFLICT"
        out.append((user, i, call_id, outcome, run["charged"]))
    for user, run in runs.items():  # deadlines that the watermark has passed without a row
        if not run["expired"] and run["deadline"] <= watermark(rows):
            expire(out, user, run)
    return sorted(out, key=repr)


def expire(out, user, run):
    run["expired"] = True
    for call_id, call in run["calls"].items():
        if call["end"] is None:
            call["end"] = ("UNKNOWN", None)
            out.append((user, None, call_id, "EXPIRED", run["charged"]))


@pytest.mark.parametrize("files", [1, 6])
def test_ledger_matches_a_walk_however_it_is_cut(spark, tmp_path, files):
    rows = random_events(700, 7)
    rows += [(1000, rows[-1][1] + dt.timedelta(days=4), 99, "view", 1.0, '{"k": 1}')]  # moves the watermark past every deadline
    path = written_events(spark, tmp_path / "events", rows, files)
    stream = K.ledger(P._commands(S.event_stream(spark, path, files=1)), **LIMITS)
    got = S.run_to_end(stream, "append", folder=f"file://{tmp_path}/run", conf=K.PROVIDER)
    want = walked_ledger(rows)
    assert {w[3] for w in want} >= {"ADMITTED", "REPLAYED", "CONFLICT", "DEADLINE", "CALLS", "TOOL_CAP", "SETTLED", "SAME", "UNKNOWN_CALL", "EXPIRED"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_ledger_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = random_events(200, 8)
    path = written_events(spark, tmp_path / "events", rows[:120], 2)
    run = lambda: S.run_to_end(K.ledger(P._commands(S.event_stream(spark, path, files=1)), **LIMITS), "append", folder=f"file://{tmp_path}/run", conf=K.PROVIDER)
    first = run().count()
    written_events(spark, tmp_path / "events", rows[120:], 2)
    assert first >= 120
    assert sorted((tuple(r) for r in run().collect()), key=repr) == walked_ledger(rows)


def walked_schedules(rows, lease=6 * 3_600_000_000):
    mark, out = watermark(rows), []
    for s in sorted({r[2] for r in rows}):
        mine = [(us(r[1]), r[0], r[3]) for r in rows if r[2] == s]
        last, due = max(mark, mine[-1][0]), mine[0][0] // K.DAY_US * K.DAY_US + (s * 37) % 1440 * 60_000_000
        while due <= mine[0][0]:
            due += K.DAY_US
        while due <= last:
            out.append((s, due, "FIRED", K.run_key(s, due), due))
            end = next(((t, kind) for t, _, kind in mine if due <= t < due + lease and kind in ("purchase", "error")), None)
            if end:
                out.append((s, due, "SUCCEEDED" if end[1] == "purchase" else "FAILED", K.run_key(s, due), end[0]))
            elif due + lease <= last:
                out.append((s, due, "RETRY_WAITING", K.run_key(s, due), due + lease))
            due += K.DAY_US
    return sorted(out)


@pytest.mark.parametrize("files", [1, 5])
def test_schedules_match_a_walk_however_they_are_cut(spark, tmp_path, files):
    rows = random_events(250, 9)
    path = written_events(spark, tmp_path / "events", rows, files)
    half = S.event_stream(spark, path, files=1)
    from pyspark.sql import functions as F

    shape = lambda e: e.select(F.col("user_id").alias("schedule_id"), "event_id", "ts", ((F.col("user_id") * 37) % 1440).alias("minute"), F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "BROKEN").alias("signal"))
    run = lambda: S.run_to_end(K.scheduler(shape(half), 6 * 3_600_000_000), "append", folder=f"file://{tmp_path}/run", conf=K.PROVIDER)
    got = [tuple(r) for r in run().collect()]
    assert sorted(got) == walked_schedules(rows)
    assert len({(r[0], r[3]) for r in got if r[2] == "FIRED"}) == sum(r[2] == "FIRED" for r in got)  # a run key fires once
    if files > 1:  # more rows later: the cursor goes on from the checkpoint
        more = [(i + 500, t + (rows[-1][1] - EPOCH), *rest) for i, t, *rest in random_events(120, 10)]
        written_events(spark, tmp_path / "events", more, 2)
        assert sorted(tuple(r) for r in run().collect()) == walked_schedules(rows + more)


def test_outbox_and_first_sightings_go_out_once_over_batches(spark, tmp_path):
    rows = random_events(60, 11)
    again = [(r[0], r[1] + dt.timedelta(days=9), *r[2:]) for r in rows[:20]]  # the same ids, long after the watermark
    path = written_events(spark, tmp_path / "events", rows + again, 4)
    stream = S.event_stream(spark, path, files=1)
    out = S.run_to_end(stream.select("event_id", "user_id"), "append", S.outbox_sink, folder=f"file://{tmp_path}/box")
    assert sorted(r.event_id for r in out.collect()) == list(range(60))
    seen = S.run_to_end(S.first_sightings(S.event_stream(spark, path, files=1), ["user_id", "event_type"]), "append", S.firsts, folder=f"file://{tmp_path}/seen")
    assert sorted(tuple(r) for r in seen.collect()) == sorted({(r[2], r[3]) for r in rows})
