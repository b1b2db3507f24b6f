"""Each stream is checked against a batch over the same events; folders arrive as several files."""

import json
from datetime import datetime, timedelta

import pytest

from auditloom.streaming import events as E


@pytest.fixture()
def folder(tmp_path):
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        run, agent = f"run{i % 2}", f"agent{i % 3}"
        payload = [
            {"agent": agent, "status": None if i % 4 else f"s{i}", "tokensUsed": i if i % 5 else None},
            {"agent": agent, "line": f"a{i}\n\n b{i}"}, {"agent": agent, "count": i % 3},
            {"agent": agent, "tokensUsed": i, "costUsd": 0.25}, {"phase": "done"}]
        for kind, body in zip(("progress", "log", "finding", "cost", "done"), payload):
            rows.append({"seq": i, "ts": (start + timedelta(seconds=i)).isoformat(), "run": run, "event": kind,
                         "payload": json.dumps(body)})
    path = tmp_path / "in"
    path.mkdir()
    for n in range(5):
        (path / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * 60:(n + 1) * 60]))
    return path


def batch(spark, folder):
    return spark.read.schema(E.ENVELOPE).json(str(folder))


def stream(spark, folder, kind):
    return E.of_type(E.event_stream(spark, str(folder), max_files=1), kind)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_progress_upsert_and_replay(spark, folder, tmp_path):
    table = E.VersionedTable(spark, str(tmp_path / "progress"))
    E.keep_progress(stream(spark, folder, "progress"), table, str(tmp_path / "c1")).awaitTermination()
    want = rows(E.latest_progress(E.of_type(batch(spark, folder), "progress")))
    assert rows(table.read()) == want
    # The same events again under a fresh checkpoint rewrite the same versions to the same state.
    E.keep_progress(stream(spark, folder, "progress"), table, str(tmp_path / "c2")).awaitTermination()
    assert rows(table.read()) == want


def test_a_fresh_checkpoint_goes_on_from_the_state_it_finds(spark, folder, tmp_path):
    table = E.VersionedTable(spark, str(tmp_path / "progress"))
    E.keep_progress(stream(spark, folder, "progress"), table, str(tmp_path / "c1")).awaitTermination()
    before = {(r.run, r.agent) for r in table.read().collect()}
    later = tmp_path / "later"
    later.mkdir()
    row = {"seq": 99, "ts": "2024-01-02T00:00:00", "run": "run9", "event": "progress", "payload": json.dumps({"agent": "new", "status": "s"})}
    (later / "0.json").write_text(json.dumps(row))
    E.keep_progress(stream(spark, later, "progress"), table, str(tmp_path / "c2")).awaitTermination()
    assert {(r.run, r.agent) for r in table.read().collect()} == before | {("run9", "new")}
    # The same checkpoint again has nothing new to do and begins where it began.
    assert table.base(str(tmp_path / "c2")) > table.base(str(tmp_path / "c1")) == 0


@pytest.mark.parametrize("kind,state", [("cost", E.running_totals), ("finding", E.finding_counts)])
def test_running_state(spark, folder, kind, state):
    query, name = E.to_memory(state(stream(spark, folder, kind)))
    query.awaitTermination()
    assert rows(spark.table(name)) == rows(state(E.of_type(batch(spark, folder), kind)))


def test_log_tail(spark, folder, tmp_path):
    table = E.VersionedTable(spark, str(tmp_path / "log"))
    E.keep_log_tail(stream(spark, folder, "log"), table, str(tmp_path / "c"), n=7).awaitTermination()
    assert rows(table.read()) == rows(E.log_tail(E.split_log_lines(E.of_type(batch(spark, folder), "log")), n=7))


def test_alerts(spark, folder, tmp_path):
    table = E.VersionedTable(spark, str(tmp_path / "totals"))
    E.keep_alerts(stream(spark, folder, "cost"), table, 1000, str(tmp_path / "c")).awaitTermination()
    assert {(r.run, r.total_tokens, r.alert) for r in table.read().collect()} == {("run0", 870, True), ("run1", 900, True)}
    assert {r.warning for r in E.budget_alerts(table.read(), 1000).collect()} == {
        "Token usage at 87% of budget", "Token usage at 90% of budget"}


def test_rate_breaches(spark, folder):
    query, name = E.to_memory(E.rate_breaches(E.event_stream(spark, str(folder), 1), limit=99, window="60 seconds"))
    query.awaitTermination()
    assert rows(spark.table(name)) == rows(E.rate_breaches(batch(spark, folder), limit=99)) != []


def test_stream_dedup(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    schema = "repo string, seq bigint, dedupKey string, severity string"
    data = [{"repo": "r", "seq": i, "dedupKey": f"k{i % 4}" if i % 7 else "", "severity": ["low", "high", "critical", "x"][i * 5 % 4]}
            for i in range(40)]
    for n in range(4):
        (source / f"{n}.json").write_text("\n".join(json.dumps(d) for d in data[n * 10:(n + 1) * 10]))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    E.keep_findings(events, log, str(tmp_path / "c")).awaitTermination()
    want = rows(E.dedup_state(spark.read.schema(schema).json(str(source))).drop("place"))
    assert rows(E.current_findings(spark, log)) == want and len(want) == 10


def test_unknown_event_type(spark, folder):
    with pytest.raises(ValueError):
        E.of_type(batch(spark, folder), "nope")


def _size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_keyed_table_equals_a_whole_one(spark, folder, tmp_path):
    for kind, keep, keys, want in (
            ("progress", E.keep_progress, ["run", "agent"], lambda b: E.latest_progress(b)),
            ("log", lambda s, t, c: E.keep_log_tail(s, t, c, n=7), ["run"], lambda b: E.log_tail(E.split_log_lines(b), n=7))):
        table = E.KeyedTable(spark, str(tmp_path / kind), keys, parts=5)
        keep(stream(spark, folder, kind), table, str(tmp_path / f"c_{kind}")).awaitTermination()
        expected = rows(want(E.of_type(batch(spark, folder), kind)))
        assert rows(table.read()) == expected
        # A replay of the same events goes on from the state and leaves it as it is.
        keep(stream(spark, folder, kind), table, str(tmp_path / f"d_{kind}")).awaitTermination()
        if kind == "progress":
            assert rows(table.read()) == expected
    table = E.KeyedTable(spark, str(tmp_path / "totals"), ["run"], parts=5)
    E.keep_alerts(stream(spark, folder, "cost"), table, 1000, str(tmp_path / "c")).awaitTermination()
    assert {(r.run, r.total_tokens, r.alert) for r in table.read().collect()} == {("run0", 870, True), ("run1", 900, True)}


def test_a_batch_writes_only_the_parts_it_touches(spark, tmp_path):
    table = E.KeyedTable(spark, str(tmp_path / "t"), ["run", "agent"], parts=64)
    old = spark.range(20_000).selectExpr("concat('r', id) AS run", "'a' AS agent", "uuid() AS status", "id AS seq")
    table.update(old, 0, lambda df: E.latest_progress(df, fields=["status"]))
    whole = _size(tmp_path / "t" / "v=0")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "v=0").rglob("*.parquet")}
    one = spark.createDataFrame([("r7", "a", "new", 99_999)], "run string, agent string, status string, seq bigint")
    for version in (1, 2, 2):  # the last is a replay
        table.update(one, version, lambda df: E.latest_progress(df, fields=["status"]))
        assert _size(tmp_path / "t" / f"v={version}") < whole / 20
    assert {f: f.stat().st_mtime_ns for f in before} == before
    assert table.read().count() == 20_000 and table.read().filter("run = 'r7'").first().status == "new"
    for version in range(3, 9):
        table.update(one, version, lambda df: E.latest_progress(df, fields=["status"]))
    part = [f.parent.name for f in (tmp_path / "t" / "v=8").rglob("*.parquet")][0]
    assert sorted(p.parent.name for p in (tmp_path / "t").glob(f"v=*/{part}")) == ["v=6", "v=7", "v=8"]  # older ones are gone
    assert table.read().count() == 20_000


def test_keyless_findings_hold_no_state_and_the_log_stays_bounded(spark, tmp_path):
    source, log = tmp_path / "in", tmp_path / "log"
    source.mkdir()
    schema = "repo string, seq bigint, dedupKey string, severity string"
    data = [{"repo": "r", "seq": i, "dedupKey": f"k{i % 3}" if i % 2 else "", "severity": ["low", "high", "critical", "x"][i * 5 % 4]} for i in range(80)]
    for n in range(20):
        (source / f"{n:02}.json").write_text("\n".join(json.dumps(d) for d in data[n * 4:(n + 1) * 4]))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = E.keep_findings(events, str(log), str(tmp_path / "c"), compact_after=4)
    query.awaitTermination()
    want = rows(E.dedup_state(spark.read.schema(schema).json(str(source))).drop("place"))
    assert rows(E.current_findings(spark, str(log))) == want and len(want) == 43
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert max(states) == 3  # one row per key
    assert len(list(log.glob("batch=*"))) <= 10 and len(list(log.glob("base=*"))) <= 2
    E.compact_log(spark, str(log))
    assert rows(E.current_findings(spark, str(log))) == want
