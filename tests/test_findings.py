import pytest
from pyspark.sql import functions as F

from auditloom.operators import findings as FI
from auditloom.operators import rollups, routing

SCHEMA = ("repo string, seq bigint, agent string, id string, title string, severity string, confidence string, file string, "
          "line string, bugClass string, description string, proof string, recommendation string, dedupKey string, "
          "status string")


def rows(spark, *changes):
    base = dict(repo="r", seq=0, agent="cpi-token", id=None, title="t", severity="high", confidence="high", file="/w/a.rs",
                line="3", bugClass="b", description="d", proof="p", recommendation=None, dedupKey=None, status="pending")
    return spark.createDataFrame([tuple((base | {"seq": i} | c).values()) for i, c in enumerate(changes)], SCHEMA)


def test_upsert_replaces_only_with_higher_severity(spark):
    stored = FI.assign_ids(FI.prepare_findings(rows(
        spark, dict(dedupKey="k1", severity="medium"), dict(dedupKey="k2", severity="high"), dict(dedupKey="")), "/w"))
    batch = rows(spark, dict(dedupKey="k1", severity="critical", title="new"), dict(dedupKey="k2", severity="high", title="same"),
                 dict(dedupKey="k3", title="LEAD: no"), dict(dedupKey="k4", severity="bogus"), dict(dedupKey="", title="free"))
    got = {(r.seq, r.id, r.title, r.severity) for r in FI.upsert_findings(stored, batch, "/w").collect()}
    assert got == {(0, "cpi-token-004", "new", "critical"), (1, "cpi-token-002", "t", "high"), (2, "cpi-token-003", "t", "high"),
                   (7, "cpi-token-006", "free", "high")}


def test_ids_grow_past_999(spark):
    df = spark.range(1001).select(F.lit("r").alias("repo"), F.lit("a").alias("agent"), F.col("id").alias("seq"))
    ids = {r.seq: r.id for r in FI.assign_ids(df, width=100).collect()}
    assert (ids[0], ids[998], ids[999], ids[1000]) == ("a-001", "a-999", "a-1000", "a-1001")


def test_verdicts(spark):
    base = rows(spark, *[dict(id=f"x-00{i}") for i in range(6)])
    v = [("r", "x-000", 1, "refuted", "high", "because", None, None), ("r", "x-001", 1, "refuted", "low", "b", None, None),
         ("r", "x-002", 1, "duplicate", "high", "b", None, "x-000"), ("r", "x-003", 1, "severity-adjusted", "low", "b", "low", None),
         ("r", "x-004", 2, "confirmed", "high", "b", None, None), ("r", "x-004", 1, "refuted", "high", "old", None, None),
         ("r", "gone", 1, "refuted", "high", "b", None, None)]
    verdicts = spark.createDataFrame(v, "repo string, findingId string, seq bigint, verdict string, confidence string, "
                                        "reasoning string, adjustedSeverity string, duplicateOf string")
    got = {r.id: (r.status, r.severity, r.triageReason, r.originalSeverity) for r in FI.apply_validations(base, verdicts).collect()}
    assert got == {"x-000": ("invalid", "high", "Validation agent: because", None), "x-001": ("pending", "high", None, None),
                   "x-002": ("invalid", "high", "Duplicate of x-000", None), "x-003": ("pending", "low", None, "high"),
                   "x-004": ("invalid", "high", "Validation agent: old", None), "x-005": ("pending", "high", None, None)}


@pytest.mark.parametrize("ids,status,reason,fails", [
    ([], "valid", None, True), (["ab-001"] * 500, "valid", "r" * 2000, False), (["ab-001"] * 501, "valid", None, True),
    (["ab-001"], "valid", "r" * 2001, True), (["bad"], "valid", None, True), (["ab-001"], "done", None, True),
])
def test_bulk_limits(ids, status, reason, fails):
    assert (FI.check_triage_batch(ids, status, reason) is not None) == fails


def test_patches_last_value_wins(spark):
    base = rows(spark, dict(id="a"), dict(id="b"))
    patches = spark.createDataFrame([("r", "a", 1, "low", "n1"), ("r", "a", 2, None, "n2"), ("r", "z", 1, "low", None)],
                                    "repo string, id string, seq bigint, severity string, notes string")
    patched, missing = FI.apply_patches(base, patches)
    got = {r.id: (r.severity, r.notes, r.triagedAt is not None) for r in patched.collect()}
    assert got == {"a": ("low", "n2", True), "b": ("high", None, False)}
    assert [r.id for r in missing.collect()] == ["z"]


def test_search_and_sort(spark):
    df = rows(spark, dict(title="Swap pool", severity="low", agent="b"), dict(file=None, severity="critical", agent="a"),
              dict(description="POOL", severity="odd", agent="C"))
    assert {r.seq for r in FI.query_findings(df, search="pool").collect()} == {0, 2}
    assert [r.seq for r in FI.sort_findings(df, "severity").collect()] == [1, 0, 2]
    assert [r.seq for r in FI.sort_findings(df, "agent").collect()] == [1, 0, 2]
    assert [r.seq for r in FI.sort_findings(df, "nothing").collect()] == [0, 1, 2]


def test_mock_board(spark):
    """Twelve findings: severities 2/3/3/2/2 and a board of 7 pending, 2 valid and 3 dismissed."""
    severities = ["critical"] * 2 + ["high"] * 3 + ["medium"] * 3 + ["low"] * 2 + ["informational"] * 2
    statuses = ["pending"] * 7 + ["valid"] * 2 + ["invalid", "not-important", "out-of-scope"]
    df = rows(spark, *[dict(severity=s, status=t) for s, t in zip(severities, statuses)])
    assert {r.severity: r["count"] for r in rollups.count_by_severity(df).collect()} == {
        "critical": 2, "high": 3, "medium": 3, "low": 2, "informational": 2}
    assert {r.bucket: r["count"] for r in rollups.status_buckets(df).collect()} == {"pending": 7, "valid": 2, "dismissed": 3}
    one = rollups.by_agent(df).first()
    assert (one.tally, one.top) == ("2c 3h 3m 2l 2i", ["critical", "critical", "high"])


def test_budget_and_risk(spark):
    runs = spark.createDataFrame([("a", "x", 80), ("b", "x", 100), ("c", "x", 79)], "repo string, agent string, tokensUsed bigint")
    assert {r.repo: r.state for r in rollups.budget_state(runs, 100).collect()} == {"a": "warning", "b": "exceeded", "c": "ok"}
    assert {r.state for r in rollups.budget_state(runs, None).collect()} == {"unlimited"}
    w = spark.createDataFrame([("a", "medium")] * 2 + [("b", "medium")] * 3 + [("c", "high")], "repo string, risk string")
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo string")
    assert {r.repo: r.risk_level for r in rollups.risk_level(w, repos).collect()} == {
        "a": "low", "b": "medium", "c": "high", "d": "low"}


def test_routing(spark):
    leads = spark.createDataFrame([("Signer missing", None, None, None), (None, "x", None, "nothing")],
                                  "message string, rule string, file string, snippet string")
    got = {(r.message, r.domain) for r in routing.route_leads(leads).collect()}
    assert got == {("Signer missing", "accounts-access"), ("Signer missing", "invariant-logic"), (None, "invariant-logic")}
    refs = spark.createDataFrame([("1.10",), ("1.9",), ("2.1",)], "ref string")
    assert [r.ref for r in routing.order_taxonomy(refs).collect()] == ["1.9", "1.10", "2.1"]
    words = spark.createDataFrame([("a", "x"), ("b", None)], "name string, keyword string")
    assert routing.keyword_table(words) == {"a": ["x"], "b": []}
