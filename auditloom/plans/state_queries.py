"""Catalogue: state tables, snapshots and exports, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from auditloom.plans.base import FINDING_COLUMNS, derive, derive_sql, flat, query, table
from auditloom.sources import state

COLUMNS = {name: FINDING_COLUMNS[name] for name in ("repo", "seq", "id", "title", "severity", "status")}
SCHEMA = "repo STRING, seq BIGINT, id STRING, title STRING, severity STRING, status STRING"


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cuts"
    return f"{base.rstrip('/')}/state-{uuid.uuid4().hex}"


def _findings(spark, sf_dir):
    return derive(table(spark, sf_dir, "documents"), COLUMNS)


@query("state_round_trip", derive_sql(COLUMNS, "documents"))
def state_round_trip(spark, sf_dir):
    """The second of two states that were written to one table."""
    path, rows = _folder(spark), _findings(spark, sf_dir)
    state.write_state(rows.filter("status = 'valid'"), path)
    state.write_state(rows, path)
    return flat(state.read_state(spark, path, SCHEMA, multi_line=False))


@query("snapshot_round_trip", derive_sql(COLUMNS, "documents"))
def snapshot_round_trip(spark, sf_dir):
    root = _folder(spark)
    snapshot = state.save_snapshot(spark, root, "audit", {"findings": _findings(spark, sf_dir)})
    return flat(state.load_snapshot(spark, root, snapshot, ["findings"])["findings"])


@query("export_round_trip", f"SELECT * FROM ({derive_sql(COLUMNS, 'documents')}) WHERE status = 'valid'")
def export_round_trip(spark, sf_dir):
    path = _folder(spark)
    state.export_json(_findings(spark, sf_dir), path)
    return flat(spark.read.schema(SCHEMA).json(path))
