"""Registered queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

from check import rows_of
from recallspark.suite import registry

SF = "/root/testdata/sf0.001"
# One per area; ``check.py`` runs all of them.
CHECKED = [
    "tokenize_stats", "bm25_topk", "fingerprints", "label_expression", "timeline_before", "point_lookup", "usage_merge_replicas",
    "audit_delete_superseded", "derived_edges", "neighborhood_nodes", "recall_blend", "duplicate_pairs", "rrf_fuse",
    "choose_remote", "cache_refresh", "promotion_gate", "outbox_classify", "message_send", "validate_messages",
    "secret_scan", "merge_records", "delete_records", "usage_fold_stream",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(registry.oracles()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, found.fetchall())


def test_every_query_has_a_counterpart():
    assert registry.queries().keys() == registry.oracles().keys()
