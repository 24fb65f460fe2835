"""Table shapes and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------- fixed values
# Numbers and words that must be these for results to agree with the data model.

# Field weights of the text index.
FIELD_WEIGHTS = {
    "id_text": 3.0,
    "description": 3.0,
    "triggers": 2.0,
    "tags": 2.0,
    "labels": 1.0,
    "facts": 1.0,
    "pattern": 1.0,
    "pitfalls": 1.0,
    "scope_text": 1.0,
}
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
TEXT_LIMIT = 50

# Bounds of the graph walk around a query.
WALK_DEPTH = 2
WALK_MAX_NODES = 250
WALK_FRONTIER = 60
WALK_SEEDS = 5
RESTART = 0.15
MAX_ITERATIONS = 100
TOLERANCE = 1e-8

# Similarity edges.
DERIVED_NEIGHBOURS = 10
DERIVED_CANDIDATES = 200
DERIVED_THRESHOLD = 0.34
LABEL_SHARE = 0.7
FILE_SHARE = 0.3
AUTHORED_WEIGHT = 1.0
DERIVED_WEIGHT = 0.5

STATUS_FACTORS = {"active": 1.0, "stale": 0.7, "superseded": 0.4, "wrong": 0.2}
STATUSES = ("active", "stale", "superseded", "wrong")
DEFAULT_STATUSES = ("active", "stale")

RRF_K = 60
CACHE_TTL_DAYS = 30
CACHE_MAX_ROWS = 500
MIN_PROMOTION_TIER = 2
SPREAD_WINDOW = 64
# unix_date(d) + this = day ordinal counted from 0001-01-01 as day 1.
ORDINAL_OF_EPOCH = 719163

MAX_MESSAGE_CHARS = 4000
MAX_UNREAD_PER_SENDER = 10
INBOX_LIMIT = 20
CLOCK_SKEW_SECONDS = 300

ID_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*\n?$"
LABEL_PATTERN = r"^[a-z]+:[a-z0-9]+(-[a-z0-9]+)*\n?$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}\n?$"

# Starter label registry.
STARTER_LABELS = {
    "context:build": "Build, compile, packaging, or release pipeline behavior.",
    "context:deployment": "Deployment, hosting, infrastructure, or environment configuration.",
    "context:runtime": "Behavior at application runtime rather than build or authoring time.",
    "context:testing": "Test suites, fixtures, flaky tests, or test infrastructure.",
    "context:tooling": "Editors, IDEs, coding agents, MCP servers, scripts, or developer tooling.",
    "kind:architecture": "A reusable structural relationship, subsystem map, ownership rule, or design decision.",
    "kind:bug": "A recurring failure mode, misleading symptom, or diagnosed defect pattern.",
    "kind:convention": "A project convention, naming rule, or agreement that is easy to violate accidentally.",
    "kind:workflow": "A practical workflow, sequence, workaround, or operational procedure.",
}
# ----------------------------------------------------------- end fixed values


class RecallError(ValueError):
    """Bad argument, unknown id, or a document that breaks the schema."""


SCOPE = "struct<project:string,area:string,files:array<string>,applies_to:array<string>>"
EVIDENCE = "struct<created_from_task:string,last_validated:string,created:string>"
RELATED = "array<struct<id:string,reason:string>>"
RELATIONSHIPS = f"struct<related:{RELATED},supersedes:array<string>,superseded_by:array<string>>"

DOCUMENT_DDL = (
    "schema_version int, id string, status string, description string, tags array<string>, "
    f"labels array<string>, scope {SCOPE}, triggers array<string>, remembered_facts array<string>, "
    f"solution_pattern array<string>, pitfalls array<string>, evidence {EVIDENCE}, "
    f"relationships {RELATIONSHIPS}"
)
DOCUMENT = f"struct<{', '.join(part for part in [DOCUMENT_DDL])}>"

STANDING_DDL = (
    "tier int, tier_since string, tier_since_query bigint, archived_at string, "
    "merged_into string, visibility string"
)
TABLES = {
    "projects": "project_id string, queries bigint, root_path string",
    "records": f"project_id string, memory_id string, {DOCUMENT_DDL}, {STANDING_DDL}, "
    "author_client string, author_name string, author_key string",
    "cached": f"project_id string, memory_id string, {DOCUMENT_DDL}, origin string, cached_at string",
    "registry": "project_id string, label string, description string",
    "edges": "project_id string, src string, dst string, kind string, reason string",
    "usage_events": "project_id string, memory_id string, replica_id string, day bigint, "
    "surfaced bigint, direct bigint, applied bigint, ts string",
    "usage": "project_id string, memory_id string, replica_id string, surfaced bigint, "
    "surfaced_direct bigint, applied bigint, last_surfaced string, last_applied string, "
    "spread_bits bigint, spread_epoch bigint",
    "revisions": "project_id string, memory_id string, revised_at string, body string, "
    "author_client string, author_name string",
    "audit_runs": "run_id string, project_id string, started string, finished string, applied boolean, "
    "queries bigint, examined bigint, due bigint, promoted bigint, archived bigint, deleted bigint, "
    "capped bigint, policy string",
    "audit_findings": "run_id string, project_id string, memory_id string, slug string, tier int, "
    "verdict string, reason string, evidence string",
    "remotes": "name string, url string, description string, enabled boolean, added string, "
    "last_ok string, last_error string",
    "outbox": "id bigint, project_id string, memory_id string, remote string, queued_at string, "
    "attempts int, last_error string",
    "messages": "id string, project_id string, from_client string, from_name string, from_key string, "
    "to_client string, body string, about_memory string, in_reply_to string, sent_at string, read_at string",
    "clients": "client_id string, name string, created string, revoked_at string, projects array<string>",
    "jobs": "id bigint, project_id string, kind string, started string, finished string, "
    "outcome string, detail string",
}


def struct_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
