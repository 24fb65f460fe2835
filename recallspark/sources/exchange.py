"""Export and import of a store's durable content as JSON.

The export is a folder of JSON-lines tables, so no project passes through one
task. Single-document exports of formats 1 to 3 are read as well: their projects
are exploded inside the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallspark.operators.records import DOCUMENT_FIELDS
from recallspark.schema import DOCUMENT, DOCUMENT_DDL, STARTER_LABELS, STANDING_DDL, RecallError

# --------------------------------------------------------------- fixed values
FORMAT = "recallspark-export"
# Documents name the store that wrote them, then this.
DOCUMENT_SUFFIX = "-export"
FORMAT_VERSION = 3
COUNTERS = ("surfaced", "surfaced_direct", "applied", "last_surfaced", "last_applied", "spread_bits", "spread_epoch")
# ----------------------------------------------------------- end fixed values

_STANDING = ("tier", "tier_since", "tier_since_query", "archived_at", "merged_into", "visibility")
_USAGE_DDL = (
    "project_id string, slug string, replica_id string, surfaced bigint, surfaced_direct bigint, applied bigint, "
    "last_surfaced string, last_applied string, spread_bits bigint, spread_epoch bigint"
)


def starter_labels(spark: SparkSession, project: str) -> DataFrame:
    """The label registry a new project starts with."""
    rows = [(project, label, text) for label, text in STARTER_LABELS.items()]
    return spark.createDataFrame(rows, "project_id string, label string, description string")


def export(records: DataFrame, registry: DataFrame, usage: DataFrame, path: str, now: str, project: str | None = None) -> None:
    """Write documents with their standing, the registry, and counters by name and replica."""
    if project is not None:
        records, registry, usage = (df.where(F.col("project_id") == project) for df in (records, registry, usage))
    names = records.select("project_id", "memory_id", F.col("id").alias("slug"))
    named = usage.join(names, ["project_id", "memory_id"]).select("project_id", "slug", "replica_id", *COUNTERS)
    records.select("project_id", *DOCUMENT_FIELDS, *_STANDING).write.json(f"{path}/records")
    registry.select("project_id", "label", "description").write.json(f"{path}/labels")
    named.write.json(f"{path}/usage")
    head = records.sparkSession.createDataFrame([(FORMAT, FORMAT_VERSION, now)], "format string, format_version int, exported_at string")
    head.coalesce(1).write.json(f"{path}/header")


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an exported folder: ``records``, ``registry``, ``usage`` (by slug)."""
    head = spark.read.schema("format string, format_version int").json(f"{path}/header").head()
    if head is None or head["format"] != FORMAT:
        raise RecallError(f"{path} is not an export")
    return {
        "records": spark.read.schema(f"project_id string, {DOCUMENT_DDL}, {STANDING_DDL}").json(f"{path}/records"),
        "registry": spark.read.schema("project_id string, label string, description string").json(f"{path}/labels"),
        "usage": spark.read.schema(_USAGE_DDL).json(f"{path}/usage"),
    }


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same tables from a single JSON document of format 1, 2 or 3.

    Format 1 has one flat set of counters per record, credited to replica
    ``legacy``; formats before 3 have no standing, so defaults apply.
    """
    shape = (
        "format string, format_version int, projects map<string, struct<"
        f"labels:map<string,struct<description:string>>, memories:array<{DOCUMENT}>, "
        "usage:map<string,map<string,string>>, state:map<string,struct<tier:int,tier_since:string,"
        "tier_since_query:bigint,archived_at:string,merged_into:string,visibility:string>>>>"
    )
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json(F.ltrim(F.col("value"), F.lit("\ufeff")), shape).alias("d")).select("d.*")
    if doc.where(F.col("format").endswith(DOCUMENT_SUFFIX)).isEmpty():
        raise RecallError(f"{path} is not an export")
    projects = doc.select(F.explode("projects").alias("project_id", "p"))
    labels = projects.select("project_id", F.explode("p.labels").alias("label", "l")).select(
        "project_id", "label", F.coalesce("l.description", "label").alias("description"))
    rows = projects.select("project_id", F.explode("p.memories").alias("m"), "p.state").select(
        "project_id", "m.*", F.element_at("state", F.col("m.id")).alias("s"))

    def standing(name: str, default: Column) -> Column:
        return F.coalesce(f"s.{name}", default).alias(name)

    text_none = F.lit(None).cast("string")
    records = rows.select(
        "project_id", *DOCUMENT_FIELDS, standing("tier", F.lit(1)), standing("tier_since", text_none),
        standing("tier_since_query", F.lit(0).cast("long")), standing("archived_at", text_none),
        standing("merged_into", text_none), standing("visibility", F.lit("private")))
    counters = projects.select("project_id", F.explode("p.usage").alias("slug", "u"))
    nested = F.exists(F.map_values("u"), lambda v: v.startswith("{"))
    kept = F.map_filter("u", lambda k, v: v.startswith("{"))
    replicas = counters.select("project_id", "slug", F.explode(
        F.when(nested, kept).otherwise(F.create_map(F.lit("legacy"), F.to_json("u")))).alias("replica_id", "c"))
    # Flat counters were read as text; numbers in quotes still parse as numbers.
    number = lambda name: F.coalesce(F.get_json_object("c", f"$.{name}").try_cast("long"), F.lit(0).cast("long"))
    usage = replicas.select(
        "project_id", "slug", "replica_id",
        *[number(c).alias(c) for c in COUNTERS[:3]],
        *[F.get_json_object("c", f"$.{c}").alias(c) for c in COUNTERS[3:5]],
        number("spread_bits").alias("spread_bits"),
        F.get_json_object("c", "$.spread_epoch").try_cast("long").alias("spread_epoch"))
    return {"records": records, "registry": labels, "usage": usage}


def restore(
    held: dict[str, DataFrame], incoming: dict[str, DataFrame], now: str
) -> dict[str, DataFrame]:
    """Converge a store on an export: documents replace those of the same name, the rest stays.

    ``held`` has ``records``, ``registry`` and ``usage``. Existing records keep
    their ids; labels already registered stay as they are; counters of records the
    export does not carry are ignored.
    """
    records, registry, usage = held["records"], held["registry"], held["usage"]
    ids = records.select("project_id", "id", "memory_id")
    named = incoming["records"].join(ids, ["project_id", "id"], "left").withColumn(
        "memory_id", F.coalesce("memory_id", F.md5(F.concat_ws("/", "project_id", "id", F.lit(now))))
    ).withColumn("tier_since", F.coalesce("tier_since", F.lit(now)))
    kept = records.join(named.select("project_id", "memory_id"), ["project_id", "memory_id"], "left_anti")
    merged = kept.unionByName(named, allowMissingColumns=True).select(*records.columns)
    new_labels = incoming["registry"].join(registry, ["project_id", "label"], "left_anti")
    keys = named.select("project_id", F.col("id").alias("slug"), "memory_id")
    counted = incoming["usage"].join(keys, ["project_id", "slug"]).select(*usage.columns)
    old = usage.join(counted, ["project_id", "memory_id", "replica_id"], "left_anti")
    return {
        "records": merged,
        "registry": registry.unionByName(new_labels.select(*registry.columns)),
        "usage": old.unionByName(counted),
    }
