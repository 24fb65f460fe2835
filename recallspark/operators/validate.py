"""Document rules, link consistency and file anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recallspark.schema import (
    DATE_PATTERN,
    ID_PATTERN,
    LABEL_PATTERN,
    STATUSES,
)

# --------------------------------------------------------------- fixed values
REQUIRED = (
    "schema_version", "id", "status", "description", "tags", "labels", "scope", "triggers", "remembered_facts",
    "solution_pattern", "pitfalls", "evidence", "relationships",
)
NESTED = {
    "scope": (("project", "area", "files"), ("applies_to",)),
    "evidence": (("created_from_task", "last_validated"), ("created",)),
    "relationships": (("related", "supersedes", "superseded_by"), ()),
}
# ----------------------------------------------------------- end fixed values


def _when(condition: Column, message: Column | str) -> Column:
    """A one-message array where ``condition`` holds, else an empty one."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def _each(items: Column, bad, message) -> Column:
    return F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), bad), message)


def _strings(name: str, value: Column, unique: bool = False, at_least: int = 0, pattern: str | None = None) -> list[Column]:
    rules = [_when(value.isNull(), f"field '{name}' must be an array.")]
    if at_least:
        rules.append(_when(F.size(value) < at_least, f"field '{name}' must have at least {at_least} item(s)."))
    if pattern:
        rules.append(_each(
            value, lambda x: ~x.rlike(pattern),
            lambda x: F.concat(F.lit(f"field '{name}' value '"), x, F.lit("' has an invalid format."))))
    if unique:
        rules.append(_when(F.size(F.array_distinct(value)) != F.size(value), f"field '{name}' contains duplicate values."))
    return rules


def document_errors(known_labels: list[str] | None = None, skip: tuple[str, ...] = ()) -> Column:
    """All messages for a typed document row; an empty array means valid.

    ``known_labels`` is the registry, a vocabulary people maintain by hand.
    """
    c = F.col
    rules: list[Column] = []
    if "schema_version" not in skip:
        rules.append(_when(~c("schema_version").eqNullSafe(1), "schema_version must be 1."))
    rules += [
        _when(~F.coalesce(c("id").rlike(ID_PATTERN), F.lit(False)), "id must be lowercase kebab-case."),
        _when(
            ~F.coalesce(c("status").isin(*STATUSES), F.lit(False)),
            F.concat(F.lit("status '"), F.coalesce("status", F.lit("None")),
                     F.lit(f"' is not one of {sorted(STATUSES)}."))),
        _when(F.coalesce(F.length("description"), F.lit(0)) < 20,
              "description must be a string of at least 20 characters."),
        *_strings("tags", c("tags"), unique=True),
        *_strings("labels", c("labels"), unique=True, at_least=1, pattern=LABEL_PATTERN),
        *_strings("triggers", c("triggers"), unique=True, at_least=1),
        *_strings("remembered_facts", c("remembered_facts"), at_least=1),
        *_strings("solution_pattern", c("solution_pattern")),
        *_strings("pitfalls", c("pitfalls")),
    ]
    if known_labels is not None:
        registry = F.array(*[F.lit(label) for label in known_labels]).cast("array<string>")
        rules.append(_each(
            c("labels"), lambda x: x.rlike(LABEL_PATTERN) & ~F.array_contains(registry, x),
            lambda x: F.concat(F.lit("label '"), x, F.lit("' is not declared in labels.json."))))
    rules += _strings("scope.files", c("scope.files"), unique=True)
    rules += [
        _when(F.size(F.array_distinct("scope.applies_to")) != F.size("scope.applies_to"),
              "field 'scope.applies_to' contains duplicate values."),
        _when(~F.coalesce(c("evidence.last_validated").rlike(DATE_PATTERN), F.lit(False)),
              "evidence.last_validated must be YYYY-MM-DD."),
    ]
    related = F.coalesce("relationships.related", F.array().cast("array<struct<id:string,reason:string>>"))
    rules += [
        F.transform(F.filter(related, lambda r: ~F.coalesce(r["id"].rlike(ID_PATTERN), F.lit(False))),
                    lambda r: F.lit("relationships.related id must be lowercase kebab-case.")),
        F.transform(F.filter(related, lambda r: F.coalesce(F.length(r["reason"]), F.lit(0)) < 10),
                    lambda r: F.lit("relationships.related reason must be a string of at least 10 characters.")),
        *_strings("relationships.supersedes", c("relationships.supersedes"), unique=True, pattern=ID_PATTERN),
        *_strings("relationships.superseded_by", c("relationships.superseded_by"), unique=True, pattern=ID_PATTERN),
    ]
    return F.concat(*rules)


def shape_errors(body: Column) -> Column:
    """Missing and unknown fields of a JSON document, top level and nested: a closed world."""
    keys = F.json_object_keys(body)
    known = F.array(*map(F.lit, REQUIRED))
    rules = [
        _when(keys.isNull(), "memory must be a JSON object."),
        F.transform(F.filter(known, lambda f: ~F.array_contains(keys, f)),
                    lambda f: F.concat(F.lit("missing required field '"), f, F.lit("'."))),
        F.transform(F.filter(keys, lambda f: ~F.array_contains(known, f)),
                    lambda f: F.concat(F.lit("unknown field '"), f, F.lit("'."))),
    ]
    for name, (needed, optional) in NESTED.items():
        inner = F.json_object_keys(F.get_json_object(body, f"$.{name}"))
        need, allowed = F.array(*map(F.lit, needed)), F.array(*map(F.lit, needed + optional))
        rules += [
            _when(inner.isNull() & F.array_contains(keys, name), f"{name} must be an object."),
            _missing(name, need, inner),
            _unknown(name, allowed, inner),
        ]
    nothing = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(r, nothing) for r in rules])


def _missing(name: str, need: Column, inner: Column) -> Column:
    return F.transform(F.filter(need, lambda f: ~F.array_contains(inner, f)),
                       lambda f: F.concat(F.lit(f"{name} is missing '"), f, F.lit("'.")))


def _unknown(name: str, allowed: Column, inner: Column) -> Column:
    return F.transform(F.filter(inner, lambda f: ~F.array_contains(allowed, f)),
                       lambda f: F.concat(F.lit(f"{name} has unknown field '"), f, F.lit("'.")))


def link_errors(links: DataFrame, records: DataFrame) -> DataFrame:
    """``related`` links whose target is missing, or does not point back.

    ``links`` is ``(project_id, src, dst)`` as written in the bodies.
    """
    names = records.select("project_id", F.col("slug").alias("dst")).distinct()
    dangling = links.join(names, ["project_id", "dst"], "left_anti").select(
        "project_id", "src", "dst", F.lit("references unknown memory").alias("error"))
    back = links.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    one_way = links.join(names, ["project_id", "dst"], "left_semi").join(
        back, ["project_id", "src", "dst"], "left_anti"
    ).select("project_id", "src", "dst", F.lit("is not mirrored back").alias("error"))
    return dangling.unionByName(one_way)


def anchors_adrift(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Live records none of whose files exist any more; records without files are not checked."""
    files = records.where(F.col("archived_at").isNull()).select(
        "project_id", "memory_id", "slug", "status", F.explode(F.array_distinct("files")).alias("path"))
    seen = listing.select("path", F.lit(1).alias("_there")).distinct()
    return (
        files.join(seen, "path", "left")
        .groupBy("project_id", "memory_id", "slug", "status")
        .agg(F.count("*").alias("files"), F.count("_there").alias("standing"))
        .where(F.col("standing") == 0).drop("standing")
    )


def mark_stale(records: DataFrame, adrift: DataFrame) -> DataFrame:
    """Active records that lost every anchor become stale; other statuses stay."""
    lost = adrift.select("project_id", "memory_id", F.lit(True).alias("_lost"))
    return records.join(lost, ["project_id", "memory_id"], "left").withColumn(
        "status", F.when(F.col("_lost") & (F.col("status") == "active"), "stale").otherwise(F.col("status"))).drop("_lost")
