"""Filtering, point lookup and the creation timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recallspark.functions.labels import compile_labels
from recallspark.functions.rank import top_k
from recallspark.schema import DEFAULT_STATUSES, STATUSES, RecallError

LIGHT = ("slug", "status", "description", "labels", "tags", "triggers")


def status_filter(wanted: object = None) -> Column:
    """None means active and stale, ``'all'`` means any; unknown names are refused."""
    if wanted == "all":
        return F.lit(True)
    names = DEFAULT_STATUSES if wanted is None else [wanted] if isinstance(wanted, str) else list(wanted)
    unknown = sorted(set(names) - set(STATUSES))
    if unknown:
        raise RecallError(f"Unknown statuses: {', '.join(unknown)}")
    return F.col("status").isin(*names)


def entry_text() -> Column:
    """What a substring filter looks at."""
    return F.lower(
        F.concat_ws(
            "\n", "slug", "description", F.array_join("tags", " "), F.array_join("labels", " "),
            F.array_join("triggers", " "),
        )
    )


def search(
    records: DataFrame,
    project: str | None = None,
    label_query: object = None,
    known_labels: set[str] | None = None,
    statuses: object = None,
    text: str | None = None,
    limit: int | None = None,
    include_archived: bool = False,
) -> DataFrame:
    """Records passing every filter, by slug. ``project=None`` searches all of them."""
    kept = records if project is None else records.where(F.col("project_id") == project)
    if not include_archived:
        kept = kept.where(F.col("archived_at").isNull())
    kept = kept.where(status_filter(statuses)).where(compile_labels(label_query, known_labels).predicate)
    needle = (text or "").lower().strip()
    if needle:
        kept = kept.where(F.contains(entry_text(), F.lit(needle)))
    found = kept.select("project_id", *LIGHT)
    if limit is None:
        return found
    if limit < 1:
        raise RecallError("limit must be >= 1.")
    return found.orderBy("slug", "project_id").limit(limit)


def lookup(owned: DataFrame, borrowed: DataFrame, slugs: DataFrame) -> DataFrame:
    """Resolve ``(project_id, slug)`` to one record: owned first, else the newest copy."""
    mine = owned.join(slugs, ["project_id", "slug"], "left_semi").select(
        "project_id", "slug", "memory_id", "status", "description",
        F.lit(None).cast("string").alias("origin"), F.lit(0).alias("_side"),
        F.lit(None).cast("string").alias("cached_at"))
    theirs = borrowed.join(slugs, ["project_id", "slug"], "left_semi").select(
        "project_id", "slug", "memory_id", "status", "description", "origin",
        F.lit(1).alias("_side"), "cached_at")
    ordered = [F.col("_side"), F.col("cached_at").desc(), F.col("memory_id")]
    best = top_k(mine.unionByName(theirs), ["project_id", "slug"], ordered, 1)
    return best.drop("rn", "_side", "cached_at")


def resultable(owned: DataFrame, borrowed: DataFrame) -> DataFrame:
    """Rows that may occupy a result slot: live owned records, and copies not also owned."""
    cols = ["project_id", "memory_id", "slug", "status", "labels", "description"]
    live = owned.where(F.col("archived_at").isNull()).select(*cols)
    copies = borrowed.join(live.select("project_id", "memory_id"), ["project_id", "memory_id"], "left_anti")
    return live.withColumn("origin", F.lit(None).cast("string")).unionByName(
        copies.select(*cols, "origin"))


def timeline(
    records: DataFrame,
    project: str,
    before: str | None = None,
    after: str | None = None,
    limit: int = 8,
    offset: int = 0,
    statuses: object = None,
    label_query: object = None,
    known_labels: set[str] | None = None,
) -> DataFrame:
    """Records nearest an anchor in creation order (newest first without one).

    The label filter applies to the page after it was cut, so a page can come
    back short.
    """
    if limit < 1 or offset < 0:
        raise RecallError("limit must be >= 1 and offset >= 0.")
    if before and after:
        raise RecallError("Pass before or after, not both.")
    here = records.where(F.col("project_id") == project)
    window = here.where(F.col("archived_at").isNull()).where(status_filter(statuses))
    anchor = before or after
    if anchor is not None:
        # One row: its two values become literals the Parquet scan can skip on.
        row = here.where(F.col("slug") == anchor).select("created", "slug").head()
        if row is None:
            raise RecallError(f"Unknown memory id: {anchor}")
        created, slug = F.lit(row["created"]), F.lit(row["slug"])
        mine, its = F.col("created"), F.col("slug")
        if after:
            window = window.where((mine > created) | ((mine == created) & (its > slug)))
        else:
            window = window.where((mine < created) | ((mine == created) & (its < slug)))
    if after:
        order = [F.col("created").asc(), F.col("slug").asc()]
    else:
        order = [F.col("created").desc(), F.col("slug").desc()]
    page = window.orderBy(*order).offset(offset).limit(limit)
    return page.where(compile_labels(label_query, known_labels).predicate).select(
        "project_id", "memory_id", "created", *LIGHT)


def archived(records: DataFrame, project: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest archives first."""
    return (
        records.where((F.col("project_id") == project) & F.col("archived_at").isNotNull())
        .orderBy(F.col("archived_at").desc(), F.col("slug").desc())
        .offset(offset).limit(limit)
        .select("project_id", "archived_at", *LIGHT)
    )


def label_groups(registry: DataFrame) -> DataFrame:
    """The registry grouped by the prefix before ``:``; the registry is a vocabulary, not data."""
    return registry.groupBy("project_id", F.split("label", ":")[0].alias("prefix")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "description")))).alias("labels"))


def project_contents(**tables: DataFrame) -> DataFrame:
    """Rows per project and table."""
    counts = [
        df.groupBy("project_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    together = counts[0]
    for more in counts[1:]:
        together = together.unionByName(more)
    return together.groupBy("project_id").pivot("table", sorted(tables)).agg(F.sum("n")).na.fill(0)
