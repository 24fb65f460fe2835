"""The given Parquet tables seen as records, links, usage and queues.

Every mapping is a deterministic row expression, so the same table can be
written in plain SQL (see ``suite/ctes.py``) and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallspark.schema import ORDINAL_OF_EPOCH


#: Tables smaller than this are dealt out over all cores.
DEALT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to process.

    A small file would be worked through by one task; only a table below
    ``DEALT_BYTES`` has its rows dealt out by ``key`` first. Larger ones are left alone.
    """
    df = table(spark, sf_dir, name)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism, key) if size < DEALT_BYTES else df


def stamp(base: str, hours: Column) -> Column:
    """``base`` (a date) plus whole hours, as the fixed-width UTC string."""
    days = F.floor(hours / 24).cast("int")
    hour = F.lpad(F.pmod(hours, F.lit(24)).cast("string"), 2, "0")
    day = F.date_add(F.lit(base).cast("date"), days).cast("string")
    return F.concat(day, F.lit("T"), hour, F.lit(":00:00Z"))


def memory_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit("doc-"), doc_id.cast("string")))


def memories(spark: SparkSession, sf_dir: str, reading: bool = False) -> DataFrame:
    """``documents`` with their ``labels`` row as knowledge records.

    ``reading`` says the texts themselves will be processed.
    """
    docs = texts(spark, sf_dir, "documents", "doc_id") if reading else table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = docs.join(marks, "doc_id", "left")
    doc_id = F.col("doc_id")
    size = (
        F.when(F.col("n_chars") < 500, "size:small")
        .when(F.col("n_chars") < 2000, "size:medium")
        .when(F.col("n_chars") < 8000, "size:large")
        .otherwise("size:huge")
    )
    created = F.when(doc_id % 97 != 0, stamp("2020-01-01", doc_id))
    return d.select(
        F.col("lang").alias("project_id"),
        memory_key(doc_id).alias("memory_id"),
        F.concat(F.lit("doc-"), doc_id.cast("string")).alias("slug"),
        "doc_id",
        F.when(F.col("toxic") == 1, "wrong")
        .when(F.col("quality") == 0, "stale")
        .when(doc_id % 11 == 0, "superseded")
        .otherwise("active")
        .alias("status"),
        F.col("text").alias("description"),
        F.array("lang").alias("tags"),
        F.array_compact(
            F.array(
                F.concat(F.lit("source:"), "source"),
                size,
                F.when(F.col("quality").isNotNull(), F.lit("kind:rated")),
                F.when(F.col("toxic") == 1, F.lit("kind:toxic")),
            )
        ).alias("labels"),
        F.array(F.concat(F.lit("record "), doc_id.cast("string"))).alias("triggers"),
        F.array(F.concat(F.lit("data/"), "source", F.lit(".txt")),
                F.concat(F.lit("bucket/"), (doc_id % 7).cast("string"), F.lit(".txt"))).alias("files"),
        F.col("source").alias("area"),
        created.alias("created"),
        (1 + doc_id % 4).cast("int").alias("tier"),
        F.when(doc_id % 5 != 0, stamp("2020-02-01", doc_id)).alias("tier_since"),
        (doc_id % 500).alias("tier_since_query"),
        F.when(doc_id % 13 == 0, F.lit("2024-01-15T00:00:00Z")).alias("archived_at"),
        F.when(doc_id % 3 == 0, "public").otherwise("private").alias("visibility"),
    )


def cached(spark: SparkSession, sf_dir: str, reading: bool = False) -> DataFrame:
    """``pages`` as copies borrowed from other servers."""
    p = texts(spark, sf_dir, "pages", "page_id") if reading else table(spark, sf_dir, "pages")
    page_id = F.col("page_id")
    return p.select(
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("project_id"),
        F.md5(F.concat(F.lit("page-"), page_id.cast("string"))).alias("memory_id"),
        F.concat(F.lit("page-"), page_id.cast("string")).alias("slug"),
        F.lit("active").alias("status"),
        F.col("html").alias("description"),
        F.array(F.lit("source:web")).alias("labels"),
        F.regexp_extract("url", r"//[^/]*\.([a-z]+)/", 1).alias("origin"),
        stamp("2024-01-01", page_id * 5).alias("cached_at"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as questions, routed to a project by their spelling."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.when(F.col("text").rlike("[ñó]"), "es")
        .when(F.col("text").rlike("[çèê]"), "fr")
        .when(F.col("text").rlike("[äöüß]"), "de")
        .otherwise("en")
        .alias("project_id"),
        F.col("text").alias("query"),
    )


def authored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered part/supplier pairs as typed links between records of one project."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    pairs = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_partkey") != F.col("l_suppkey"))
        .select(
            F.col("l_partkey").alias("a"),
            F.col("l_suppkey").alias("b"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "supersedes")
            .otherwise("related")
            .alias("kind"),
        )
        .distinct()
    )
    return (
        pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("lang").alias("project_id")), "a")
        .join(docs.select(F.col("doc_id").alias("b"), F.col("lang").alias("project_id")),
              ["b", "project_id"])
        .select(
            "project_id",
            memory_key(F.col("a")).alias("src"),
            memory_key(F.col("b")).alias("dst"),
            "kind",
        )
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sightings of a record; days are stretched past the 64-day window."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"), F.col("lang").alias("project_id"))
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return as_usage(e.join(docs, "user_id"))


def as_usage(e: DataFrame) -> DataFrame:
    """Event rows that know their project, batch or stream."""
    date = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 100).cast("int"))
    kind = F.col("event_type")
    return e.select(
        "project_id",
        memory_key(F.col("user_id")).alias("memory_id"),
        F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("replica_id"),
        (F.unix_date(date).cast("long") + ORDINAL_OF_EPOCH).alias("day"),
        kind.isin("view", "click").cast("long").alias("surfaced"),
        (kind == "click").cast("long").alias("direct"),
        (kind == "purchase").cast("long").alias("applied"),
        F.concat(date.cast("string"), F.lit("T00:00:00Z")).alias("ts"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure counter per project: one per event seen there."""
    return usage_events(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("queries"))


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.concat(F.lit("remote-"), F.col("item_id").cast("string")).alias("name"),
        F.col("text").alias("description"),
        (F.col("item_id") % 5 != 0).alias("enabled"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as queue rows; the project is that of the record, null where there is none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("o_custkey"), F.col("lang").alias("project_id"))
    o = table(spark, sf_dir, "orders").join(docs, "o_custkey", "left")
    return o.select(
        F.col("o_orderkey").alias("id"),
        "project_id",
        memory_key(F.col("o_custkey")).alias("memory_id"),
        F.concat(F.lit("remote-"), (F.col("o_orderkey") % 50).cast("string")).alias("remote"),
        F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T00:00:00Z")).alias("queued_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat("conv_id", F.lit("-"), "turn").alias("id"),
        F.concat(F.lit("client-"), (F.col("conv_id") % 7).cast("string")).alias("to_client"),
        F.col("role").alias("from_client"),
        F.col("text").alias("body"),
        stamp("2024-01-01", F.col("conv_id") * 24 + F.col("turn")).alias("sent_at"),
        F.when(F.col("turn") % 3 == 0, F.lit("2024-06-01T00:00:00Z")).alias("read_at"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that still exist, as a file listing would report them."""
    d = table(spark, sf_dir, "documents")
    data = d.where(~F.col("source").rlike("[048]$")).select(
        F.concat(F.lit("data/"), "source", F.lit(".txt")).alias("path"))
    bucket = d.where(F.col("doc_id") % 7 < 3).select(
        F.concat(F.lit("bucket/"), (F.col("doc_id") % 7).cast("string"), F.lit(".txt")).alias("path"))
    return data.union(bucket).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as whole record documents, some of them breaking a rule."""
    m = memories(spark, sf_dir)
    n = F.col("doc_id")

    def link(to: Column) -> Column:
        short = F.when(n % 29 == 0, "Near.").otherwise("Next to it in the source.")
        return F.struct(F.concat(F.lit("doc-"), to.cast("string")).alias("id"), short.alias("reason"))

    related = F.array_compact(F.array(F.when(n % 3 != 0, link(n + 1)), F.when(n % 4 == 0, link(n - 1))))
    supersedes = F.array_compact(F.array(F.when(n % 10 == 0, F.concat(F.lit("doc-"), (n - 2).cast("string")))))
    none = F.array().cast("array<string>")
    return m.select(
        "project_id", "memory_id", "doc_id",
        F.lit(1).alias("schema_version"), F.col("slug").alias("id"), "status", "description",
        F.when(n % 19 == 0, F.concat("tags", "tags")).otherwise(F.col("tags")).alias("tags"),
        "labels",
        F.struct(F.col("project_id").alias("project"), "area", "files", none.alias("applies_to")).alias("scope"),
        "triggers",
        F.when(n % 31 == 0, none).otherwise(F.array(F.concat(F.lit("note "), F.col("slug")))).alias("remembered_facts"),
        none.alias("solution_pattern"), none.alias("pitfalls"),
        F.struct(
            F.lit("import").alias("created_from_task"),
            F.when(n % 23 == 0, "2024/01/01").otherwise("2024-01-01").alias("last_validated"),
            "created").alias("evidence"),
        F.struct(related.alias("related"), supersedes.alias("supersedes"), none.alias("superseded_by")).alias("relationships"),
        "tier", "tier_since", "tier_since_query", "archived_at", F.lit(None).cast("string").alias("merged_into"), "visibility",
    )
