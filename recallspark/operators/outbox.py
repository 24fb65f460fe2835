"""Publication: who may leave, what is queued, and what a delivery run does with it.

A delivery is a set of rows under a run id in the destination's own folder; it counts once
the run's manifest, written last, is there. A run that is repeated, or that follows one whose
queue was never updated, finds what has been delivered and sends it no second time.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallspark.functions.secrets import findings
from recallspark.operators.records import DOCUMENT_FIELDS
from recallspark.schema import MIN_PROMOTION_TIER
from recallspark.session import settle, shared_dir
from recallspark.sources.files import create_text, list_names

KEY = ["project_id", "memory_id"]
#: Remotes that are written to at the same time.
ABREAST = 8
#: A remote's rows are dealt over so many tasks while they are laid out.
DEALT = 8
#: The remote's number while its rows are laid out.
TO = "_to"


def published_text() -> Column:
    """Everything of a document that would leave with it; key material fields are not part of it."""
    return F.to_json(F.struct(*[c for c in DOCUMENT_FIELDS if c != "schema_version"]))


def publication_state(records: DataFrame, cached: DataFrame) -> DataFrame:
    """``(project_id, slug, memory_id, tier, visibility, borrowed)``; a copy is public tier 0."""
    own = records.select("project_id", "slug", "memory_id", F.col("tier").cast("int").alias("tier"),
                         F.coalesce("visibility", F.lit("private")).alias("visibility"), F.lit(False).alias("borrowed"))
    names = records.select("project_id", "slug")
    copies = cached.join(names, ["project_id", "slug"], "left_anti").groupBy("project_id", "slug").agg(
        F.min("memory_id").alias("memory_id"))
    return own.unionByName(copies.select(
        "project_id", "slug", "memory_id", F.lit(0).alias("tier"), F.lit("public").alias("visibility"),
        F.lit(True).alias("borrowed")))


def gate(requests: DataFrame, state: DataFrame, bodies: DataFrame, remotes: DataFrame) -> DataFrame:
    """Add ``outcome`` to each request by the first rule that refuses it.

    ``requests``: ``project_id, slug, remote, force, allow_secrets``. ``bodies``:
    ``project_id, memory_id, text`` with everything that would be published.
    """
    known = remotes.select(F.col("name").alias("remote"), F.col("enabled").alias("_enabled"))
    asked = requests.join(state, ["project_id", "slug"], "left").join(known, "remote", "left")
    # Only texts somebody asks for are scanned.
    wanted = bodies.join(settle(asked.where("memory_id is not null").select(*KEY).distinct()), KEY, "left_semi")
    text = wanted.select(*KEY, F.explode(findings(F.col("text")))).groupBy(*KEY).agg(F.count("*").alias("_secrets"))
    asked = asked.join(text, KEY, "left")
    outcome = (
        F.when(F.col("memory_id").isNull(), "unknown record")
        .when(F.col("visibility") != "public", "private")
        .when(F.col("borrowed"), "borrowed")
        .when((F.col("tier") < MIN_PROMOTION_TIER) & ~F.col("force"), "tier too low")
        .when(F.col("_enabled").isNull(), "unknown remote")
        .when(~F.col("_enabled"), "remote disabled")
        .when(~F.col("allow_secrets") & (F.coalesce("_secrets", F.lit(0)) > 0), "holds a secret")
        .otherwise("queued")
    )
    return asked.select("project_id", "slug", "memory_id", "remote", "tier", outcome.alias("outcome"))


def enqueue(queue: DataFrame, accepted: DataFrame, now: str) -> DataFrame:
    """Queue each accepted (record, remote) once; asking again refreshes the row and clears its error."""
    fresh = accepted.select(*KEY, "remote").distinct().withColumn("_asked", F.lit(True))
    by = [*KEY, "remote"]
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"), F.lit(1).alias("_one"))  # one row
    joined = queue.join(fresh, by, "full").withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one")
    asked = F.coalesce("_asked", F.lit(False))
    return joined.select(
        F.coalesce("id", F.col("_top") + 1 + F.monotonically_increasing_id()).alias("id"),
        *by,
        F.when(asked, F.lit(now)).otherwise(F.col("queued_at")).alias("queued_at"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(~asked, F.col("last_error")).alias("last_error"),
    )


def status(queue: DataFrame, records: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` queue rows by id with their last error, named by slug where the record still exists."""
    first = queue.orderBy("id").limit(limit)
    named = first.join(records.select(*KEY, "slug"), KEY, "left")
    error = F.col("last_error") if "last_error" in queue.columns else F.lit(None).cast("string")
    return named.select("id", F.coalesce("slug", "memory_id").alias("name"), "remote", "queued_at", "attempts", error.alias("last_error"))


def classify(queue: DataFrame, records: DataFrame, remotes: DataFrame, text: Column) -> DataFrame:
    """What a delivery run does with every queue row: ``drop``, ``skip``, ``hold`` or ``send``.

    ``text`` is the publishable content of a ``records`` row; it is scanned here
    again because a body may have changed while its row waited. Only records with
    a row waiting for an open remote are read.
    """
    state = records.select(*KEY, "slug", "archived_at", F.lit(True).alias("_here"))
    enabled = remotes.where("enabled").select(F.col("name").alias("remote"), F.lit(True).alias("_open"))
    rows = queue.join(state, KEY, "left").join(enabled, "remote", "left")
    waiting = rows.where(F.col("_here") & F.col("archived_at").isNull() & F.col("_open"))
    texts = records.join(settle(waiting.select(*KEY).distinct()), KEY, "left_semi")
    scanned = texts.select(*KEY, F.explode(findings(text)).alias("_f")).groupBy(*KEY).agg(
        F.array_sort(F.collect_list("_f")).alias("_found"))
    rows = rows.join(scanned, KEY, "left")
    action = (
        F.when(F.col("_here").isNull() | F.col("archived_at").isNotNull(), "drop")
        .when(F.col("_open").isNull(), "skip")
        .when(F.col("_found").isNotNull(), "hold")
        .otherwise("send")
    )
    why = F.when(
        action == "hold",
        F.concat(F.lit("held: "), F.array_join(F.transform(
            "_found", lambda f: F.concat(f["rule"], F.lit(" "), f["masked"])), "; ")))
    return rows.select("id", *KEY, F.coalesce("slug", "memory_id").alias("name"), "remote", "queued_at",
                       "attempts", action.alias("action"), why.alias("last_error"))


def after_delivery(classified: DataFrame, failed: DataFrame) -> DataFrame:
    """The queue a run leaves behind. ``failed`` is ``(id, error)`` for sends that did not land."""
    left = classified.where(F.col("action") != "drop").join(
        failed.select("id", "error", F.lit(True).alias("_failed")), "id", "left")
    missed = (F.col("action") == "send") & F.col("_failed")
    kept = left.where((F.col("action") != "send") | missed)
    return kept.select(
        "id", *KEY, "remote", "queued_at",
        (F.col("attempts") + F.when(missed, 1).otherwise(0)).alias("attempts"),
        F.when(missed, F.col("error")).otherwise(F.col("last_error")).alias("last_error"))


def delivered(spark: SparkSession, url: str) -> DataFrame | None:
    """What a destination holds: rows of the runs whose manifest is there; None before the first."""
    runs = [n[: -len(".json")] for n in list_names(spark, f"{url}/_runs") if n.endswith(".json") and n[0] != "."]
    found = None
    for run in runs:
        rows = spark.read.parquet(f"{url}/run={run}").withColumn("run", F.lit(run))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def deliver(classified: DataFrame, bodies: DataFrame, remotes: DataFrame, run: str, now: str) -> tuple[DataFrame, dict[str, str | None]]:
    """Send every ``send`` row to its remote's folder (``url``), once.

    ``bodies`` has ``project_id, memory_id`` and what is sent of a record. Returns ``(id, error)`` of the
    rows that did not land, and per remote that had rows the error, or None. A remote that cannot be
    written does not stop the others. Remotes are few and kept by hand, so they are gone through here,
    some at a time; the rows of each are written by Spark. Bodies are read once for all remotes: the
    rows that are new to their remote are laid out by remote before any of them is sent.
    """
    spark = classified.sparkSession
    sends = classified.where(F.col("action") == "send").select("id", *KEY, "remote", "queued_at")
    names = [r["remote"] for r in sends.select("remote").distinct().orderBy("remote").collect()]
    if not names:
        return spark.createDataFrame([], "id bigint, error string"), {}
    urls = {r["name"]: r["url"] for r in remotes.where("enabled").select("name", "url").collect()}
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"{TO} int, remote string"))  # one row per remote
    sent = settle(sends.join(numbers, "remote").repartitionByRange(TO, "id"))

    def tried(step):
        def one(to: int):
            try:
                return step(to), None
            except Exception as error:  # one destination out of reach is that destination's outcome
                return None, str(error).strip().splitlines()[0][:200] if str(error).strip() else type(error).__name__
        return one

    def fresh(to: int) -> DataFrame | None:
        rows = sent.where(F.col(TO) == to)
        before = delivered(spark, urls[names[to]].rstrip("/"))
        if before is None:
            return rows
        rows = rows.join(before.select("id", "queued_at").distinct(), ["id", "queued_at"], "left_anti").select(*sent.columns)
        return None if rows.isEmpty() else settle(rows)  # written here, where what it reads fails alone

    def send(to: int) -> None:
        url, mine = urls[names[to]].rstrip("/"), run
        while f"{mine}.json" in list_names(spark, f"{url}/_runs"):
            mine += "+"  # the id was used for other rows before
        staged.where(F.col(TO) == to).drop(TO).write.mode("overwrite").parquet(f"{url}/run={mine}")
        create_text(spark, f"{url}/_runs/{mine}.json", json.dumps({"run": mine, "at": now}))

    with ThreadPoolExecutor(ABREAST) as several:
        found = list(several.map(tried(fresh), range(len(names))))
        errors = [error for _, error in found]
        due = [to for to, (rows, _) in enumerate(found) if rows is not None]
        if due:
            staged = _by_remote(reduce(DataFrame.unionByName, (found[to][0] for to in due)).join(bodies, KEY))
            for to, (_, error) in zip(due, several.map(tried(send), due)):
                errors[to] = error
    outcome = dict(zip(names, errors))
    failed = [(name, error) for name, error in outcome.items() if error is not None]
    lost = spark.createDataFrame(failed, "remote string, error string")
    return sent.join(lost, "remote").select("id", "error"), outcome


def _by_remote(rows: DataFrame) -> DataFrame:
    """Rows written by their remote's number, so that one remote's are read without the others'."""
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/settled/{uuid.uuid4().hex}"
    dealt = rows.repartition(TO, F.pmod(F.xxhash64(*KEY), F.lit(DEALT)))
    dealt.write.partitionBy(TO).parquet(path)
    kept = [c for c in rows.columns if c != TO]
    return rows.sparkSession.read.schema(rows.select(*kept, TO).schema).parquet(path)


def stamped(remotes: DataFrame, outcome: dict[str, str | None], now: str) -> DataFrame:
    """Remotes with ``last_ok`` and ``last_error`` as a run left them."""
    rows = remotes.sparkSession.createDataFrame([(n, e) for n, e in outcome.items()], "name string, _error string").withColumn("_hit", F.lit(True))
    joined = remotes.join(rows, "name", "left")
    ok = F.col("_hit") & F.col("_error").isNull()
    return joined.withColumn("last_ok", F.when(ok, F.lit(now)).otherwise(F.col("last_ok"))).withColumn(
        "last_error", F.when(F.col("_hit"), F.col("_error")).otherwise(F.col("last_error"))).select(*remotes.columns)
