"""Tables that change a few rows at a time: a base and the changes since, folded when read.

A change holds the rows that were written and, marked ``_gone``, the keys of rows that were
removed; nothing else of a table is written again. Reading folds: of each key's changes the
last one counts. Tables without a key (logs) only grow.

On shared storage a :class:`ChangeLog` keeps, under ``heads/``, one small file per version
that names each table's base folder and change folders. A version becomes visible by a rename
of its head file to the next free number; a second writer finds the number taken and is
refused, so no change is lost. Compaction folds a table into a new base the same way.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallspark.schema import TABLES, RecallError
from recallspark.sources.files import create_text, list_names, read_text, remove

#: What names a row of each table; tables not listed are logs.
KEYS = {
    "projects": ["project_id"],
    "records": ["project_id", "memory_id"],
    "cached": ["project_id", "memory_id"],
    "registry": ["project_id", "label"],
    "edges": ["project_id", "src", "dst", "kind"],
    "usage": ["project_id", "memory_id", "replica_id"],
    "remotes": ["name"],
    "outbox": ["project_id", "memory_id", "remote"],
    "messages": ["id"],
    "clients": ["client_id"],
}
GONE = "_gone"


def change_rows(columns: list[str], puts: DataFrame | None, drops: DataFrame | None) -> DataFrame:
    """One change: whole rows of ``puts``, and the keys in ``drops`` with all else null."""
    rows = None
    if puts is not None:
        rows = puts.select(*columns).withColumn(GONE, F.lit(False))
    if drops is not None:
        gone = drops.distinct().withColumn(GONE, F.lit(True))
        rows = gone if rows is None else rows.unionByName(gone, allowMissingColumns=True)
    return rows


def last_of_each(changes: list[DataFrame], key: list[str]) -> DataFrame:
    """The change that counts of every key: the one of the latest change, a row before its removal."""
    rows = None
    for number, part in enumerate(changes):
        part = part.withColumn("_order", F.lit(number * 2) + (~F.col(GONE)).cast("int"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    every = [c for c in rows.columns if c != "_order"]
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(
        F.max_by(F.struct(*every), "_order").alias("_row")).select("_row.*")


def fold(base: DataFrame, changes: list[DataFrame], key: list[str] | None) -> DataFrame:
    """``base`` after ``changes``, oldest first. Without a key all rows are appended.

    A key with very many changes is no hot spot: each task keeps one row per key before the shuffle.
    """
    columns = base.columns
    if not changes:
        return base
    if key is None:
        for part in changes:
            base = base.unionByName(part.where(~F.col(GONE)).select(*columns))
        return base
    last = base.limit(0).withColumn(GONE, F.lit(False)).unionByName(last_of_each(changes, key), allowMissingColumns=True)
    return base.join(last.select(*key), key, "left_anti").select(*columns).unionByName(
        last.where(~F.col(GONE)).select(*columns))


def difference(before: DataFrame, after: DataFrame, key: list[str] | None) -> DataFrame:
    """The change that turns ``before`` into ``after``: rows that are new or differ, and keys that are gone."""
    columns = before.columns
    after = after.select(*columns)
    if key is None:
        return change_rows(columns, after.exceptAll(before), None)
    mark = F.xxhash64(*columns).alias("_mark")
    same = before.select(*key, mark)
    puts = after.select("*", mark).join(same, [*key, "_mark"], "left_anti")
    return change_rows(columns, puts, before.select(*key).join(after.select(*key), key, "left_anti"))


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        numbers = sorted(int(n.split(".")[0]) for n in list_names(spark, f"{self.root}/heads") if n.endswith(".json") and n[0] != ".")
        self.version = numbers[-1] if numbers else -1
        head = read_text(spark, self._head(self.version)) if numbers else None
        self.state = json.loads(head) if head else {"stamp": None, "tables": {}}

    def _head(self, version: int) -> str:
        return f"{self.root}/heads/{version:08}.json"

    def names(self) -> list[str]:
        return sorted(self.state["tables"])

    def read(self, table: str) -> DataFrame:
        """The table as of this version."""
        held = self.state["tables"][table]
        base = self.spark.read.parquet(f"{self.root}/{held['base']}") if table not in TABLES else self.spark.read.schema(
            TABLES[table]).parquet(f"{self.root}/{held['base']}")
        parts = [self.spark.read.parquet(f"{self.root}/{path}") for path in held["changes"]]
        return fold(base, parts, held["key"])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in self.names()}

    def commit(self, stamp: str, whole: dict[str, DataFrame] | None = None, changes: dict[str, DataFrame] | None = None,
               keys: dict[str, list[str]] | None = None) -> int:
        """Write tables that are replaced as a whole and rows of :func:`change_rows`, then make both visible at once."""
        name = uuid.uuid4().hex
        after = {k: dict(v, changes=list(v["changes"])) for k, v in self.state["tables"].items()}
        for table, df in (whole or {}).items():
            df.write.parquet(f"{self.root}/base/{name}/{table}")
            after[table] = {"base": f"base/{name}/{table}", "changes": [], "key": (keys or KEYS).get(table)}
        for table, rows in (changes or {}).items():
            if table not in after or table in (whole or {}):
                raise RecallError(f"table {table} has no base that this change is of")
            rows.write.parquet(f"{self.root}/change/{name}/{table}")
            after[table]["changes"].append(f"change/{name}/{table}")
        state = {"stamp": stamp, "tables": after}
        if not create_text(self.spark, self._head(self.version + 1), json.dumps(state)):
            raise RecallError(f"version {self.version + 1} was written by somebody else meanwhile")
        self.version, self.state = self.version + 1, state
        return self.version

    def compact(self, stamp: str, more_than: int = 0) -> list[str]:
        """Fold every table with more than so many changes into a new base; returns their names."""
        many = [t for t in self.names() if len(self.state["tables"][t]["changes"]) > more_than]
        keys = {t: self.state["tables"][t]["key"] for t in many}
        if many:
            self.commit(stamp, whole={t: self.read(t) for t in many}, keys=keys)
        return many

    def prune(self) -> int:
        """Remove older heads and the folders that only they name; returns how many folders went."""
        held = {p for t in self.state["tables"].values() for p in (t["base"], *t["changes"])}
        old = [f"{kind}/{n}/{t}" for kind in ("base", "change") for n in list_names(self.spark, f"{self.root}/{kind}")
               for t in list_names(self.spark, f"{self.root}/{kind}/{n}")]
        for version in range(self.version):
            remove(self.spark, self._head(version))
        gone = [p for p in old if p not in held]
        for path in gone:
            remove(self.spark, f"{self.root}/{path}")
        return len(gone)
