"""One question to several stores: local first, remote datasets where they can be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from recallspark.operators import cache, fusion
from recallspark.session import settle

RANKED = ["query_id", "rank", "uuid", "slug", "status", "description", "labels"]


def recall_across(
    local: DataFrame, remotes: dict[str, Callable[[], DataFrame]], limit: int = 8
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """``(fused, answers, unreachable)``.

    ``local`` and every remote answer are ranked lists with the ``RANKED`` columns,
    ranks from 0. A remote whose dataset cannot be read is reported with the
    reason and leaves the others' answer intact; the local list always counts.
    ``answers`` holds what the remotes returned, for the cache.
    """
    lists = local.select(*RANKED, F.lit("local").alias("source"))
    answers, unreachable = None, {}
    for name in sorted(remotes):
        try:
            answer = settle(remotes[name]().select(*RANKED, F.lit(name).alias("source")))
        except AnalysisException as error:
            unreachable[name] = str(error)
            continue
        answers = answer if answers is None else answers.unionByName(answer)
    if answers is None:
        answers = lists.limit(0)
    fused = fusion.fuse(lists.unionByName(answers).select("query_id", "source", "rank", "uuid", "slug"), limit)
    return fused, answers, unreachable


def remember(held: DataFrame, answers: DataFrame, project: str, now: str) -> DataFrame:
    """The cache after keeping every remote answer, newest content per record."""
    incoming = answers.select(
        F.lit(project).alias("project_id"), F.col("uuid").alias("memory_id"), "slug", "status", "description", "labels",
        F.col("source").alias("origin"), F.lit(None).cast("string").alias("created"), F.lit(now).alias("cached_at"))
    return cache.refresh(held, incoming)
