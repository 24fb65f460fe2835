"""Quality by hierarchical empirical Bayes: what a text shows, and what its site is like.

A document's own evidence is a logistic classifier over measures of its text. A site is a
host, and a path on it. From the labelled rows come counts per path, per host and in all;
each level's rate is shrunk toward the level above it by a strength that the data give
(method of moments over the groups of that level), so that a path with few labels says
what its host says, and a host with few what all do. The posterior joins both in log odds:
the classifier's, plus how far the site's rate lies from the global one. A row's own label
is left out of its site's counts, so it is never an input of its own score.

Measures are sums over the text made by built-in functions, counts are grouped
aggregations, and the classifier is fitted on at most ``max_labelled`` labelled rows (the
smallest hashes of the id). Whole texts count.

Defined results: null and empty texts have the measures of an empty text; a null host or
path is a site of its own; sites without labels take the rate of the level above; without
labels of both kinds every score is the smoothed global rate; rows repeated by id share
their label, one that says 1 and one that says 0 count as 0. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from recallspark.llm import blocks
from recallspark.llm.blocks import settle

MAX_LABELLED = 60_000
ROUNDS, RIDGE = 50, 1e-3
#: Bounds of a level's strength, in labels.
WEAKEST, STRONGEST = 1.0, 1000.0


def measures(text: Column) -> list[Column]:
    """What a text looks like, as numbers of about one size."""
    t = F.coalesce(text, F.lit(""))
    size = F.octet_length(t)
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    again = F.regexp_count(t, F.lit(r"(?<!\S)(\S+)\s+\1(?!\S)"))  # a word right after itself
    share = lambda n, of: n / F.greatest(of, F.lit(1))
    kept = lambda gone: F.length(F.translate(t, gone, ""))
    n = F.length(t)
    symbols, digits, stops, bars, lines = "#$%&*@^~=+<>{}[]\\_", "0123456789", ".,;:!?", "|", "\n"
    return [F.log1p(size), F.log1p(words), share(size, words) / 10, 10 * share(again, words), F.log1p(again), *(10 * share(n - kept(c), n) for c in (symbols, digits, stops, bars, lines)),
            F.log1p(n - kept(symbols)) / 5, F.log1p(n - kept(bars)) / 5]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the last for 1) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def strength(groups: DataFrame, rate: Column) -> float:
    """How many labels the level above is worth: m(1-m)/v - 1 of the groups' rates, noise taken off, within bounds."""
    got = groups.where("n > 0").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("pos") / F.col("n") - rate, F.lit(2.0))).alias("between"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("within"), F.sum(F.pow("n", F.lit(2.0))).alias("squares")).first()
    if not got["k"] or got["k"] < 2 or not got["within"]:
        return STRONGEST
    m = got["within"] / got["n"]
    spread = (got["between"] - got["k"] * m) / max(got["n"] - got["squares"] / got["n"], 1e-9)
    return float(min(max(m / spread - 1, WEAKEST), STRONGEST)) if spread > 0 else STRONGEST


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row: the key, ``host, path``, ``text_score`` (the classifier alone), ``site_rate`` (the shrunk rate of its path),
    ``n_site`` (labels behind it, the row's own left out) and ``score``."""
    found = measures(F.col(text))
    rows = docs.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"), F.array(*found).alias("x"))
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("y"))
    rows = settle(rows.join(marks, "_key", "left"))  # numbers only: the text has been read and is gone

    fitted = rows.where("y is not null").orderBy(F.xxhash64("_key"), "_key").limit(max_labelled).select("x", "y").toArrow()
    y = fitted["y"].to_numpy().astype(float)
    both = 0 < y.sum() < len(y)
    w = logistic(fitted["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1), y) if both else np.zeros(len(found) + 1)
    total = rows.where("y is not null").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    base = ((total["pos"] or 0) + 0.5) / (total["n"] + 1)

    paths = settle(rows.groupBy("host", "path").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")))
    hosts = settle(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("pos").alias("host_pos")))
    a = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_pos").alias("pos")), F.lit(base))
    sites = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    b = strength(sites, (F.col("host_pos") + a * base) / (F.col("host_n") + a))

    sites = settle(sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "pos", "host_n", "host_pos"))
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    own, mine = F.col("y").isNotNull().cast("int"), F.coalesce("y", F.lit(0))
    host_rate = (F.col("host_pos") - mine + a * base) / (F.col("host_n") - own + a)
    rate = (F.col("pos") - mine + b * host_rate) / (F.col("n") - own + b)
    odds = lambda p: F.log(p / (1 - p))
    logit = F.lit(float(w[-1])) if both else odds(F.lit(base))
    for i, weight in enumerate(w[:-1]):
        logit = logit + F.element_at("x", i + 1) * F.lit(float(weight))
    chance = lambda z: 1 / (1 + F.exp(-z))
    out = joined.withColumn("site_rate", F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6)))
    return out.select(F.col("_key").alias(key), "host", "path", chance(logit).alias("text_score"), "site_rate", (F.col("n") - own).alias("n_site"),
                      chance(logit + odds(F.col("site_rate")) - odds(F.lit(base))).alias("score"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and first folder of an address, for tables that have one."""
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*(/[^/?#]*)?", 1)


def query(spark, sf_dir: str) -> DataFrame:
    """``documents``: the source is the host, the language the path on it."""
    docs, labels = blocks.read(spark, sf_dir, "documents"), blocks.read(spark, sf_dir, "labels")
    out = score(docs, labels, F.col("source"), F.col("lang"))
    return out.withColumn("kept", F.col("score") >= 0.5)


QUERIES = {"op1_empirical_bayes": query}
#: The classifier is fitted by iteration; the tests compare the aggregation with plain sums.
ORACLES: dict[str, str] = {}
