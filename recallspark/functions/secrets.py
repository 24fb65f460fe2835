"""Credential detection in three tiers, as Column expressions.

Self-identifying shapes and vendor prefixes always count. Randomness counts only
in a text that also names a credential: a commit hash on its own is not a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --------------------------------------------------------------- fixed values
SHAPES = {
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "connection-password": r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@",
}
VENDORS = {
    "stripe": r"sk_live_[A-Za-z0-9]{16,}",
    "aws": r"AKIA[0-9A-Z]{16}",
    "github": r"ghp_[A-Za-z0-9]{36}",
}
# A key's own fingerprint is public by nature.
ALLOWED = r"SHA256:[A-Za-z0-9+/]{43}"
NAMED = r"(?i)(api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passw(or)?d|credential)"
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
HEX = r"^[0-9a-fA-F]+$"
HEX_BITS = 3.0
MIXED_BITS = 4.0
# ----------------------------------------------------------- end fixed values


def entropy(text: Column) -> Column:
    """Shannon bits per character."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def _hits(name: str, pattern: str, text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
        lambda hit: F.struct(F.lit(name).alias("rule"), hit.alias("value")))


def _random(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(f"({RANDOM})"), F.lit(1))
    high = F.filter(
        words,
        lambda w: F.when(w.rlike(HEX), entropy(w) >= HEX_BITS).otherwise(
            w.rlike("[0-9]") & w.rlike("[A-Za-z]") & (entropy(w) >= MIXED_BITS)))
    found = F.transform(high, lambda w: F.struct(F.lit("random-near-name").alias("rule"), w.alias("value")))
    return F.when(text.rlike(NAMED), found)


def suspicious(text: Column) -> Column:
    """Whether any shape, prefix or credential name occurs; without one nothing can be found."""
    sure = "|".join([*SHAPES.values(), *VENDORS.values()])
    return F.coalesce(text, F.lit("")).rlike(f"{sure}|(?:{NAMED})")


def findings(text: Column) -> Column:
    """Distinct ``(rule, masked)`` findings; the value itself never leaves the row."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), ALLOWED, " ")
    sure = [_hits(name, pattern, safe) for name, pattern in {**SHAPES, **VENDORS}.items()]
    nothing = F.array().cast("array<struct<rule:string,value:string>>")
    every = F.concat(*sure, F.coalesce(_random(safe), nothing))
    masked = F.array_distinct(F.transform(
        every,
        lambda f: F.struct(f["rule"].alias("rule"), F.concat(F.substring(f["value"], 1, 4), F.lit("...")).alias("masked"))))
    # Nearly every text is clean; one match of everything that could count says so.
    return F.when(suspicious(text), masked).otherwise(F.array().cast("array<struct<rule:string,masked:string>>"))


def has_secret(text: Column) -> Column:
    return F.size(findings(text)) > 0
