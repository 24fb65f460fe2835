"""Hashes that identify keys and tokens, and small rules about clients."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def fingerprint(public_key: Column) -> Column:
    """Short public name of a key: unpadded base64 of its SHA-256."""
    return F.concat(F.lit("SHA256:"), F.rtrim(F.base64(F.unhex(F.sha2(public_key, 256))), F.lit("=")))


def in_scope(projects: Column, project: Column) -> Column:
    """A client without a project list reaches every project."""
    return projects.isNull() | F.array_contains(projects, project)


def queries_for_silence_to_count(share: float, doubt: float = 0.05) -> float:
    """How many queries a record relevant to ``share`` of them can miss by luck with chance ``doubt``."""
    return math.log(doubt) / math.log(1 - share)
