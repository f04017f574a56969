"""Subject wildcards: ``*`` is one token, a closing ``>`` is one or more."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard_regex(pattern: str) -> str:
    tokens = pattern.split(".")
    if any(t == "" for t in tokens):
        raise ValueError(f"empty token in subject {pattern!r}")
    parts = []
    for i, token in enumerate(tokens):
        if token == ">":
            if i != len(tokens) - 1:
                raise ValueError(f"'>' must close the subject {pattern!r}")
            parts.append(r"[\s\S]+")
        elif token == "*":
            parts.append(r"[^.]+")
        else:
            parts.append(re.escape(token))
    return r"\A" + r"\.".join(parts) + r"\z"


def subject_matches(subject: Column | str, pattern: str) -> Column:
    """Filter of one subscription; a plain ``prefix.>`` becomes a prefix test the scan can use."""
    col = F.col(subject) if isinstance(subject, str) else subject
    wildcard_regex(pattern)
    tokens = pattern.split(".")
    if pattern == ">":
        return F.length(col) > 0
    if "*" not in tokens and tokens[-1] == ">":
        prefix = pattern[:-1]
        return col.startswith(prefix) & (F.length(col) > len(prefix))
    if "*" not in tokens and ">" not in tokens:
        return col == pattern
    # The constant head, if any, is repeated as a prefix test for the scan.
    head = []
    for token in tokens:
        if token in ("*", ">"):
            break
        head.append(token)
    match = col.rlike(wildcard_regex(pattern))
    return col.startswith(".".join(head) + ".") & match if head else match
