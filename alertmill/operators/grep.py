"""Search text lines by regular expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.operators.documents import PAGE_BYTES, replies
from alertmill.operators.patterns import PatternSet, compile_patterns, route_matches
from alertmill.storage import materialize

# Outcomes.
OK, NO_CONTENT, BAD_REQUEST = "ok", "no_content", "bad_request"


def grep(lines: DataFrame, queries: DataFrame, text: str = "value", pattern: str = "pattern") -> tuple[DataFrame, PatternSet]:
    """Lines matching each distinct pattern of ``queries``, with that ``pattern``."""
    compiled = compile_patterns(queries, pattern)
    return route_matches(lines, text, compiled).drop("route"), compiled


def grep_outcomes(
    lines: DataFrame, queries: DataFrame, position: str, text: str = "value", query_id: str = "query_id", page_bytes: int = PAGE_BYTES
) -> DataFrame:
    """Per query and page: ``status``, ``n_lines``, ``page`` and the reply ``text`` with all lines in file order."""
    found, compiled = grep(lines, queries, text)
    # Written once, so that the lines are searched once.
    found = materialize(found.select("pattern", position, text), "grep")
    bad = compiled.rejects_frame().select("pattern", F.lit(True).alias("_bad"))
    asks = queries.select(*dict.fromkeys([query_id, "pattern"])).join(bad, "pattern", "left")
    out = replies(found, asks, "pattern", position, F.col(text), page_bytes)
    status = (
        F.when(F.coalesce("_bad", F.col("pattern").isNull()), F.lit(BAD_REQUEST))
        .when(F.col("n_lines") == 0, F.lit(NO_CONTENT))
        .otherwise(F.lit(OK))
    )
    return out.select(query_id, "pattern", status.alias("status"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("page", F.lit(0)).alias("page"), "text")
