"""Secrets in all versions of a corpus, by an incremental ledger of blobs, with DataFrame functions only.

A text is addressed by its SHA-256, whatever paths and versions hold it. The ledger is a table in a shared folder
that says which rule versions have scanned which blob and what they found. An update scans only the pairs of blob and
rule version that no entry has, each blob once, and appends; findings are joined back to every path afterwards.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm.pii import with_places
from alertmill.storage import list_dir, path_exists

FINDING = "struct<kind:string,version:int,start:int,end:int>"
ENTRIES = f"blob string, done array<string>, findings array<{FINDING}>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, those whose last ``tail`` (or whole, without one) has ``least`` characters stay.

    ``hint`` is a condition on the text (``t``) and its lower-case form (``low``) that every text with a match meets. A rule
    that changes gets a new ``version``.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    least: int = 0
    tail: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The formats of the contract; loops are possessive, which changes no match because nothing after a loop can begin inside
# it. A run shorter than asked for is no match of access and hex: a later start in the run is shorter still.
BASE = (
    Rule(
        "assign", 1, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
        "contains(low, 'passw') OR contains(low, 'secret') OR contains(low, 'token') OR contains(low, 'api')",
        8, r"""^[A-Za-z_]++["']?+\x20*+[:=]\x20*+["']?+""",
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+", "contains(t, 'AKIA')"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+", "t RLIKE '[0-9a-f]{32}'"),
)
# Formats that hardly anything else has.
MORE = (
    Rule("pem", 1, r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", "contains(t, 'PRIVATE KEY')"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "contains(t, 'eyJ')"),
    Rule("hosted", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}+", "contains(t, 'gh')"),
)
RULES = (*BASE, *MORE)


class Ledger:
    """Entries under ``path``, one folder for each update; a folder counts once Spark has marked it as complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folders(self) -> list[str]:
        found = [f"{self.path}/{name}" for name in list_dir(self.spark, self.path)]
        return [f for f in found if path_exists(self.spark, f"{f}/_SUCCESS")]

    def is_empty(self) -> bool:
        return not self._folders()

    def entries(self) -> DataFrame:
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(*folders)

    def append(self, entries: DataFrame) -> None:
        entries.write.parquet(f"{self.path}/update-{uuid.uuid4().hex}")


def address(text: Column) -> Column:
    """The content address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``findings`` of the rules named in ``todo`` on the texts ``t``."""
    asked = blobs.withColumn("low", F.lower("t"))
    for k, rule in enumerate(rules):
        wanted = F.array_contains("todo", rule.name) & F.expr(rule.hint)
        asked = asked.withColumn(f"text_{k}", F.when(wanted, F.col("t")).otherwise(F.lit("")))
    found = asked.drop("t", "low")
    for k, rule in enumerate(rules):
        found = with_places(found, f"found_{k}", F.col(f"text_{k}"), rule.pattern).drop(f"text_{k}")

    def kept(k: int, rule: Rule) -> Column:
        value = lambda s: F.regexp_replace(s["value"], rule.tail, "") if rule.tail else s["value"]
        good = F.filter(f"found_{k}", lambda s: F.length(value(s)) >= rule.least) if rule.least else F.col(f"found_{k}")
        return F.transform(good, lambda s: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), s["start"].alias("start"), s["end"].alias("end")))

    return found.select("blob", F.col("todo").alias("done"), F.concat(*[kept(k, r) for k, r in enumerate(rules)]).cast(f"array<{FINDING}>").alias("findings"))


def unseen(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """(blob, t, todo): each content with a rule version that has not scanned it, once, with those rule versions.

    Equal contents are combined before they are shuffled, so a content that a third of all versions holds is no
    large group.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    texts = versions.select(address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if ledger.is_empty():
        return texts.groupBy("blob").agg(F.first("t").alias("t")).withColumn("todo", names)
    known = ledger.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"))
    known = known.withColumn("todo", F.array_except(names, "done")).select("blob", "todo")
    fresh = texts.join(known.where(F.size("todo") == 0), "blob", "left_anti")
    once = fresh.groupBy("blob").agg(F.first("t").alias("t"))
    return once.join(known, "blob", "left").select("blob", "t", F.coalesce("todo", names).alias("todo"))


def update(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan the unseen pairs of blob and rule version of ``versions`` and append them to the ledger.

    An update that is lost half-way leaves no entry and can be run again.
    """
    ledger.append(_scan(unseen(versions, ledger, rules, text_col), rules))


def findings(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``versions`` with ``blob`` and ``secrets``, an array of (kind, start, end) by start, then kind in the order of ``rules``.

    Every path and version of a content gets its findings. Null texts are empty and have none; other columns and
    repeated rows are kept, but columns named like the added ones are replaced. Positions are code points, the end is exclusive.
    Findings of one kind do not overlap.
    """
    kept = [c for c in versions.columns if c not in ("blob", "secrets")]
    rows = versions.select(F.struct(*kept).alias("_row"), address(F.col(text_col)).alias("blob"))
    of_rules = F.filter("findings", lambda f: F.concat_ws("@", f["kind"], f["version"].cast("string")).isin([r.name for r in rules]))
    found = ledger.entries().select("blob", of_rules.alias("findings")).where(F.size("findings") > 0)
    found = found.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    order = lambda f: F.array_position(F.array(*[F.lit(r.kind) for r in rules]), f["kind"])
    ranked = F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), order(f).alias("place"), f["end"].alias("end"), f["kind"].alias("kind"))))
    named = F.transform(ranked, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    joined = rows.join(found.select("blob", named.alias("secrets")), "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select("_row.*", "blob", F.coalesce("secrets", none).alias("secrets"))
