"""Personal data by weak supervision, with DataFrame functions only.

Four kinds of spans are found by their formats and always stay. Further candidates (long numbers and key-like
strings) get votes of regex, gazetteer and context labelers. Expectation-maximisation on the counts of vote patterns
estimates how reliable each labeler is, its posteriors train a logistic span classifier on the candidates'
features, and candidates that it takes are added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.storage import materialize

# The formats of the contract, written so that a run of characters is entered at its start, or where the match
# before ended, only: a later start in the run could not match either. Loops are possessive, which changes no match
# because nothing after a loop can begin inside it, and keeps the regex engine from recursing on long texts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Without this a text cannot hold the kind.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = (*BASE, "number", "secret")

CANDIDATES = {
    "number": r"(?<![0-9A-Za-z.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,17}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
# Gazetteers: words that announce such data, and words that announce harmless strings.
ANNOUNCING = "token|secret|password|passwd|api|apikey|key|auth|bearer|phone|tel|mobile|call|fax|ssn|account|iban|card|credential"
HARMLESS = "version|license|isbn|issn|doi|commit|http|https|www|page|section|released|copyright|figure"
BEFORE = 24  # characters before a candidate that are its context
TAKE = 0.9  # chance from which a candidate is taken

BLOCK = 128
SPAN = "struct<start:int,end:int,value:string>"


def _along(parts: Column) -> Column:
    """Ends of what was walked over and the placed values, for (gap, value) one after another from 0."""
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"),
                        x["value"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
    )


def with_places(docs: DataFrame, name: str, text: Column, pattern: str) -> DataFrame:
    """Column ``name``: all non-overlapping matches as (start, end, value), in code points with the end exclusive.

    Positions are summed within blocks of ``BLOCK`` matches and then over the blocks, so that many matches in one text
    stay cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    parts, blocks = f"_parts_{name}", f"_blocks_{name}"
    docs = docs.withColumn(parts, F.arrays_zip(gaps.alias("gap"), found.alias("value")))
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda k: _along(F.slice(parts, k * BLOCK + 1, BLOCK))
    )
    docs = docs.withColumn(blocks, F.when(F.size(parts) > 0, cut))
    shifted = lambda spans, by: F.transform(
        spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))
    )
    whole = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(shifted(b["out"], acc["at"]))).alias("out")),
    )
    spans = F.when(F.col(blocks).isNotNull(), F.flatten(whole["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))
    return docs.withColumn(name, spans).drop(parts, blocks)


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, k: Column) -> Column:
        d = F.substr(back, k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(f"found_{kind}", lambda s: _valid(kind, s["value"]))


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """One array column ``base_<kind>`` per kind; matches that fail their check are dropped."""
    for kind, pattern in BASE.items():
        here = F.when(F.instr(text, HINT[kind]) > 0, F.col(text)).otherwise(F.lit("")) if HINT[kind] else F.col(text)
        docs = with_places(docs, f"found_{kind}", here, pattern)
    return docs.select(
        *[c for c in docs.columns if not c.startswith("found_")],
        *[_checked(kind).alias(f"base_{kind}") for kind in BASE],
    )


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """``candidates``: array of (kind, start, end, value, before) that touch no base span."""
    base = F.flatten(F.array(*[F.transform(f"base_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in BASE]))
    docs = docs.withColumn("taken", base)
    for kind, pattern in CANDIDATES.items():
        docs = with_places(docs, f"more_{kind}", F.col(text), pattern)
    shape = lambda kind: F.transform(
        f"more_{kind}",
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.substr(text, F.greatest(F.lit(1), s["start"] + 1 - BEFORE), F.least(F.lit(BEFORE), s["start"])).alias("before"),
        ),
    )
    numbers = F.transform("more_number", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    free = lambda s, spans: ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    docs = docs.withColumn("numbers", numbers)
    both = F.concat(F.filter(shape("number"), lambda s: free(s, F.col("taken"))), F.filter(shape("secret"), lambda s: free(s, F.col("taken")) & free(s, F.col("numbers"))))
    return docs.withColumn("candidates", both).drop("taken", "numbers", *[f"more_{k}" for k in CANDIDATES])


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0)


def votes(c: Column) -> list[Column]:
    """1 for personal, -1 for harmless, 0 for no opinion, of each labeler on one candidate."""
    value, before = c["value"], F.lower(c["before"])
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return [
        _vote(value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | ((digits >= 4) & (letters >= 8)), digits == 0),  # regex: key format
        _vote(value.rlike(r"^\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}"), value.rlike("^[0-9]+$") & (F.length(value) < 16)),  # regex: number format
        _vote(before.rlike(f"(?:^|[^a-z])(?:{ANNOUNCING})[^a-z]"), F.lit(False)),  # gazetteer: announcing words
        _vote(F.lit(False), before.rlike(f"(?:^|[^a-z])(?:{HARMLESS})[^a-z]")),  # gazetteer: harmless words
        _vote(before.rlike("[=:] ?[\"']?$"), before.rlike("[a-z,.] $")),  # context: assigned, or in running text
        _vote(F.size(F.array_distinct(F.split(value, ""))) >= 10, F.size(F.array_distinct(F.split(value, ""))) <= 4),  # context: mixed characters
    ]


def features(c: Column) -> list[Column]:
    """What the span classifier looks at, each 0 or 1."""
    value = c["value"]
    digits = F.length(F.regexp_replace(value, "[^0-9]", "")) / F.length(value)
    return [
        c["kind"] == "secret",
        F.length(value) >= 32,
        digits.between(0.2, 0.8),
        digits > 0.8,
        value.rlike("[a-z]") & value.rlike("[A-Z]"),
        c["before"].rlike("[=:\"'(] ?$"),
        F.lower(c["before"]).rlike(f"(?:{ANNOUNCING})[^a-z]*$"),
        F.size(F.array_distinct(F.split(value, ""))) >= 12,
    ]


def _code(parts: list[Column], base: int, shift: int) -> Column:
    total = F.lit(0)
    for part in parts:
        total = total * base + (part.cast("int") + shift)
    return total


def _digits(code: int, base: int, n: int, shift: int) -> list[int]:
    out = []
    for _ in range(n):
        code, digit = divmod(code, base)
        out.append(digit - shift)
    return out[::-1]


@dataclass
class SpanModel:
    reliability: list[tuple[float, float]]  # of each labeler: chance that a vote is right, for personal and harmless
    prior: float
    weights: list[float]  # of the features, the last one for itself
    taken: float = TAKE


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[list[tuple[float, float]], float, dict[tuple[int, ...], float]]:
    """Expectation-maximisation on (votes, count): reliabilities, share of personal spans, posterior of each pattern."""
    if not patterns:
        return [], 0.5, {}
    n = len(patterns[0][0])
    right, prior = [(0.8, 0.8)] * n, 0.5
    after: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes_, _ in patterns:
            odds = math.log(prior / (1 - prior))
            for (plus, minus), v in zip(right, votes_, strict=True):
                if v > 0:
                    odds += math.log(plus / (1 - minus))
                elif v < 0:
                    odds += math.log((1 - plus) / minus)
            after[votes_] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(c for _, c in patterns)
        prior = min(0.95, max(0.05, (sum(c * after[v] for v, c in patterns) + 1) / (total + 2)))
        new = []
        for k in range(n):
            rates = []
            for wanted in (1, -1):
                weight = lambda v: after[v] if wanted > 0 else 1 - after[v]  # noqa: B023, E731
                voted = sum(c * weight(v) for v, c in patterns if v[k])
                agreed = sum(c * weight(v) for v, c in patterns if v[k] == wanted)
                rates.append(min(0.99, max(0.51, (agreed + 8) / (voted + 10))))
            new.append((rates[0], rates[1]))
        right = new
    return right, prior, after


def fit_classifier(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 400) -> list[float]:
    """Logistic weights on (features, count, mean posterior), by gradient steps on the counts."""
    if not cells:
        return []
    n = len(cells[0][0]) + 1
    weights, total = [0.0] * n, sum(c for _, c, _ in cells)
    for _ in range(rounds):
        slope = [0.002 * w for w in weights]
        for own, count, wanted in cells:
            x = (*own, 1)
            p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True))))
            for k in range(n):
                slope[k] += (p - wanted) * x[k] * count / total
        weights = [w - 1.5 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def train(candidates: DataFrame) -> SpanModel:
    """Fit on the ``candidates`` column of all documents; only counts of vote and feature patterns reach the driver.

    There are at most 3^6 x 2^8 of those, whatever the number of documents. Without candidates nothing is taken.
    """
    one = materialize(candidates.select(F.explode_outer("candidates").alias("c")).where("c IS NOT NULL").select("c.kind", "c.value", "c.before"), "candidates")
    one = one.select(F.struct("kind", "value", "before").alias("c"))
    coded = one.select(_code(votes(F.col("c")), 3, 1).alias("v"), _code(features(F.col("c")), 2, 0).alias("f"))
    rows = coded.groupBy("v", "f").count().collect()
    n_votes, n_features = 6, 8
    cells = [(tuple(_digits(r["v"], 3, n_votes, 1)), tuple(_digits(r["f"], 2, n_features, 0)), float(r["count"])) for r in rows]
    counted: dict[tuple[int, ...], float] = {}
    for v, _, c in cells:
        counted[v] = counted.get(v, 0.0) + c
    right, prior, after = estimate(sorted(counted.items()))
    return SpanModel(right, prior, fit_classifier([(f, c, after[v]) for v, f, c in sorted(cells)]))


def _chance(c: Column, model: SpanModel) -> Column:
    if not model.weights:
        return F.lit(0.0)
    total = F.lit(model.weights[-1])
    for weight, own in zip(model.weights, features(c), strict=False):
        total = total + F.when(own, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_email, base_ip, base_card, base_phone and ``spans``, all as arrays of (kind, start, end).

    Null texts are empty and have no spans; other columns and repeated rows are kept as they are, but columns named like
    the added ones are replaced. Spans of one kind do not
    overlap; ``spans`` are ordered by kind (email, ip, card, phone, number, secret), then start.
    """
    added = [*[f"base_{k}" for k in BASE], "spans"]
    kept = [c for c in docs.columns if c not in added]
    clean = "_clean_text"
    rows = docs.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias(clean))
    found = with_candidates(with_base_spans(rows, clean), clean)
    model = train(found)
    taken = F.filter("candidates", lambda c: _chance(c, model) >= model.taken)
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = [named(F.col(f"base_{k}"), k).alias(f"base_{k}") for k in BASE]
    more = F.transform("taken", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    placed = found.withColumn("taken", taken).select("_row", *base, more.alias("_more"))
    return placed.select("_row.*", *[f"base_{k}" for k in BASE], F.concat(*[F.col(f"base_{k}") for k in BASE], "_more").alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans go as the first of them.

    Null texts stay null; ``n_chars`` is set anew where there is such a column.
    """
    found = find_personal_data(docs.select(F.struct(*docs.columns).alias("_doc"), "text"))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.coalesce("text", F.lit(""))
    walk = F.aggregate(
        order,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    done = found.withColumn("walk", F.when(F.size("spans") > 0, walk))
    clean = F.when(F.col("walk").isNotNull(), F.concat(F.array_join(F.col("walk.out"), ""), F.substr(text, F.col("walk.at") + 1))).otherwise(F.col("text"))
    size = F.when(F.col("walk").isNotNull(), F.length(clean)).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": clean, "n_chars": size.cast(docs.schema["n_chars"].dataType) if size is not None else None}
    return done.select(*[(new[c] if c in new else F.col(f"_doc.{c}")).alias(c) for c in docs.columns])
