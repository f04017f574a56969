"""Conjunctive attribute search over a device inventory."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.storage import materialize

# Fixed values.
ALL = "*"
OK, NO_RESULT, BAD_REQUEST = "ok", "no_result", "bad_request"
# Device ids covered by one posting row.
POSTING_SPAN_BITS = 16


def parse_query(body: Column | str) -> Column:
    """A query body as a map; empty means all devices, null is a bad request."""
    col = F.col(body) if isinstance(body, str) else body
    doc = F.try_parse_json(col)
    kind = F.schema_of_variant(doc)
    entries = F.map_entries(F.from_json(col, "map<string,string>"))
    strings = F.try_variant_get(doc, "$", "map<string,variant>")
    typed = F.forall(F.map_values(strings), lambda v: F.schema_of_variant(v).isin("STRING", "VOID"))
    # A null value is the empty text.
    filled = F.map_from_entries(
        F.transform(
            entries,
            lambda e: F.struct(e.getField("key").alias("key"), F.coalesce(e.getField("value"), F.lit("")).alias("value")),
        )
    )
    empty_map = F.from_json(F.lit("{}"), "map<string,string>")
    return (
        F.when(F.coalesce(F.octet_length(col), F.lit(0)) == 0, F.create_map(F.lit(ALL), F.lit(ALL)))
        .when(kind == "VOID", empty_map)
        .when(kind.startswith("OBJECT<") & typed, filled)
    )


def has_attributes(query: dict[str, str], attributes: str = "attributes") -> Column:
    """Condition of one query: all pairs present. ``*:*`` holds for every device."""
    pairs = [
        F.coalesce(F.col(attributes).getItem(k) == v, F.lit(False)) for k, v in query.items() if (k, v) != (ALL, ALL)
    ]
    return reduce(and_, pairs) if pairs else F.lit(bool(query))


def search(devices: DataFrame, query: dict[str, str]) -> DataFrame:
    """Devices that have every attribute of the query; ``{}`` finds nothing."""
    return devices.where(has_attributes(query))


def _pairs(attributes: str = "attributes") -> Column:
    return F.explode(attributes).alias("attr", "value")


def query_plans(devices: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, q, status, attr, value``: the rarest pair of each query that can match.

    A query without pairs, or with a pair no device has, is ``no_result``; a
    null query is ``bad_request``.
    """
    asked = queries.select("query_id", F.explode("q").alias("attr", "value"))
    wanted = asked.select("attr", "value").distinct()
    counts = devices.select(_pairs()).join(wanted, ["attr", "value"], "left_semi").groupBy("attr", "value").count()
    every = devices.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(ALL).alias("attr"), F.lit(ALL).alias("value"), "count"
    )
    star = (F.col("attr") == ALL) & (F.col("value") == ALL)
    counts = counts.where(~star).unionByName(every)
    rarest = (
        asked.join(counts, ["attr", "value"], "left")
        .withColumn("count", F.when((F.col("attr") == ALL) & (F.col("value") == ALL), F.coalesce("count", F.lit(0))).otherwise(F.col("count")))
        .groupBy("query_id")
        .agg(
            F.min_by(F.struct("attr", "value"), F.struct("count", "attr", "value")).alias("_rarest"),
            F.bool_or(F.col("count").isNull()).alias("_unknown"),
        )
    )
    status = (
        F.when(F.col("q").isNull(), F.lit(BAD_REQUEST))
        .when((F.size("q") == 0) | F.col("_unknown"), F.lit(NO_RESULT))
        .otherwise(F.lit(OK))
    )
    return queries.join(rarest, "query_id", "left").select(
        "query_id", "q", status.alias("status"), "_rarest.attr", "_rarest.value"
    )


def search_batch(devices: DataFrame, queries: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """``query_id`` and the device columns for every match of a table of queries (query_id, q).

    Devices meet a query on its rarest pair only and the other pairs are
    checked on the spot, so nothing larger than the shortest posting list is
    joined.
    """
    plans = materialize(query_plans(devices, queries), "plans") if plans is None else plans
    ready = plans.where(F.col("status") == OK).select("query_id", "q", "attr", "value")
    star = (F.col("attr") == ALL) & (F.col("value") == ALL)
    columns = devices.columns
    holds = F.forall(
        F.map_entries("q"),
        lambda e: ((e.getField("key") == ALL) & (e.getField("value") == ALL))
        | F.coalesce(F.try_element_at("attributes", e.getField("key")) == e.getField("value"), F.lit(False)),
    )
    by_pair = devices.select("*", _pairs()).join(ready.where(~star), ["attr", "value"]).where(holds)
    # Queries for all devices: the answer itself is every device per query. Salts spread it.
    salts = int(devices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in devices.schema.fields if f.dataType.typeName() != "map"]
    salted = devices.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
    all_queries = ready.where(star).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    everything = salted.join(all_queries, "_salt")
    out = ["query_id", *columns]
    return by_pair.select(*out).unionByName(everything.select(*out))


def _query_text(q: Column) -> Column:
    return F.to_json(F.array_sort(F.map_entries(q)))


def search_status(devices: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, status, n_found``; an ``ok`` query may have found nothing.

    Identical queries are looked up once.
    """
    asked = queries.select("query_id", "q", _query_text(F.col("q")).alias("_text"))
    distinct = asked.groupBy("_text").agg(F.any_value("q").alias("q")).select(F.col("_text").alias("query_id"), "q")
    plans = materialize(query_plans(devices, distinct.where("query_id is not null")), "plans")
    found = search_batch(devices, distinct, plans).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"))
    answers = plans.select("query_id", "status").join(found, "query_id", "left").withColumnRenamed("query_id", "_text")
    return asked.join(answers, "_text", "left").select(
        "query_id", F.coalesce("status", F.lit(BAD_REQUEST)).alias("status"), F.coalesce("n_found", F.lit(0)).alias("n_found")
    )


def attribute_counts(devices: DataFrame) -> DataFrame:
    """Devices per attribute value, with the ``*`` row for all."""
    every = devices.agg(F.count(F.lit(1)).alias("count")).select(F.lit(ALL).alias("attr"), F.lit(ALL).alias("value"), "count")
    star = (F.col("attr") == ALL) & (F.col("value") == ALL)
    return devices.select(_pairs()).where(~star).groupBy("attr", "value").count().unionByName(every)


def attribute_index(devices: DataFrame, id_col: str = "id", span_bits: int = POSTING_SPAN_BITS) -> DataFrame:
    """Posting lists ``attr, value, span, count, ids``, one row per range of ids.

    Ranges keep the list of a value that most devices share out of one row.
    """
    star = (F.col("attr") == ALL) & (F.col("value") == ALL)
    postings = devices.select(F.col(id_col).alias("id"), _pairs()).where(~star)
    every = devices.select(F.col(id_col).alias("id"), F.lit(ALL).alias("attr"), F.lit(ALL).alias("value"))
    return (
        postings.unionByName(every)
        .groupBy("attr", "value", F.shiftright("id", span_bits).alias("span"))
        .agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("id")).alias("ids"))
    )


def search_documents(devices: DataFrame, requests: DataFrame, body: str = "body") -> DataFrame:
    """Answer request bodies (query_id, body): ``query_id, status, page, body``.

    ``body`` of the answer is the JSON list of name and ip, null unless ok.
    """
    from alertmill.operators.documents import device_json

    queries = requests.select("query_id", parse_query(body).alias("q"))
    # Written once: each is used more than once below.
    plans = materialize(query_plans(devices, queries), "plans")
    found = materialize(search_batch(devices, queries, plans).select("query_id", "id", "name", "ip"), "found")
    answers = device_json(found, "query_id", names=plans.where(F.col("status") == OK))
    return plans.select("query_id", "status").join(answers, "query_id", "left")
