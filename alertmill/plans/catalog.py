"""Queries over the given tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import text as fx
from alertmill.functions.subjects import subject_matches
from alertmill.operators import chat, delivery, documents, inventory, lists, outbox, similarity
from alertmill.operators.grep import grep, grep_outcomes
from alertmill.operators.history import item_history
from alertmill.operators.patterns import drop_matching, flag_matches, literal_patterns, compile_patterns, route_matches, route_to_handlers
from alertmill.operators.postings import PostingTable
from alertmill.plans import tables as tb
from alertmill.plans.chatbot import change_replies, list_replies, list_replies_then, list_state, whois_replies
from alertmill.plans.notify import notify_pipeline, received
from alertmill.sources import chat as chat_source
from alertmill.sources.devices import read_devices
from alertmill.sources.lines import read_lines
from alertmill.sources.snapshots import decode_snapshot, read_snapshot
from alertmill.sources.syslog import accepted, parse_syslog, rejected
from alertmill.storage import new_table_path
from alertmill.streaming.arrivals import first_arrivals_stream
from alertmill.streaming.delivery import undelivered_stream
from alertmill.streaming.pipeline import start_notify
from alertmill.streaming.refresh import RefreshedPatterns
from alertmill.streaming.ring import new_on_stream
from alertmill.streaming.updates import stream_messages

# Lists and parameters of the queries.
BAN = [(r'\\"k\\": 1[0-9]\}', None), ('"severity":"click"', "2024-02-01 00:00:00"), ('"severity":"view"', "2024-01-01 00:00:00")]
NOTIFY = ['"severity":"(error|purchase|signup|view)"', r'"host":"1[[:digit:]]*"']
AS_OF = "2024-01-15 00:00:00"
WORDS = [(1, r"(?i)\bthe\b"), (2, "[[:digit:]]{4}"), (3, r"(?:license|copyright)"), (4, r"\.$"), (5, r"^[A-Z][a-z]+ans\b")]
LOOPING = [
    (1, "(foo|bar)+"), (2, "(?:ab|c)*d"), (3, r"([0-9]+\.)+[0-9]+"), (4, r"(\w+\s)*error"), (5, "(?:[a-z]+-)*[a-z]+"), (6, r"^(\d+,)*\d+$"),
    (7, r"^([A-Z]?[a-z]+[ ,.]+)+the"), (8, r"(?s)^([^\n]+\n)*license"), (9, r"(?:the|re|an)+\b"), (10, r"^(\w+\s?|[.,;]\s*)*$"),
]
GREP = [(1, r"\b[A-Z][a-z]+ing\b"), (2, "(?i)thth"), (3, r"[0-9]{3}-[0-9]{4}"), (4, "no such line at all"), (5, "broken("), (6, "^$"), (7, "e")]
QUERIES_BY_ID = [
    (1, '{"brand":"Brand#2","type":"ECONOMY"}'),
    (2, '{"brand":"Brand#2","type":"SMALL","size":"7"}'),
    (3, '{"brand":"Brand#none"}'),
    (4, "{}"),
    (5, ""),
    (6, '{"*":"*","size":"11"}'),
    (7, '{"brand":3}'),
    (8, "not json"),
]
SEND_THRESHOLD = 8
NOTIFY_THRESHOLD = 16


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _ban(spark: SparkSession):
    items = spark.createDataFrame(BAN, "pattern string, expires string").select(
        "pattern", F.col("expires").cast("timestamp").alias("expired_at")
    )
    return compile_patterns(lists.active_items(items, _as_of()))


def _notify(spark: SparkSession):
    return literal_patterns(spark, [(None, p) for p in NOTIFY])


def _routes(spark: SparkSession):
    return literal_patterns(spark, [(f"r{n}", p) for n, p in WORDS])


# --- messages ------------------------------------------------------------------------------


def syslog_parse(spark, sf):
    parsed = accepted(parse_syslog(tb.messages(spark, sf)))
    return parsed.select("id", "host", "severity", "facility", F.col("timestamp").alias("sent"), "msg")


def syslog_rejects(spark, sf):
    return rejected(parse_syslog(tb.damaged_messages(spark, sf))).select("id", "payload", "reject_reason")


def subject_publish(spark, sf):
    return received(tb.messages(spark, sf)).select("id", "subject", "payload")


def subject_filter(spark, sf):
    msgs = received(tb.messages(spark, sf)).select("id", "subject")
    picks = ["slg.error.>", "slg.*.app.7", "slg.view.app.11"]
    hits = [F.when(subject_matches("subject", p), F.lit(p)) for p in picks]
    return msgs.select("id", "subject", F.explode(F.array_compact(F.array(*hits))).alias("subscription"))


def publish_folders(spark, sf):
    path = new_table_path(spark, "published")
    outbox.publish(received(tb.messages(spark, sf)).select("subject", "payload", "severity", "facility"), path)
    back = spark.read.schema("subject string, payload string, severity string, facility string").parquet(path)
    return back.select("subject", "payload", "severity", "facility")


def ban_filter(spark, sf):
    return drop_matching(tb.messages(spark, sf), "payload", _ban(spark)).select("id", "payload")


def list_exists(spark, sf):
    docs = tb.documents(spark, sf)
    return flag_matches(docs, "text", _routes(spark), "matched").select("doc_id", "matched")


def pattern_routes(spark, sf):
    docs = tb.documents(spark, sf)
    return route_matches(docs, "text", _routes(spark)).select("doc_id", "route", "pattern")


def _customer_patterns(spark, sf):
    """A list of a pattern for each customer, far beyond what goes into a plan."""
    key = F.col("c_custkey").cast("string")
    pattern = F.concat(F.lit('"host":"'), key, F.lit('","severity":"(error|view|cl[a-z]+)"'))
    return compile_patterns(tb.table(spark, sf, "customer").select(pattern.alias("pattern"), key.alias("route")), route="route", max_literals=100)


def pattern_index(spark, sf):
    routed = route_matches(tb.messages(spark, sf), "payload", _customer_patterns(spark, sf))
    return routed.select("id", "route")


def ban_index(spark, sf):
    return drop_matching(tb.messages(spark, sf), "payload", _customer_patterns(spark, sf)).select("id", "payload")


def pattern_loops(spark, sf):
    looping = literal_patterns(spark, [(f"r{n}", p) for n, p in LOOPING])
    return route_matches(tb.documents(spark, sf), "text", looping).select("doc_id", "route", "pattern")


def near_dup_send(spark, sf):
    msgs = tb.short_texts(spark, sf)
    profile = tb.table(spark, sf, "events")
    sent = similarity.suppress_near_duplicates(msgs, threshold=SEND_THRESHOLD, profile=profile)
    return sent.select("id", "payload")


def near_dup_by_user(spark, sf):
    msgs = tb.short_texts(spark, sf)
    sent = similarity.suppress_near_duplicates(
        msgs, threshold=SEND_THRESHOLD, keys=["user_id"], lifetime_s=86400, on_empty="send"
    )
    return sent.select("id", "payload")


def min_distance(spark, sf):
    ringed = similarity.with_ring(tb.short_texts(spark, sf), profile=tb.table(spark, sf, "events"))
    return ringed.select("id", similarity.min_distance("ring", "payload").cast("bigint").alias("distance"))


def notify_alerts(spark, sf):
    sent = notify_pipeline(tb.messages(spark, sf), _ban(spark), _notify(spark), threshold=NOTIFY_THRESHOLD)
    return sent.select("id", "subject", "alert_text")


def notify_fanout(spark, sf):
    sent = notify_pipeline(
        tb.messages(spark, sf), _ban(spark), _notify(spark), threshold=NOTIFY_THRESHOLD, fanout="pattern"
    )
    return sent.select("id", "matched_pattern")


def alert_render(spark, sf):
    msgs = received(tb.messages(spark, sf))
    to = F.when(F.col("host").cast("int") % 3 == 0, F.concat(F.lit("-100"), F.col("host"))).otherwise(
        F.when(F.col("host").cast("int") % 3 == 1, F.lit("0")).otherwise(F.concat(F.lit("@"), F.col("host")))
    )
    rows = outbox.alerts(msgs, to, fx.message_text("timestamp", "host", "msg"), keep=["id"])
    return rows.withColumn("chat_id", F.col("chat_id").cast("string"))


def alert_html(spark, sf):
    docs = tb.documents(spark, sf)
    return docs.select("doc_id", fx.html_alert("text").alias("html"))


def batch_salt(spark, sf):
    events = tb.table(spark, sf, "events")
    return events.select("event_id", fx.batch_id("props", F.col("event_id") % 1000).alias("batch_id"))


# --- lists ---------------------------------------------------------------------------------


def list_add_first_wins(spark, sf):
    kept = lists.first_adds(tb.list_adds(spark, sf), ["ts", "seq"])
    return kept.select("list_name", "id", "pattern", "seq")


def list_add_outcomes(spark, sf):
    return lists.add_outcomes(tb.list_adds(spark, sf), ["ts", "seq"]).select("seq", "id", "status")


def list_upload(spark, sf):
    fields = F.to_json(F.struct("pattern", documents.rfc3339(F.col("expired_at")).alias("expired_at")))
    spoiled = F.when(F.col("list_name") == "view", F.replace(fields, F.lit("}"), F.lit("]"))).otherwise(fields)
    posted = tb.list_adds(spark, sf).select("list_name", "ts", "seq", spoiled.alias("body"))
    done = lists.upload_outcomes(posted, ["ts", "seq"])
    return done.select("seq", "list_name", "pattern", F.col("id").cast("string").alias("id"), tb.ntz("expired_at").alias("expired_at"), "status")


def list_active(spark, sf):
    live = lists.active_items(tb.list_adds(spark, sf), _as_of())
    return live.select("seq", "list_name", "id", tb.ntz("expired_at").alias("expired_at"))


def _split_adds(spark, sf):
    adds = tb.list_adds(spark, sf)
    return lists.first_adds(adds.where("value < 20"), ["ts", "seq"]), adds.where("value >= 20")


def list_delete(spark, sf):
    items, deletes = _split_adds(spark, sf)
    deletes = deletes.select("list_name", F.when(F.col("seq") % 97 != 0, F.col("id")).otherwise(0).alias("id"), "ts", "seq")
    return lists.delete_outcomes(items, deletes, ["ts", "seq"]).select("seq", "id", "status")


def list_remaining(spark, sf):
    """Items of all adds but those that a delete names: high values, on every list but one."""
    adds = tb.list_adds(spark, sf)
    deletes = adds.where("value >= 60 and list_name <> 'view'")
    return lists.remove_items(lists.first_adds(adds, ["ts", "seq"]), deletes).select("list_name", "id", "pattern")


def list_state_fold(spark, sf):
    state = lists.fold_commands(tb.command_log(spark, sf))
    return state.select("list_name", "id", "pattern", tb.ntz("expired_at").alias("expired_at"))


def list_command_outcomes(spark, sf):
    return lists.command_outcomes(tb.command_log(spark, sf)).select("seq", "status")


def list_snapshot_json(spark, sf):
    items = lists.first_adds(tb.list_adds(spark, sf), ["ts", "seq"])
    return documents.list_json(items).select("list_name", "page", "body")


def list_snapshot_decode(spark, sf):
    items = lists.first_adds(tb.list_adds(spark, sf), ["ts", "seq"])
    back = decode_snapshot(documents.list_json(items))
    return back.select("list_name", "id", "pattern", tb.ntz("expired_at").alias("expired_at"))


def list_text(spark, sf):
    items = lists.first_adds(tb.list_adds(spark, sf), ["ts", "seq"])
    return documents.list_text(items).select("list_name", "page", "body")


def list_gc(spark, sf):
    return lists.list_sizes(tb.list_adds(spark, sf), _as_of()).select("list_name", "n_live", "n_items")


def list_gc_empty(spark, sf):
    adds = tb.list_adds(spark, sf).withColumn("list_name", F.concat_ws(":", "list_name", "pattern", F.date_format("ts", "yyyy-MM-dd")))
    return lists.empty_lists(adds, F.lit("2024-01-20 00:00:00").cast("timestamp"))


def list_patterns(spark, sf):
    return lists.patterns_of(tb.list_adds(spark, sf), "error")


def duration_parse(spark, sf):
    parts = tb.table(spark, sf, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = (
        F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit("h")))
        .when(F.col("p_type") == "ECONOMY", F.concat(key, F.lit("m"), size, F.lit("h")))
        .when(F.col("p_type") == "LARGE", size)
        .when(F.col("p_type") == "MEDIUM", F.concat(size, F.lit("h"), key))
        .otherwise(F.concat(F.lit("0"), size, F.lit("h"), key, F.lit("m1h")))
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = fx.duration_seconds("duration")
    return parts.select("p_partkey", text.alias("duration")).select(
        "p_partkey",
        "duration",
        seconds.cast("string").alias("seconds"),
        fx.expiry(start, seconds).cast("timestamp_ntz").alias("expired_at"),
        fx.duration_error("duration").alias("reply"),
    )


# --- chat ----------------------------------------------------------------------------------


def chat_updates(spark, sf):
    ups = chat_source.updates(chat_source.decode_envelopes(tb.chat_envelopes(spark, sf)))
    fresh = chat.fresh_messages(ups, F.lit(1_700_000_360))
    return fresh.select("update_id", F.col("from").alias("sender"), "text", tb.ntz("ts").alias("ts"))


def chat_next_offset(spark, sf):
    return chat.next_offset(chat_source.updates(chat_source.decode_envelopes(tb.chat_envelopes(spark, sf))))


def chat_commands(spark, sf):
    routed = chat.route_commands(tb.chat_texts(spark, sf), tb.LIST_NAMES)
    return routed.select("update_id", "list_name", "command")


def chat_adds(spark, sf):
    routed = chat.route_commands(tb.chat_texts(spark, sf), tb.LIST_NAMES)
    adds = chat.parse_adds(routed, tb.LIST_NAMES)
    return adds.select("update_id", "list_name", "pattern", tb.ntz("expired_at").alias("expired_at"), "reply")


def chat_list_state(spark, sf):
    state = list_state(tb.chat_texts(spark, sf), tb.LIST_NAMES)
    return state.select("list_name", "pattern", tb.ntz("expired_at").alias("expired_at"))


def chat_whois(spark, sf):
    routed = chat.route_commands(tb.chat_texts(spark, sf), tb.LIST_NAMES)
    return chat.parse_whois(routed).select("update_id", "pattern")


def chat_removes(spark, sf):
    routed = chat.route_commands(tb.event_commands(spark, sf), tb.LIST_NAMES)
    return chat.parse_removes(routed, tb.LIST_NAMES).select("update_id", "list_name", "id")


def chat_change_replies(spark, sf):
    said = change_replies(tb.event_commands(spark, sf), tb.LIST_NAMES)
    return said.select(F.col("from").alias("sender"), "text")


def chat_list_replies(spark, sf):
    routed = chat.route_commands(tb.event_commands(spark, sf), tb.LIST_NAMES)
    said = list_replies_then(routed, tb.LIST_NAMES)
    return said.select(F.col("from").alias("sender"), "text")


def chat_list_replies_last(spark, sf):
    texts = tb.event_commands(spark, sf)
    routed = chat.route_commands(texts, tb.LIST_NAMES)
    said = list_replies(routed, list_state(texts, tb.LIST_NAMES), _as_of())
    return said.select(F.col("from").alias("sender"), "text")


def list_history(spark, sf):
    past = item_history(tb.command_log(spark, sf))
    times = [tb.ntz(f"{n}_at").alias(f"{n}_at") for n in ("from", "to", "expired")]
    past = past.withColumns({"from_at": F.timestamp_micros("from_us"), "to_at": F.timestamp_micros("to_us")})
    return past.select("list_name", "id", "pattern", "from_seq", "to_seq", *times)


def chat_whois_replies(spark, sf):
    routed = chat.route_commands(tb.event_commands(spark, sf), tb.LIST_NAMES)
    lines = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("line_no"), F.col("c_name").alias("value"))
    return whois_replies(routed, lines, "line_no").select(F.col("from").alias("sender"), "text")


# --- inventory and lines -------------------------------------------------------------------


def device_search(spark, sf):
    found = inventory.search(tb.devices(spark, sf), {"brand": "Brand#2", "type": "ECONOMY"})
    return found.select("id", "name", "ip")


def _device_queries(spark):
    return spark.createDataFrame(QUERIES_BY_ID, "query_id bigint, body string")


def device_search_batch(spark, sf):
    queries = _device_queries(spark).select("query_id", inventory.parse_query("body").alias("q"))
    found = inventory.search_batch(tb.devices(spark, sf), queries)
    return found.select("query_id", "id", "name", "ip")


def device_search_status(spark, sf):
    queries = _device_queries(spark).select("query_id", inventory.parse_query("body").alias("q"))
    return inventory.search_status(tb.devices(spark, sf), queries)


def device_search_json(spark, sf):
    answers = inventory.search_documents(tb.devices(spark, sf), _device_queries(spark))
    return answers.withColumn("page", F.col("page").cast("string"))


def device_by_brand(spark, sf):
    """A table of queries as long as the inventory: every device asks for its own kind."""
    devices = tb.devices(spark, sf)
    queries = devices.select(
        F.col("id").alias("query_id"), F.map_filter("attributes", lambda k, v: k != "size").alias("q")
    )
    return inventory.search_status(devices, queries)


def attribute_index(spark, sf):
    index = inventory.attribute_index(tb.devices(spark, sf), span_bits=10)
    return index.select(
        "attr", "value", "span", "count", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")
    )


def device_index_search(spark, sf):
    """Search on a posting table after every tenth device has become an ECONOMY one."""
    devices = tb.devices(spark, sf)
    index = PostingTable(spark, new_table_path(spark, "postings"), span_bits=10)
    index.build(devices)
    old = devices.where("id % 10 = 0")
    index.change(old, old.withColumn("attributes", F.map_concat(F.map_filter("attributes", lambda k, _: k != "type"), F.create_map(F.lit("type"), F.lit("ECONOMY")))))
    return index.search({"brand": "Brand#2", "type": "ECONOMY"})


def attribute_counts(spark, sf):
    return inventory.attribute_counts(tb.devices(spark, sf)).select("attr", "value", "count")


def device_file_load(spark, sf):
    path = new_table_path(spark, "devices")
    tb.devices(spark, sf).select("name", "ip", "attributes").write.json(path)
    back = read_devices(spark, path, json_lines=True)
    return back.select("name", "ip", F.col("attributes")["brand"].alias("brand"), F.col("attributes")["size"].alias("size"))


def device_array_load(spark, sf):
    """Array files of 500 devices each, and the ids their order gives."""
    path = new_table_path(spark, "device-arrays")
    one = F.struct("id", F.to_json(F.struct("name", "ip", "attributes")).alias("json"))
    arrays = tb.devices(spark, sf).groupBy(F.expr("id div 500").alias("g")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    body = F.concat(F.lit("["), F.array_join("all.json", ", "), F.lit("]"))
    arrays.select("g", body.alias("value")).write.partitionBy("g").text(path)
    return read_devices(spark, path, number=True).select("id", "name", "ip", F.col("attributes")["type"].alias("type"))


def list_snapshot_read(spark, sf):
    path = new_table_path(spark, "snapshot")
    items = lists.first_adds(tb.list_adds(spark, sf).where("list_name = 'error'"), ["ts", "seq"])
    documents.list_json(items).select("body").write.text(path)
    return read_snapshot(spark, path, "error").select("list_name", "id", "pattern", tb.ntz("expired_at").alias("expired_at"))


def route_handlers(spark, sf):
    handlers = {
        "r2": lambda found: found.select("doc_id", F.length("text").cast("bigint").alias("value")),
        "r3": lambda found: found.groupBy(F.lit(-1).cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("value")),
    }
    return route_to_handlers(tb.documents(spark, sf), "text", _routes(spark), handlers)


def line_file_load(spark, sf):
    path = new_table_path(spark, "lines")
    tb.document_lines(spark, sf).orderBy("line_no").select("value").write.text(path)
    return read_lines(spark, path).select("line_no", "value")


def whois_lines(spark, sf):
    queries = spark.createDataFrame(GREP, "query_id bigint, pattern string")
    found, _ = grep(tb.document_lines(spark, sf), queries)
    return found.select("pattern", "line_no", "value")


def whois_grep(spark, sf):
    queries = spark.createDataFrame(GREP, "query_id bigint, pattern string")
    return grep_outcomes(tb.document_lines(spark, sf), queries, "line_no")


# --- delivery ------------------------------------------------------------------------------


def _arrivals(spark, sf):
    """Every event is a message; those of type view carry the probe of the event before them."""
    events = tb.table(spark, sf, "events")
    text = F.when(F.col("event_type") == "view", fx.probe_text(F.col("event_id") - 1)).otherwise(F.col("props"))
    payload = F.to_json(F.struct(F.col("user_id").cast("string").alias("host"), text.alias("msg")))
    return events.select(F.col("ts").cast("timestamp").alias("arrived_at"), payload.alias("payload"))


def heartbeat_check(spark, sf):
    lost = delivery.undelivered(tb.probes(spark, sf), _arrivals(spark, sf), within_s=300)
    return lost.select("nonce", tb.ntz("sent_at").alias("sent_at"))


def first_arrival(spark, sf):
    orders = tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderkey").alias("subject"),
        F.col("o_orderdate").cast("timestamp").alias("asked_at"),
        F.lit(180 * 86400).alias("timeout_s"),
    )
    items = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("subject"),
        F.col("l_shipdate").cast("timestamp").alias("arrived_at"),
        F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("payload"),
    )
    return delivery.first_arrivals(orders, items).select("request_id", "response", "error")


def first_arrival_hot(spark, sf):
    """Few subjects, each with a large share of the messages."""
    events = tb.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asks = events.where("event_type = 'error'").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 3).alias("subject"), F.col("ts").alias("asked_at"),
        F.lit(120).alias("timeout_s"),
    )
    sent = events.where("event_type <> 'error'").select(
        (F.col("user_id") % 3).alias("subject"), F.col("ts").alias("arrived_at"), F.col("props").alias("payload")
    )
    return delivery.first_arrivals(asks, sent).select("request_id", "response", "error")


# --- streams -------------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = tb.prepare(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run_to_end(frame: DataFrame, name: str) -> DataFrame:
    spark = frame.sparkSession
    path = new_table_path(spark, name)
    writer = frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log")
    writer.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/out")


def near_dup_stream(spark, sf):
    rows = _event_stream(spark, sf).select(
        "user_id", "ts", F.col("event_id").alias("id"),
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props").alias("payload"),
    )
    sent = new_on_stream(rows, "user_id", threshold=SEND_THRESHOLD, lifetime_s=86400, on_empty="send")
    return _run_to_end(sent.select("id", F.col("text").alias("payload")), "near-dup")


def notify_stream(spark, sf):
    payload = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("host"),
            F.col("event_type").alias("severity"),
            F.lit("app").alias("facility"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
            F.col("props").alias("msg"),
        )
    )
    rows = _event_stream(spark, sf).select(F.col("event_id").alias("id"), "ts", payload.alias("payload"))
    path = new_table_path(spark, "notify")
    ban = spark.createDataFrame(BAN, "pattern string, expires string").select(
        "pattern", F.col("expires").cast("timestamp").alias("expired_at")
    )
    notify = spark.createDataFrame([(p,) for p in NOTIFY], "pattern string")
    query = start_notify(
        rows,
        f"{path}/log",
        available_now=True,
        ban=RefreshedPatterns(lambda s: lists.active_items(ban, _as_of())),
        notify=RefreshedPatterns(lambda s: notify, keep_when_empty=True),
        to="-100",
        outbox=f"{path}/outbox",
        ring_path=f"{path}/ring",
        threshold=NOTIFY_THRESHOLD,
    )
    query.awaitTermination()
    return outbox.read_outbox(spark, f"{path}/outbox").select("id", "chat_id", "parse_mode", "text")


def heartbeat_stream(spark, sf):
    events = _event_stream(spark, sf)
    sent = events.where("event_type = 'error'").select(F.col("event_id").alias("nonce"), F.col("ts").alias("sent_at"))
    text = fx.probe_text(F.col("event_id") - 1)
    arrived = _event_stream(spark, sf).where("event_type = 'view'").select(F.col("ts").alias("arrived_at"), text.alias("payload"))
    lost = undelivered_stream(sent, arrived, within_s=300)
    done = _run_to_end(lost.select(F.col("nonce").cast("bigint").alias("nonce"), "sent_at", "text"), "heartbeat")
    return done.select("nonce", tb.ntz("sent_at").alias("sent_at"), "text")


def first_arrival_stream(spark, sf):
    """The events written as a stream, and a late one after them that lets the last timeouts pass."""
    path = new_table_path(spark, "arrivals")
    events = tb.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "props")
    events.write.parquet(f"{path}/in")
    rows = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    asks = rows.where("event_type = 'error'").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("subject"), F.col("ts").alias("asked_at"), F.lit(7200).alias("timeout_s")
    )
    sent = rows.where("event_type <> 'error'").select(F.col("user_id").alias("subject"), F.col("ts").alias("arrived_at"), F.col("props").alias("payload"))
    found = first_arrivals_stream(asks, sent)
    writer = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True)
    writer.start().awaitTermination()
    closing = events.agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("close").alias("event_type"),
        (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(None).cast("string").alias("props"),
    )
    closing.write.mode("append").parquet(f"{path}/in")
    writer.start().awaitTermination()  # goes on from the state of the first run
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def chat_stream(spark, sf):
    path = new_table_path(spark, "updates")
    tb.chat_envelopes(spark, sf).select("body").write.text(path)
    fresh = stream_messages(spark, path, F.lit(1_700_000_360))
    done = _run_to_end(fresh.withColumnRenamed("from", "sender"), "chat")
    return done.select("update_id", "sender", "text", tb.ntz("ts").alias("ts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        syslog_parse, syslog_rejects, subject_publish, subject_filter, publish_folders, ban_filter, list_exists,
        pattern_routes, pattern_index, ban_index, pattern_loops, near_dup_send, near_dup_by_user, min_distance, notify_alerts, notify_fanout, alert_render,
        alert_html, batch_salt, list_add_first_wins, list_add_outcomes, list_upload, list_active, list_delete,
        list_remaining, list_state_fold, list_command_outcomes, list_snapshot_json, list_snapshot_decode, list_text,
        list_gc, list_gc_empty, list_patterns, duration_parse, chat_updates, chat_next_offset, chat_commands,
        chat_adds, chat_list_state, chat_whois, chat_removes, chat_change_replies, chat_list_replies, chat_list_replies_last, list_history, chat_whois_replies, device_search, device_search_batch, device_search_status,
        device_search_json, device_by_brand, attribute_index, device_index_search, attribute_counts, device_file_load, device_array_load, list_snapshot_read, route_handlers, line_file_load,
        whois_lines, whois_grep, heartbeat_check, first_arrival, first_arrival_hot, near_dup_stream, notify_stream,
        heartbeat_stream, first_arrival_stream, chat_stream,
    )
}
