"""Explicit schemas of every external record."""

from pyspark.sql import types as T

SYSLOG_FIELDS = ("host", "severity", "facility", "timestamp", "msg")

SYSLOG = T.StructType([T.StructField(name, T.StringType()) for name in SYSLOG_FIELDS])

LIST_ITEM = T.StructType(
    [
        T.StructField("list_name", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("expired_at", T.TimestampType()),
    ]
)

_CHAT = T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType())])

CHAT_MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.IntegerType()),
        T.StructField("date", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("chat", _CHAT),
    ]
)

CHAT_UPDATE = T.StructType(
    [
        T.StructField("update_id", T.LongType()),
        T.StructField("channel_post", CHAT_MESSAGE),
        T.StructField("message", CHAT_MESSAGE),
    ]
)

CHAT_ENVELOPE = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("result", T.ArrayType(CHAT_UPDATE)),
    ]
)

DEVICE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)

SNAPSHOT = "map<string,struct<pattern:string,expired_at:string>>"
