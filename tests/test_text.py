import datetime as dt
import html
import zlib

import pytest
from pyspark.sql import functions as F

from alertmill.functions import text as fx


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_subject_keeps_empty_tokens_and_dots(spark):
    rows = [("err", "daemon", "sw-1.lab"), (None, "daemon", None)]
    got = values(spark, rows, "s string, f string, h string", fx.subject("s", "f", "h"), fx.subject("s", "f", "h", "x"))
    assert got == [("slg.err.daemon.sw-1.lab", "x.err.daemon.sw-1.lab"), ("slg..daemon.", "x..daemon.")]


def test_message_text(spark):
    got = values(spark, [("t", "h", "m"), (None, None, None)], "t string, h string, m string", fx.message_text("t", "h", "m"))
    assert got == [("#syslog message at t\nh\nm",), ("#syslog message at \n\n",)]


def cut(text: str) -> str:
    out, raw = [], text.encode()[:4000]
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as exc:
            out.append(raw[: exc.start].decode() + "�")
            raw = raw[exc.start + 1 :]
    return "".join(out)


def test_html_alert_cuts_bytes_then_escapes(spark):
    texts = ["a<b>&'\"", "", None, "x" * 4000, "<" * 4001]
    texts += ["x" * n + "é" * 40 + "z" * 100 for n in (3999, 3998)]
    texts += ["x" * n + "€" * 40 for n in (3999, 3998, 3997)]
    texts += ["x" * n + "\U0001f600" * 40 for n in (3999, 3998, 3997, 3996)]
    got = [r[0] for r in values(spark, [(t,) for t in texts], "t string", fx.html_alert("t"))]
    for text, out in zip(texts, got):
        want = f"<pre>{html.escape(cut(text)).replace('&#x27;', '&#39;').replace('&quot;', '&#34;')}</pre>" if text else None
        assert out == want


def test_chat_id(spark):
    texts = ["12", "-1001", "0", "", None, "abc", " 5", "9223372036854775807", "9223372036854775808", "+7"]
    got = [r[0] for r in values(spark, [(t,) for t in texts], "t string", fx.chat_id("t"))]
    assert got == [12, -1001, None, None, None, None, None, 9223372036854775807, None, 7]


def test_ids_are_crc32(spark):
    texts = ["this is the pattern1", "", "é€"]
    got = values(spark, [(t, 17) for t in texts], "t string, s int", fx.pattern_id("t"), fx.batch_id("t", "s"))
    assert got == [(zlib.crc32(t.encode()), str(zlib.crc32(f"{t}.17".encode()))) for t in texts]
    drawn = spark.range(200).select(fx.batch_id(F.lit("x"), seed=1).alias("b")).distinct().collect()
    assert {r.b for r in drawn} <= {str(zlib.crc32(f"x.{n}".encode())) for n in range(1000)}


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("0", 0), ("5m", 300), ("1h30m", 5400), ("30m1h", 5400), ("1h1h", 7200), ("00h", 0), ("000000000000000001h", 3600),
        ("", None), ("90", None), ("00", None), ("h", None), ("5", None), ("1h5", None), ("2562047h", 2562047 * 3600),
        ("2562048h", None), ("99999999999999999999h", None), ("2562047h47m", 2562047 * 3600 + 47 * 60), ("2562047h48m", None),
    ],
)
def test_durations(spark, text, seconds):
    got = values(spark, [(text,)], "t string", fx.duration_seconds("t"), fx.duration_error("t"))
    assert got == [(seconds, None if seconds is not None else f"duration {text} is incorrect")]


def test_expiry(spark):
    at = dt.datetime(2024, 1, 1)
    got = values(spark, [(at, 90)], "t timestamp, s bigint", fx.expiry("t", "s"))
    assert got == [(at + dt.timedelta(seconds=90),)]


def test_zero_time_never_expires(spark):
    rows = [("0001-01-01T00:00:00Z",), ("2024-01-01T00:00:00Z",), ("2024-01-01T03:00:00+03:00",), ("soon",)]
    got = [r[0] for r in values(spark, rows, "t string", fx.expiry_time("t").cast("string"))]
    assert got == [None, "2024-01-01 00:00:00", "2024-01-01 00:00:00", None]


def test_command_arguments(spark):
    rows = [("hi /list ban add 1h30m .*flood.* x\nrest",), ("/list ban rm 123x",), ("/whois Vlan111 a",), ("/list ban add  p",)]
    got = values(spark, rows, "t string", *fx.add_args("t", "ban"), fx.rm_arg("t", "ban"), fx.whois_arg("t"))
    assert got == [
        ("1h30m", ".*flood.* x", "", ""), ("", "", "123", ""), ("", "", "", "Vlan111 a"), ("", "p", "", ""),
    ]


def test_list_item_id(spark):
    texts = ["0", "1", "4294967295", "4294967296", "", "x", "00012", None, "99999999999999999999"]
    got = [r[0] for r in values(spark, [(t,) for t in texts], "t string", fx.list_item_id("t"))]
    assert got == [None, 1, 4294967295, None, None, None, 12, None, None]


def test_probe_text(spark):
    got = values(spark, [(7,)], "n bigint", fx.probe_text("n"))
    assert got == [("7, One, Two, Freddy's Coming For You",)]
