import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertmill.functions.literals import SKETCH_BITS, WIDTHS, Wanted, chosen_grams, required_literals, sketch_blocks, text_grams
from alertmill.functions.regex import to_java
from alertmill.operators.patterns import (
    PatternSet,
    compile_patterns,
    drop_matching,
    flag_matches,
    keep_matching,
    literal_patterns,
    require_patterns,
    route_matches,
    route_to_handlers,
)

TEXTS = [(1, "test-11"), (2, "tent"), (3, ""), (4, None), (5, "foo\n"), (6, "a flood of text")]
PATTERNS = [("r1", "t.st"), ("r2", "te[sS]t"), ("r3", "foo$"), ("r4", "["), ("r5", "flood"), ("r6", "tex?t"), ("r7", "^$")]
WANT = {(1, "t.st"), (1, "te[sS]t"), (6, "flood"), (6, "tex?t"), (3, "^$"), (4, "^$")}


@pytest.fixture(params=["literals", "parts"])
def patterns(request, spark):
    df = spark.createDataFrame(PATTERNS, "route string, pattern string")
    if request.param == "literals":
        return compile_patterns(df, route="route")
    compiled = compile_patterns(df, route="route", max_literals=3, part_rows=2)
    assert compiled.n_parts > 1
    return compiled


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string")


def test_all_join_kinds(texts, patterns):
    hit = {i for i, _ in WANT}
    assert {(r.id, r.pattern) for r in route_matches(texts, "text", patterns).collect()} == WANT
    assert {r.id: r.matched for r in flag_matches(texts, "text", patterns).collect()} == {i: i in hit for i, _ in TEXTS}
    assert {r.id for r in keep_matching(texts, "text", patterns).collect()} == hit
    assert {r.id for r in drop_matching(texts, "text", patterns).collect()} == {i for i, _ in TEXTS} - hit


def test_a_long_pattern_is_a_part_of_its_own(spark, texts):
    long = "|".join(["zz."] * 2000 + ["flood"])  # without a gram
    df = spark.createDataFrame([("t.st",), (long,), ("xx",)], "pattern string")
    compiled = compile_patterns(df, max_literals=1, part_rows=100)
    assert compiled.n_parts >= 2
    assert {(r.id, r.pattern) for r in route_matches(texts, "text", compiled).collect()} == {(1, "t.st"), (6, long)}


def test_bad_patterns_are_set_aside(patterns):
    rows = patterns.rejects_frame().collect()
    assert [(r.route, r.pattern) for r in rows] == [("r4", "[")]
    assert rows[0].reason


def test_a_pattern_twice_keeps_one_route(spark, texts):
    df = spark.createDataFrame([("a", "test"), ("b", "test")], "route string, pattern string")
    routed = route_matches(texts, "text", compile_patterns(df, route="route")).collect()
    assert [(r.id, r.route) for r in routed] == [(1, "b")]
    routed = route_matches(texts, "text", literal_patterns(spark, [("b", "test"), ("a", "test")])).collect()
    assert [(r.id, r.route) for r in routed] == [(1, "a")]


def test_empty_list(spark, texts):
    empty = PatternSet(spark)
    assert drop_matching(texts, "text", empty).count() == len(TEXTS)
    assert keep_matching(texts, "text", empty).count() == 0
    assert route_matches(texts, "text", empty).count() == 0
    with pytest.raises(ValueError):
        require_patterns(empty)


def test_long_list_of_literals(spark, texts):
    many = literal_patterns(spark, [(None, f"nothing{i}") for i in range(900)] + [(None, "flood")])
    assert [r.id for r in keep_matching(texts, "text", many).collect()] == [6]
    assert route_matches(texts, "text", many).count() == 1


def test_handlers_get_their_route(texts, patterns):
    out = route_to_handlers(
        texts, "text", patterns,
        {"r1": lambda d: d.select("id", F.lit("one").alias("by")), "r5": lambda d: d.select("id", F.lit("two").alias("by"))},
    )
    assert {(r.id, r.by) for r in out.collect()} == {(1, "one"), (6, "two")}


def test_literal_lists_need_no_join(texts, spark):
    plan = drop_matching(texts, "text", literal_patterns(spark, [(None, "x")]))._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_last_registered_route_stays(spark):
    rows = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("c", "y", 3)], "route string, pattern string, at int")
    for limit in (1000, 1):
        found = compile_patterns(rows, route="route", order="at", max_literals=limit)
        texts = spark.createDataFrame([("x",), ("y",)], "t string")
        assert sorted(r.route for r in route_matches(texts, "t", found).collect()) == ["a", "c"]


def test_unknown_property_is_set_aside_in_long_lists(spark):
    rows = spark.createDataFrame([(r"\p{Nonsense}",), ("abc",), (r"\p{Greek}",)], "pattern string")
    found = compile_patterns(rows, max_literals=1)
    assert [r.pattern for r in found.rejects_frame().collect()] == [r"\p{Nonsense}"]
    texts = spark.createDataFrame([("abc",), ("α",), ("x",)], "t string")
    assert [r.t for r in drop_matching(texts, "t", found).collect()] == ["x"]


def many_patterns(n):
    words = [f"word{k:05d}x" for k in range(n - 6)]
    rest = [r"(?i)Kernel (panic|oops)", r"^\d{4}$", "é|ß", "(ab|c)+dd", "a.c.e", r"(?:warn|error) +code [0-9]{3}"]
    return [f"{w}$" if k % 3 else f"(?i){w.upper()}|zz{w}" for k, w in enumerate(words)] + rest


def many_texts():
    texts = ["word00003x", "WORD00003X and zzword00006x", "a word00004x", "a word00004x!", "kernel PANIC", "2024", "x ß", "abcddd", "abcde", "an error  code 404", "", None, "wor", "日本 word00007x"]
    return list(enumerate(texts + [f"row {k} WORD{k * 37 % 20000:05d}X" for k in range(200)]))


@pytest.mark.parametrize("n", [1500, 20_000])
def test_long_list_by_grams_equals_every_pattern(spark, n):
    patterns, texts = many_patterns(n), many_texts()
    found = compile_patterns(spark.createDataFrame([(p, f"r{k}") for k, p in enumerate(patterns)], "pattern string, route string"), route="route")
    assert found.wanted is not None and found.n_parts >= 1 and found.rejects_frame().count() == 0
    df = spark.createDataFrame(texts, "id int, t string").withColumn("part", F.lit(1)).repartition(3)
    got = {(r.id, r.pattern) for r in route_matches(df, "t", found).collect()}
    matchers = [(p, re.compile(p, re.ASCII)) for p in patterns]
    want = {(i, p) for i, t in texts for p, m in matchers if m.search(t or "")}
    assert got == want and len(route_matches(df, "t", found).columns) == 5
    hit = {i for i, _ in want}
    assert {r.id for r in keep_matching(df, "t", found).collect()} == hit
    assert {r.id for r in drop_matching(df, "t", found).collect()} == {i for i, _ in texts} - hit
    assert flag_matches(df, "t", found).columns == ["id", "t", "part", "matched"]


def test_patterns_with_grams_need_no_nested_loop(spark):
    rows = spark.createDataFrame([(f"literal{k}",) for k in range(1200)], "pattern string")
    found = compile_patterns(rows)
    df = spark.createDataFrame([("a literal7 b",)], "t string")
    assert found.n_parts == 0
    for out in (route_matches(df, "t", found), drop_matching(df, "t", found), flag_matches(df, "t", found)):
        plan = out._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("ArrowEvalPython") >= 1
    assert [r.pattern for r in route_matches(df, "t", found).collect()] == ["literal7"]


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("error: (disk|network) failed", {"error: disk failed", "error: network failed"}), ("(?i)User-Agent: curl", {"er-agent: curl"}), (r"\bthe\b", None),
        ("foo|barbaz", None), ("(abcd|efgh)+x?", {"abcd", "efgh"}), ("été", {"été"}), ("(?i)été", None), ("ab?cdef", {"acdef", "abcdef"}), ("(longer)?word", {"word", "longerword"}),
        ("(?:a|b)(?:longest|shorter)", {"alongest", "blongest", "ashorter", "bshorter"}), ("x*", None), ("", None), ("[^a]bcdef", {"bcdef"}),
    ],
)
def test_required_literals(pattern, literals):
    found = required_literals(to_java(pattern))
    assert found == (None if literals is None else {x.encode() for x in literals})


def test_every_match_holds_a_required_literal():
    rnd = random.Random(3)
    for _ in range(400):
        pattern = "".join(rnd.choice(["abcd", "(ab|cd)", "(abc|dabc)+", "[ab]", "c?", "(?:bcd)*", "(?:dd|c){2}", ".", "d+"]) for _ in range(rnd.randrange(1, 6)))
        literals = required_literals(to_java(pattern))
        if literals is None:
            continue
        for _ in range(200):
            text = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(4, 24)))
            if re.search(pattern, text):
                assert any(x.decode() in text for x in literals), (pattern, text)


def test_grams_tell_the_patterns_of_a_list_apart(spark):
    n = 3000
    rows = spark.createDataFrame([(f'"host":"{k}","severity":"(error|view)"',) for k in range(n)], "pattern string")
    found = compile_patterns(rows, max_literals=100)
    # what all patterns share ('"host":"', '","severity":"') must not stand for any of them
    assert found.by_gram().groupBy("_gram").count().agg(F.max("count")).first()[0] <= 3
    df = spark.createDataFrame([(k, f'{{"host":"{k}","severity":"{s}"}}') for k in range(0, n, 7) for s in ("error", "click")], "id int, t string")
    assert sorted(r.id for r in route_matches(df, "t", found).collect()) == list(range(0, n, 7))
    assert drop_matching(df, "t", found).count() == len(range(0, n, 7))


def test_grams_of_every_width_are_found_again():
    literals = [b"abcd", b"abcde", b"abcdefgh", b"q" * 15, b"abcdefghijklmnopqr", b"0123456789" * 4, "größe".encode()]
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for block, part in sketch_blocks([[[x] for x in literals]]):
        counts[block * len(part) :][: len(part)] = part
    grams = chosen_grams([[x] for x in literals], counts)
    codes = np.array([g for own in grams for g in own], dtype=np.int64)
    bits = np.zeros(1 << 16, dtype=bool)
    for slots in (codes.view(np.uint64) >> np.uint64(48), (codes.view(np.uint64) >> np.uint64(2)) & np.uint64(0xFFFF)):
        bits[slots] = True
    wanted = Wanted(np.packbits(bits, bitorder="little"), WIDTHS)
    texts = pa.array(["", None, "ab", *[f"x {x.decode().upper() if x.isascii() else x.decode()} y" for x in literals], "abc", "d"])
    got = text_grams(texts, wanted).to_pylist()
    assert all(set(own) <= set(have) for own, have in zip(grams, got[3:], strict=False))
    assert got[0] == got[1] == got[2] == got[-1] == got[-2] == []
