import random

import duckdb
import pytest
from pyspark.sql import functions as F

from alertmill.functions.regex import BadPattern, _Rewriter, to_java
from alertmill.functions.subjects import subject_matches, wildcard_regex

TEXTS = [
    "", "foo", "foo\n", "a.foo", "foo\nbar", "bar\n", "x[:alpha:]", "ABC", "é", "É", "a\rb", "a\nb", "a\x0bb", "test-11", "te.st",
    "foo_bar 12", "12-34", "a]b", "a&&b", "a-b", "{x}", "a{2}", "aaa", "\\E", "(.)", "K", "ſ", "s", "tab\there", "Ünïcode", "日本 42", "a^b$c", "éa", "aé", "foo-bar_", "k", "xK", "ſ1",
]
PATTERNS = [
    "foo$", "^foo$", "(?m)foo$", "(?m)^bar", "(?m)^$", "a.b", "(?s)a.b", "[[:alpha:]]", "[[:^alpha:]]", "(?i)é", "(?i)abc", "(?i)k", r"a\sb", r"a\Sb",
    r"\d+", r"[^\d]", r"\w+\b", r"\bfoo\b", r"\Bo", r"[\s]", r"[^\s]b", "[]a]", "[^]a]", "[a&&b]", "a[-]b", "[a-c]+", "{x}", "a{2}", "a{2,}", "a{1,2}?b?",
    r"\Q(.)\E", r"\x41", r"\x{e9}", r"\pL+", r"\p{Greek}", r"\PL", r"[\pN]", "(?P<n>foo)", "(?:foo|bar)", "(?i:FOO)", "(?i)f(?-i)oo", "te[sS]t", "t.st",
    r"\A\z", "()", "|", "a|", "(?U)a+", "[[:word:]]+", r"[\w-]+", r"\t", "x*", r"a\x0Bb", r"[\x00-\x1f]", r"\.", r"\{2\}", "[$^]", r"[\]]", r"\-", "a{,2}", "日.+", r"\bfoo", r"o\b", r"\b[a-z]+\b", r"[a-z]*\b", r"\b[a-z]*_", r"\bo?o", r"(?i)\bk", r"(?i)k\b", r"(?i)\bx", r"\b\d+\b", r"\w\b-", r"\b", r"x\b{0}", r"(foo)\b",
    r"foo|\bbar", r"(?i)\w", r"(?i)[\w]", r"(?i)s\b", r"é\b", r"\bé", r"12\b-\b34", r"\b\b1",
]
BAD = [
    "[", "(", ")", "a)", "*a", "a**", "a+*", "a{2}{3}", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"(a)\1", "a++", "(?>a)", "a{1001}", "a{2,1}", "[b-a]",
    r"\Z", r"\k<a>", r"\h", "(?x)a", "(?P<n>a)(?P<n>b)", "[[:foo:]]", "[a", "\\", "a|*", "(*a)", r"\G", r"\xZZ", "(?i)*",
]


def test_same_matches_as_re2(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(TEXTS)))
    flags = [F.col("s").rlike(to_java(p)).alias(f"p{n}") for n, p in enumerate(PATTERNS)]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string").select("i", *flags).orderBy("i").collect()
    for n, pattern in enumerate(PATTERNS):
        want = [r[0] for r in con.execute("SELECT regexp_matches(s, ?) FROM t ORDER BY i", [pattern]).fetchall()]
        got = [r[f"p{n}"] for r in rows]
        assert got == want, pattern


@pytest.mark.parametrize("pattern", BAD)
def test_bad_patterns_are_refused(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)


def test_subject_wildcards(spark):
    subjects = ["slg.err.app.h", "slg.err", "slg", "slg.", "slg.err.app.h.x", "slgx.err", "slg.warn.app.h"]
    df = spark.createDataFrame([(s,) for s in subjects], "s string")

    def matched(pattern):
        return [r.s for r in df.where(subject_matches("s", pattern)).collect()]

    assert matched("slg.>") == ["slg.err.app.h", "slg.err", "slg.err.app.h.x", "slg.warn.app.h"]
    assert matched("slg.err.>") == ["slg.err.app.h", "slg.err.app.h.x"]
    assert matched("slg.*.app.h") == ["slg.err.app.h", "slg.warn.app.h"]
    assert matched("slg.*") == ["slg.err"]
    assert matched("*.err") == ["slg.err", "slgx.err"]
    assert matched("slg.err") == ["slg.err"]
    assert len(matched(">")) == len(subjects)
    for bad in ("a..b", "a.>.b", ""):
        with pytest.raises(ValueError):
            wildcard_regex(bad)


def test_prefix_subscription_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("slg.err.a.h",)], "subject string").write.parquet(path)
    plan = spark.read.parquet(path).where(subject_matches("subject", "slg.err.>"))._jdf.queryExecution().toString()
    assert "StringStartsWith(subject,slg.err.)" in plan


LONG = "ab" * 32_767 + "a"


@pytest.mark.parametrize("pattern, found", [("(a|b)*c", False), ("(a|b)+a$", True), ("(?:foo){2,}", False), ("a(?:bc?)?a$", True)])
def test_safe_repetitions_work_on_long_texts(spark, pattern, found):
    row = spark.createDataFrame([(LONG,)], "t string").select(F.col("t").rlike(to_java(pattern)).alias("r")).first()
    assert row.r is found


LOOPS = [
    "(foo|bar)+", "(?:ab|c)*d", r"([0-9]+\.)+[0-9]+", r"(\w+\s)*error", "(?:[a-z]+-)*[a-z]+", r"^(\d+,)*\d+$", "(a+)+$", r"(?:\w+\s?)*$", "^(?:ab|c)*d", r"^(?:\w+ )*x$",
    r"^(\w+\s)*error", "^((ab|c)*d){2}$", "^((ab|c)+,)*x$", "^(a|ab)*c$", "^(foo|foobar)*$", "(?i)^(foo|ba+r)*x$", r"^(foo\b|bar)*$", r"^(\s*\w+)*$", r"^(/[\w.-]+)+/?$",
    '^("[^"]*"|[^"])*$', "^(?:[^,]*,){3,}x", "^(ab|c){150}$", r"^([\w.+-]+)@([\w-]+\.)+[a-z]{2,}$", "(?:a|b?)*c$", "((a*b)*,)+,$", "^((a|b+)*c)*$", "(?m)^(?:a+b)+$", "(?:é|ab)+é$", r"^(?:\pL+ )*x",
]
LOOP_TEXTS = [
    "", "foobar", "foo bar", "abcabd", "d", "1.2.3", "1.", "an error", "error", "x error log", "a-b-c", "1,22,333", "1,,2", "aaa", "a b c", "a b c ", "ababcd", "abcabcdd", "abcd,x", "ab,c,x",
    "ababc", "aab", "foofoobar", "foofoobarb", "FOObaaarx", "foobarfoo", "foo.foo", " a  b", "/a/b-c/", "//", 'a "b" c', 'a "b c', "a,b,,x", "a,b,x", "abc" * 75, "ab" * 150, "me@a.b.org", "me@a..org",
    "ab,,", "aabb,ab,,", "aabc", "abbcc", "x\naab", "x\nab", "éabé", "été", "né x", "a\nb\nc",
]
# Loops of which a round can end in several places whatever comes next.
AMBIGUOUS = ["^(ab?){2,}b$", "^(a|$)*b", r"^(a|b|ab)*cab$", r"^((ca){2,})*d$", "(a{500}){500}"]


def test_tamed_loops_match_as_re2(spark):
    con = duckdb.connect()
    flags = [F.col("s").rlike(to_java(p)).alias(f"p{n}") for n, p in enumerate(LOOPS)]
    rows = spark.createDataFrame(list(enumerate(LOOP_TEXTS)), "i int, s string").select("i", *flags).orderBy("i").collect()
    for n, pattern in enumerate(LOOPS):
        want = [con.execute("SELECT regexp_matches(?, ?)", [s, pattern]).fetchone()[0] for s in LOOP_TEXTS]
        assert [r[f"p{n}"] for r in rows] == want, pattern


def _random_pattern(rnd, depth):
    k = rnd.random()
    if depth == 0 or k < 0.3:
        return rnd.choice(["a", "b", "c", "[ab]", "[^a]", ".", "ab", "bc", "ca", "abc", r"\b", "é"])
    if k < 0.5:
        return _random_pattern(rnd, depth - 1) + _random_pattern(rnd, depth - 1)
    if k < 0.65:
        return f"({_random_pattern(rnd, depth - 1)}|{_random_pattern(rnd, depth - 1)}{rnd.choice(['', '', '|'])})"
    return f"({_random_pattern(rnd, depth - 1)}){rnd.choice(['*', '+', '*', '+', '?', '{2,}', '{1,2}', '*?'])}"


def test_random_loops_match_as_re2(spark):
    rnd, con, taken, refused = random.Random(11), duckdb.connect(), [], 0
    texts = ["".join(rnd.choice("aaabbbccc\né ") for _ in range(rnd.randrange(0, 14))) for _ in range(60)]
    while len(taken) < 150:
        pattern = rnd.choice(["", "^", "(?i)"]) + _random_pattern(rnd, 4) + rnd.choice(["", "$"])
        try:
            reader = _Rewriter(pattern)
            reader.run()
            if reader.recursing:
                taken.append((pattern, to_java(pattern)))
        except BadPattern:
            refused += reader.recursing
    assert refused < 100  # of those that recurse, most have another form
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = df.select("i", F.array(*[F.col("s").rlike(java) for _, java in taken]).alias("m")).orderBy("i").collect()
    for n, (pattern, java) in enumerate(taken):
        want = [con.execute("SELECT regexp_matches(?, ?)", [s, pattern]).fetchone()[0] for s in texts]
        assert [r.m[n] for r in got] == want, (pattern, java)


@pytest.mark.parametrize("pattern", AMBIGUOUS)
def test_ambiguous_loops_are_refused(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)


@pytest.mark.parametrize(
    "pattern, text, found",
    [
        ("^(?:ab|c)*d", "abc" * 400_000, False), (r"^(?:\w+ )*x$", "word " * 250_000 + "x", True), (r"^(\w+\s)*error", "word " * 250_000 + "error x", True),
        (r"^(\d+,)*\d+$", "12," * 400_000 + "1", True), ("^((ab|c)+,)*x$", "abc," * 300_000, False), (r"(\w+\s?)*$", "word " * 200_000, True),
    ],
)
def test_tamed_loops_work_on_long_texts(spark, pattern, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(to_java(pattern)).alias("r")).first()
    assert row.r is found
