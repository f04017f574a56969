import random

import pytest
from pyspark.sql import functions as F

from alertmill.operators.inventory import attribute_index, search
from alertmill.operators.postings import PostingTable

DEVICE = "id bigint, attributes map<string,string>"


def device(rnd, key):
    return key, {"site": rnd.choice("abc"), **({"role": rnd.choice(["core", "edge"])} if rnd.random() < 0.8 else {}), **({"only": str(key)} if key % 50 == 0 else {})}


def listed(postings):
    return {(r.attr, r.value, r.span): list(r.ids) for r in postings.select("attr", "value", "span", "ids").collect() if r.ids}


@pytest.fixture
def table(spark, tmp_path):
    return PostingTable(spark, str(tmp_path / "postings"), span_bits=5)


def test_changes_equal_a_rebuild(spark, table):
    rnd = random.Random(5)
    state = dict(device(rnd, k) for k in range(400))
    frame = lambda keys, of: spark.createDataFrame([(k, of[k]) for k in keys], DEVICE)
    table.build(frame(state, state))
    for _ in range(3):
        gone, moved, fresh = rnd.sample(sorted(state), 20), rnd.sample(sorted(state), 30), [max(state) + k for k in range(1, 20)]
        after = {k: v for k, v in state.items() if k not in gone} | dict(device(rnd, k) for k in [*moved, *fresh] if k not in gone)
        touched = {k for k in state if k not in after or after[k] != state[k]}
        table.change(frame(sorted(touched), state), frame([k for k in after if k not in state or after[k] != state[k]], after))
        state = after
    want = frame(state, state)
    for merged in (False, True):
        if merged:
            table.merge()
        assert listed(table.postings()) == listed(attribute_index(want, span_bits=5))
        for query in ({"site": "a", "role": "core"}, {"site": "b"}, {"*": "*"}, {}, {"*": "*", "site": "c"}, {"site": "none"}, {"only": "50", "site": state.get(50, {}).get("site", "a")}):
            assert sorted(r.id for r in table.search(query).collect()) == sorted(r.id for r in search(want, query).collect()), query


def test_a_reader_keeps_its_state_over_a_merge(spark, table):
    rows = spark.createDataFrame([(k, {"site": "a"}) for k in range(100)], DEVICE)
    table.build(rows)
    reader = table.search({"site": "a"})
    table.change(old=rows.where("id < 50"))
    table.merge()
    assert reader.count() == 100 and table.search({"site": "a"}).count() == 50


def test_search_reads_the_row_groups_of_its_pairs(spark, table):
    rows = spark.range(20_000).select("id", F.create_map(F.lit("serial"), F.format_string("%06d", "id"), F.lit("site"), (F.col("id") % 7).cast("string")).alias("attributes"))
    table.build(rows)
    found = table.search({"serial": "000123", "site": "4"})
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(And(EqualTo(attr,serial),EqualTo(value,000123)),And(EqualTo(attr,site),EqualTo(value,4)))" in plan
    assert [r.id for r in found.collect()] == [123]


def test_an_empty_table(spark, table):
    assert table.search({"site": "a"}).collect() == []
    table.build(spark.createDataFrame([], DEVICE))
    assert table.search({"site": "a"}).collect() == [] and table.search({"*": "*"}).collect() == []
