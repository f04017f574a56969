import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from alertmill.llm.queries import ORACLE_SQL, QUERIES

from ..test_catalog import TABLES, rows
from .conftest import ALNUM, lower
from .test_filters import base_brute, contamination_brute
from .test_join_search import components_brute, near_copies

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_pipeline_stage_by_stage(spark):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        after = docs.collect()
        if name == "best-fit packing":
            assert {r.doc_id for r in after} == set(before) and sum(r.piece == 0 for r in after) == len(before)
            break
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in after}
        assert set(kept) <= set(before) and len(kept) == len(after)
        if name == "quality classifier":
            assert len(kept) >= 0.7 * len(before)
        elif name == "n-gram jaccard join":
            assert set(kept) == {d for d, _, c in components_brute(list(before.items()), 5, 80) if d == c}
        elif name == "benchmark decontamination":
            assert set(kept) == {r[0] for r in contamination_brute(list(before.items()), items) if not r[4]}
        else:
            assert set(kept) == set(before) and not any(base_brute(t) for t in kept.values())
            assert all(kept[d] == t for d, t in before.items() if not base_brute(t) and "token" not in lower(t) and ALNUM.search(t))


def test_near_duplicate_stage_links_from_four_fifths_of_five_words(spark):
    rnd, docs = random.Random(6), near_copies()
    for edits in (9, 10, 11):
        base = [str(rnd.randrange(10**6)) for _ in range(454)]
        own = [f"edit{k}" if k % 40 == 20 and k < 40 * edits else w for k, w in enumerate(base)]
        docs += [(100 * edits, " ".join(base)), (100 * edits + 1, " ".join(own))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()
    want = {d for d, _, c in components_brute(docs, 5, 80) if d == c}
    assert want & {901, 1001, 1101} == {1101}  # 10 edits leave 400 of 500
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_stages_keep_clean_rows_without_id(spark):
    """Rows without id are not dropped for another one's sake."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    docs = [(None, f"clean {k} " + " ".join(f"w{k}x{i}" for i in range(30))) for k in range(4)] + [(None, item), (8, item.upper()), (8, "short")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    near = corpus_pipeline.near_duplicates(spark, rows, SF)
    clean = corpus_pipeline.decontamination(spark, near, SF).collect()
    assert {r.text for r in clean} == {t for _, t in docs if t.lower() != item.lower()}


def test_stages_keep_columns_that_clash(spark):
    """Columns named like the operators' own come out as they went in."""
    names = ["score", "gone_id", "text_key", "_near_doc_id", "_row", "first", "n_hit", "class_id", "component", "label", "spans"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain = {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
        got = stage(spark, told, SF)
        assert got.columns == told.columns, name
        kept = got.collect()
        assert {r.doc_id: r.text for r in kept} == plain, name
        assert all(r[c] == f"{c} {r.doc_id}" for r in kept for c in names), name
