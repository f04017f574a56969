import re

import pytest
from pyspark.sql import functions as F

WORDS = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, docs, parts=3):
    """Documents with extra columns whose names clash with those of the operators."""
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return rows.withColumns({"spans": F.lit(1), "size": F.lit("x"), "score": F.lit(0.5), "part": F.lit(None).cast("string"), "n_words": F.lit(3)})


@pytest.fixture(scope="session")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="session")
def odd(sample):
    """Nulls, empty and long texts, repeated rows and shared passages."""
    shared = sample[5][1][:400]
    return [
        (5000, None), (5001, ""), (5002, "a " * 1000), (5003, "a " * 12), (5004, "ab" * 600), (None, sample[0][1]), (None, None),
        (5005, sample[3][1] + " " + sample[2][1]), (5006, sample[3][1]), (5006, sample[3][1]), (5007, "x " * 13), (5008, "A a  a"), (5009, "a a a"),
        (5010, "é🙂 ß 　 日本 語 <|endoftext|> " * 40),
    ] + [(6000 + i, f"{i} " * 30 + shared + f" {i * 7} " * 40) for i in range(12)]
