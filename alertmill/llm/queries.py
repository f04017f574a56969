"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm import blob_ledger, bmw, chat, dac, fm_index, hard_negatives, merkle, nbsvm, packing, partenum, phrase_dedup, pii, suffix_dedup
from alertmill.llm.sql import ORACLE_SQL as MORE_SQL
from alertmill.llm.tokens import byte_bpe_path
from alertmill.session import prepare
from alertmill.storage import materialize, new_table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=200).drop("spans")


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeated_phrases(_table(spark, sf_dir, "documents"), length=13).drop("kept_text")


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), byte_bpe_path(), capacity=1024, end_id=2)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_table(_table(spark, sf_dir, "documents"), byte_bpe_path(), end_id=0)


def op7_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bmw.top_documents(docs, docs.where(F.col("doc_id") % 50 == 0), k=10, alike="lang")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[F.col(f"base_{k}") for k in pii.BASE])
    return found.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"),
    )


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = materialize(chat.format_reply_trees(chat.linear_replies(messages)), "conversations-formatted")
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = written.select("tree", "formatted", turns.alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), length=13, share=20)
    items = F.array_join(F.array_sort("item_ids"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op11_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = blob_ledger.Ledger(spark, new_table_path(spark, "ledger"))
    blob_ledger.update(docs, ledger)
    found = blob_ledger.findings(docs, ledger)
    names = [r.kind for r in blob_ledger.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(names))
    of_kind = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in names]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("secrets")).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    floored = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(256 * x).cast("double"))
    scaled = F.transform("embedding", lambda x: floored(x.cast("double")))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), scaled.alias("embedding"))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (lower != F.col("text"))
    tampered = F.when(touched, merkle.leaf(*fields, lower))
    leaves = docs.select("doc_id", "lang", merkle.leaf(*fields, F.col("text")).alias("leaf"), F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), tampered).alias("carry"))
    made = merkle.manifest(leaves)
    start = F.coalesce(F.try_element_at(F.split("carry", ","), F.lit(2)), F.col("leaf"))
    doc_id = F.element_at(F.split("carry", ","), 1)
    read = made.select(
        F.when(doc_id != "", doc_id).cast("long").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), merkle.folded(start, F.col("proof")).alias("folded_root"),
    )
    return read.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_partenum_join": op3_partenum_join,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_codes": op6_token_codes,
    "op7_block_max_search": op7_block_max_search,
    "op8_personal_data": op8_personal_data,
    "op9_reply_trees": op9_reply_trees,
    "op10_fm_index_decontamination": op10_fm_index_decontamination,
    "op11_blob_ledger": op11_blob_ledger,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_phrase_automata": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), n AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
    FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) WHERE len(w) >= 13
), f AS (
    SELECT h, min(doc_id) AS least FROM n GROUP BY h
), r AS (
    SELECT DISTINCT doc_id, i + k AS i FROM n JOIN f USING (h), (SELECT unnest(range(13)) AS k) WHERE doc_id > least
), k AS (
    SELECT d.doc_id, d.i, d.word, r.i IS NOT NULL AS gone
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) AS d LEFT JOIN r USING (doc_id, i)
), s AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
        string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
    FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
""",
    "op9_reply_trees": r"""
WITH m AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length(role) + length(text) + 15 + length(text) - length(replace(replace(text, '\', ''), '<', ''))
            + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), chr(10), ''))) AS chars
    FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    chars::BIGINT AS formatted_chars
FROM g
""",
    **MORE_SQL,
}
