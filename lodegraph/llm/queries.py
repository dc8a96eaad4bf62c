"""The registered queries of this subpackage: each operator over its whole table, with the digest columns of its result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import oracles
from lodegraph.llm.collocations import collocations
from lodegraph.llm.common import table
from lodegraph.llm.decontaminate import decontaminate
from lodegraph.llm.html_extract import html_extract
from lodegraph.llm.license_scan import license_scan
from lodegraph.llm.line_dedup import line_dedup
from lodegraph.llm.packing import pack
from lodegraph.llm.quality_rules import ablations, ledger, quality_rules
from lodegraph.llm.secrets import secrets
from lodegraph.llm.simhash import near_duplicates
from lodegraph.llm.telephony import telephony
from lodegraph.llm.token_alignment import token_alignment
from lodegraph.llm.token_store import token_store
from lodegraph.llm.toxicity import toxicity


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "lines_total", "lines_dropped", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony(table(spark, sf_dir, "documents")).drop("media", "pcm")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("cands", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_example")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_capitals", "n_lines", "failed")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_license_scan, op3_html_extract, op4_simhash, op5_line_dedup, op6_toxicity, op7_telephony, op8_secrets, op9_packing, op10_token_store, op11_quality_rules, op12_collocations, op13_token_alignment, quality_rule_ablations)}
ORACLES = {"op1_decontaminate": oracles.OP1, "op2_license_scan": oracles.op2(), "op5_line_dedup": oracles.OP5, "op8_secrets": oracles.OP8, "op11_quality_rules": oracles.OP11, "op12_collocations": oracles.OP12, "quality_rule_ablations": oracles.ABLATIONS}
