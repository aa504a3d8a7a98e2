"""The registered queries of the dealt operators, each over whole tables; results that SQL can check have SQL here too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm.decontamination import decontaminate
from leadlake.llm.fingerprints import edit_sensitivity
from leadlake.llm.language import fit_languages, fold, identify_languages
from leadlake.llm.licenses import license_summary, scan_licenses
from leadlake.llm.manifest import tampered_audit
from leadlake.llm.mixing import mix_sources
from leadlake.llm.phrases import collocations
from leadlake.llm.pieces import encode_pieces
from leadlake.llm.repeats import drop_repeats
from leadlake.llm.simhash import near_duplicates
from leadlake.llm.sql import collocation_sql, decontamination_sql, manifest_sql, top_k_sql
from leadlake.llm.templates import drop_recurring_lines
from leadlake.llm.topk import top_k
from leadlake.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict = {}
ORACLES: dict = {
    "op3_topk": top_k_sql(), "op11_collocations": collocation_sql(), "op12_decontamination": decontamination_sql(), "op13_manifest": manifest_sql(),
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    found = score_toxicity(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op2_line_templates(spark, sf_dir):
    found = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op3_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op4_licenses(spark, sf_dir):
    return license_summary(scan_licenses(table(spark, sf_dir, "documents")))


@query
def op5_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op6_pieces(spark, sf_dir):
    found = encode_pieces(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "lossless", "ids")


@query
def op7_repeats(spark, sf_dir):
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op8_mixing(spark, sf_dir):
    found = mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op9_fingerprints(spark, sf_dir):
    return edit_sensitivity(table(spark, sf_dir, "documents"))


@query
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(fold("doc_id", 3) != 1))
    found = identify_languages(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query
def op12_decontamination(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query
def op13_manifest(spark, sf_dir):
    return tampered_audit(table(spark, sf_dir, "documents")).drop("source")
