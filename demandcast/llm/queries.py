"""The registered queries of the training-data operators.

Each applies its operator, with production parameters, to its whole table and
derives the contract's columns from the operator's output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demandcast.llm.common import span_text, table
from demandcast.llm.decontaminate import find_contaminated
from demandcast.llm.filter_audit import audit_filters
from demandcast.llm.fingerprint import fingerprints, hex_text
from demandcast.llm.language import fit_languages, held_out, label_languages, learnable
from demandcast.llm.mixing import by_first_copy, curriculum_mix
from demandcast.llm.quality import fit_quality, score_quality
from demandcast.llm.oracles import ORACLE_SQL  # noqa: F401
from demandcast.llm.privacy import BASE as PERSONAL
from demandcast.llm.privacy import personal_spans
from demandcast.llm.secret_scan import BASE as SECRETS
from demandcast.llm.secret_scan import scan_secrets
from demandcast.llm.sharding import assign_shards
from demandcast.llm.simhash import near_copies
from demandcast.llm.token_files import read_documents, write_token_files
from demandcast.llm.tokens import count_tokens
from demandcast.llm.whitening import whiten
from demandcast.session import shared_path


def _digest(found, base):
    """Counts and digests of ``spans``, base kinds apart from the method's own."""
    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(span_text(of(*base)), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


def op1_secret_scans(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"), F.col("doc_id"))

    return _digest(found, SECRETS)


def op2_document_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents")) \
        .withColumns({c: hex_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op3_simhash_near_dedup(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op4_pii(spark, sf_dir):
    return _digest(personal_spans(table(spark, sf_dir, "documents")), PERSONAL)


def op5_decontamination(spark, sf_dir):
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op7_mixing(spark, sf_dir):
    mixed = by_first_copy(curriculum_mix(table(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.size("positions") * F.col("size")).cast("long").alias("taken"),
        (F.round(F.array_min("positions"), 6) + F.lit(0.0)).alias("first_position"))  # no -0.0


def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(learnable(docs, 4, 2))
    return label_languages(docs, model, F.col("doc_id"), held_out(4, 2).alias("held_out")) \
        .withColumn("n_spans", F.size("spans")).drop("spans")


def op10_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    positives = learnable(labels.filter("quality = 1"), 3, 1)
    model = fit_quality(learnable(docs, 3, 1), positives)
    return score_quality(docs, model, F.col("doc_id"), held_out(3, 1).alias("held_out"))


def op11_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, f"token_files/{uuid.uuid4().hex}")
    manifest = write_token_files(docs, folder)
    return read_documents(spark, folder, manifest, docs.schema["doc_id"].dataType.simpleString())


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_files": op13_token_files,
}
