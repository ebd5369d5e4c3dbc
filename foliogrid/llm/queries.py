"""The registered queries of the corpus operators: each applies one, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.llm import ann, decontaminate, jaccard, langid, licenses, line_dedup, mixing, tokens, toxicity, warc
from foliogrid.session import cut, table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels"))).drop("times", "source")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with decay (see ``warc.damaged``)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    payload, lost = warc.damaged(F.col("page_id"), F.col("html"))
    copy = warc.record(F.col("page_id"), F.col("url"), payload)
    stored = pages.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"), F.octet_length(copy).cast("long").alias("copy_length"), F.sha2(copy, 256).alias("copy_sha"), lost.alias("lost"))
    packed = cut(warc.pack(stored, "page_id", "record", "copy_length", "copy_sha", "lost"))
    replica = packed.where("not lost").select("ordinal", "offset", F.col("copy_length").alias("length"), F.col("copy_sha").alias("sha"))
    found = warc.audit(packed.select("ordinal", "offset", "length", "sha"), replica).drop("offset")
    places = packed.select("ordinal", F.col("id").alias("page_id"), "file", "number", "offset")
    return found.join(places, "ordinal", "left").select("page_id", "file", "number", "offset", "kind", "length", "replica_length", "sha", "replica_sha")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages (markup language and address) and all documents (declared language; their source is the host)."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    none = F.lit(None)
    host, domain, suffix = langid.address(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(none.cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), F.lit(True).alias("html"), langid.declared_in(F.col("html")).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    plain = docs.select("doc_id", none.cast("long").alias("page_id"), "text", F.lit(False).alias("html"), F.col("lang").alias("declared"), F.col("source").alias("host"), none.cast("string").alias("domain"), none.cast("string").alias("suffix"))
    return langid.identify(pages.unionByName(plain), model, ["doc_id", "page_id"], "text", "html", "declared", "host", "domain", "suffix")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.shared_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, word_tokenizer())
    out = cut(tokens.token_digest(spark, path))
    tokens.remove_path(spark, path)
    return out


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_mixing, op3_warc_fixity, op4_ann, op5_decontamination, op6_line_dedup, op7_language_id, op8_jaccard_join, op9_token_output, op10_license_scan]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from foliogrid.llm.oracle import ORACLES

    return dict(ORACLES)
