"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import conversation_repair, decontamination, html_extract, licenses, mixing, prefix_trie, quality_classifier, quality_rules, sharding, simhash, substring_dedup, token_counts, toxicity


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a table of fewer files than cores, which a scan cannot split, is dealt out first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *columns))


#: Target weights of the mix: half of all word tokens, in at most two epochs.
MIX = mixing.Mix(weights={"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}, share=0.5, max_epochs=2)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    t = F.col("toxicity")
    return toxicity.score(docs, model).select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), t["score"].alias("score"), (t["score"] >= 0.7).cast("int").alias("predicted"), t["n_hits"].alias("n_hits"), t["n_quoted"].alias("n_quoted"), t["n_misspelled"].alias("n_misspelled"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return html_extract.extract(pages).select("page_id", "url", "main.text", F.char_length("main.text").cast("long").alias("n_chars"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_documents(spark, sf_dir, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    ids = F.array_join(F.array_sort(c["items"]), ",")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), decontamination.contaminated(c).alias("contaminated"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "text", "lang", "source")
    mixed = mixing.mix_documents(docs, mixing.numbered_domain(F.col("source")), MIX)
    m = F.col("mixed")
    return mixed.select("doc_id", *(m[c].alias(c) for c in mixing.LEVELS), m["tokens"].alias("n_tokens"), *(m[c].alias(c) for c in ("epoch", "leaf_tokens", "leaf_budget")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir, "text")).drop("spans")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(_documents(spark, sf_dir, "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.find(_documents(spark, sf_dir, "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(_documents(spark, sf_dir, "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 512).alias("over_limit"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir, "text"), shards=8)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "text", "lang")
    return quality_rules.score(docs, quality_rules.references(docs)).select("doc_id", "quality.*")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.nodes(prefix_trie.grafted(prefix_trie.turn_rows(said)))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "text")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("quality_score")
    return quality_classifier.score(docs, model).select("doc_id", (~quality_classifier.in_training(F.col("doc_id"))).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(conversation_repair.damaged(said))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_html_extraction, op3_benchmark_decontamination, op4_source_mixing, op5_license_scan, op6_simhash_near_dedup, op7_suffix_array_dedup, op8_token_counts, op9_sharding, op10_quality_rules, op11_conversation_prefix_trie, op12_quality_classifier, op13_conversation_repair)
}

ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": decontamination.oracle(),
    "op7_suffix_array_dedup": substring_dedup.oracle(),
    "op4_source_mixing": mixing.oracle(MIX, "('domain' || cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as varchar))"),
    "op5_license_scan": licenses.oracle(),
}
