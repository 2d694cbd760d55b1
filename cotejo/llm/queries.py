"""One query for each operator, with production parameters, over whole tables."""

from pyspark.sql import DataFrame, SparkSession

from cotejo.llm import embeddings, exponion, mixing, trie, warc
from cotejo.llm.decontaminate import benchmark_leaks
from cotejo.llm.jaccard import near_duplicate_sets
from cotejo.llm.languages import identify_languages
from cotejo.llm.licenses import scan_licenses
from cotejo.llm.quality import quality_rules
from cotejo.llm.repeats import remove_repeated_passages
from cotejo.llm.suffixes import remove_repeated_bytes
from cotejo.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_sets(_table(spark, sf_dir, "documents")).drop("mark", "cluster")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(_table(spark, sf_dir, "documents"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(spark, _table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents")).drop("row")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_substring_dedup, op4_mixing_sources, op5_benchmark_decontamination, op6_warc_zip_archives, op7_language_id, op8_license_scans, op9_toxicity, op10_suffix_array_dedup, op11_embedding_near_dedup, op12_conversation_prefix_trie, op13_centroid_clustering)}
ORACLES: dict[str, str] = {
    "op4_mixing_sources": mixing.ORACLE,
    "op6_warc_zip_archives": warc.ORACLE,
    "op11_embedding_near_dedup": embeddings.ORACLE,
    "op12_conversation_prefix_trie": trie.ORACLE,
    "op13_centroid_clustering": exponion.ORACLE,
}
