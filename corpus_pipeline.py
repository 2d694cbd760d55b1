"""From raw documents to a training mix: five stages, each written and read again.

1. language_id: documents without a recognised language go.
2. ngram_jaccard_join: one document of each group of near copies stays, the one with the smallest id.
3. suffix_array_dedup: passages of 200 bytes or more that occur again are cut out of the texts.
4. benchmark_decontamination: documents with a benchmark passage go.
5. mixing_sources: documents that the mix takes, with the words taken.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.decontaminate import benchmark_leaks
from cotejo.llm.jaccard import near_duplicate_sets
from cotejo.llm.languages import identify_languages
from cotejo.llm.mixing import mix_sources
from cotejo.llm.suffixes import remove_repeated_bytes
from cotejo.sources.written import new_folder, remove_folder, scratch

#: A language that makes up less of a document than this doesn't name it.
LEAST_LANGUAGE_SHARE = 0.4
WORD = r"[^\x20\x09-\x0D]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language stay; those without a letter or text, or too mixed, go. Ids are not looked at."""
    judged = identify_languages(docs)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, mark, row): what tells rows apart, and the columns of docs out of reach of other tables' names.

    key is the id; without one it comes from the text, above all usual ids. mark is a hash of the text, so rows of one id with different
    texts are told apart; rows of equal id and text are alike to every stage.
    """
    mark = F.xxhash64("text")
    by_text = mark.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), by_text).alias("key"), mark.alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id and, of its texts, the smallest hash. Rows without words are in no group and stay; rows without an id take part, after those with one."""
    keyed = _keyed(docs)
    found = near_duplicate_sets(_texts(keyed)).where("cluster is not null")
    stay = found.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").alias("key"), "mark")).alias("one")).select("one.*")
    one = keyed.join(stay.hint("shuffle_hash"), ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"])
    wordless = keyed.where(~F.coalesce(F.col("row.text").rlike(WORD), F.lit(False)))
    return one.unionByName(wordless).select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings are cut from every row's text, with or without an id. A document of which nothing but white space is left goes; n_chars follows the text."""
    keyed = _keyed(docs)
    cut = remove_repeated_bytes(_texts(keyed), keep_text=True).where("n_removed > 0").select(F.col("doc_id").alias("key"), "mark", "kept_text").dropDuplicates(["key", "mark"])
    joined = keyed.join(cut.hint("shuffle_hash"), ["key", "mark"], "left")
    left = joined.where(F.col("kept_text").isNull() | F.col("kept_text").rlike(WORD))
    new = {"text": F.coalesce("kept_text", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))
    return left.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage go, whatever their id: a text is judged by itself, so a clean text of the same id stays, and so do rows without text."""
    of_text = F.struct(F.xxhash64("row.text").alias("hash"), F.length("row.text").alias("length"))
    keyed = _keyed(docs).select(of_text.alias("of_text"), "row")
    texts = keyed.select(F.col("of_text").alias("doc_id"), F.col("row.text").alias("text"))
    leaks = benchmark_leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("of_text")).distinct()
    return keyed.join(leaks.hint("shuffle_hash"), "of_text", "left_anti").select("row.*")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with doc_id, size, source_size, target and taken, and the other columns of docs. Columns of docs of a name that the mix gives too are replaced; a row without an id draws by its text."""
    keyed = _keyed(docs)
    sized = keyed.select(F.col("key").alias("doc_id"), "mark", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    taken = mix_sources(sized, carry=("mark",)).where("taken > 0").withColumnRenamed("doc_id", "key").dropDuplicates(["key", "mark"])
    given = [c for c in taken.columns if c not in ("key", "mark")]
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", *given)]
    return keyed.join(taken.hint("shuffle_hash"), ["key", "mark"]).select(F.col("row.doc_id").alias("doc_id"), *given, *own)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]
#: Language inference and compound removal are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage writes on its way, and the table that it read, go once its own table stands."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before, path = path, new_folder(spark, name, keep=True)
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove_folder(spark, before)
    return docs
