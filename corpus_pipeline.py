"""Corpus pipeline over ``documents``: each stage works on all that the one before it kept.

quality rules -> near-dedup -> substring dedup -> decontamination -> BPE. The runner writes a stage's rows as
Parquet and reads them again; all stages but the last return the columns of ``documents``. Quality rules and BPE
cannot be stated in SQL (a learned list, a vocabulary file), so there is no ORACLE_SQL; tests hold the run
against a brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.bpe import encode
from fleetspark.llm.common import cut, release, shared_folder
from fleetspark.llm.decontamination import contaminated
from fleetspark.llm.minhash import near_duplicates
from fleetspark.llm.quality_rules import good_only, rules_from, statistics
from fleetspark.llm.substring_dedup import remove_repeats

#: The most labelled documents that the quality rules are learned from, those with the smallest hash of the id.
LABELLED = 20_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a learned rule rejects go; a null or empty text is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter("quality is not null")
    # the list is learned from LABELLED rows at most; every document is then judged in the scan
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    labelled = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rules = rules_from(cut(statistics(labelled.select(COLUMNS), keep=["doc_id"])), chosen, most_labelled=LABELLED)
    return good_only(docs.select(COLUMNS), rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays (rows with a null id too)."""
    groups = cut(near_duplicates(docs).filter("kept").select("doc_id").distinct())
    release(spark)
    return docs.join(groups, docs["doc_id"].eqNullSafe(groups["doc_id"]), "left_semi").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a smaller document's passage repeats go; a text that loses none stays as it is, white space too."""
    names = {"n_words": "_n", "n_removed": "_removed", "kept_text": "_kept", "removed_spans": "_spans"}
    out = remove_repeats(docs, added=names)
    text = F.when(F.col("_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each judged by its own text: those without an id too."""
    row = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    found = contaminated(docs.withColumn("_row", row), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    found = cut(found.select(F.col("_row.doc_id").alias("_doc"), F.col("_row.text_hash").alias("_hash")).distinct())
    release(spark)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"]) == found["_hash"]), "left_anti").select(COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, their number and the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return encode(docs, path, decoded_col="decoded").withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("BPE", bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
