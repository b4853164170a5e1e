"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next stage's ``docs``. All but the last return
the columns of ``documents``. No stage can be stated in SQL as a whole: the first
holds a trained field's verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import exact_dedup, jaccard, packing, pii, quality
from marketloom.llm.common import materialize, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, quality.train_field(docs, table(spark, sf_dir, "labels")))


def staying(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is kept, and those without an id."""
    return docs.hint("merge").join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; rows without an id all stay, whatever their text."""
    return staying(docs, exact_dedup.exact_dedup(*exact_dedup.split_by_age(docs)).where("kept").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id stays; rows without an id link with nothing and all stay."""
    classes = jaccard.ngram_jaccard_join(docs, width=5, percent=80)
    return staying(docs, classes.where("component_id = doc_id").select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
