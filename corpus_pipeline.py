"""Training-corpus pipeline over `documents`: five operators of weftline.llm in a row.

quality rules   documents that a certified cutoff or the base rules reject go
near copies     documents 0.8 or more similar (five-word shingles) to one of lesser id that stays go
benchmark       documents with a passage of a benchmark item go
personal data   spans become their kind in brackets; n_chars follows the text
mixing          documents are repeated or left out to meet the sources' targets

Each stage gets what the one before kept, written as Parquet and read again. The first
four return the columns of documents; the last adds `copies` (how often the mix takes
the document, 1 to 3; `mix_copies` where that name is taken) and leaves out what it takes no time. Rows are never expanded.

Null and empty texts have no words, so the first stage rejects them; a null source is a source, a null id an id that
stands last. Texts are read whole by every stage, however long. Of repeated rows and equal texts the near-copy
stage keeps one. Ids are whole numbers. Empty tables give an empty result; without labels or benchmark items those stages keep what came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, mixing, pii, quality, simhash
from weftline.runtime import materialize, table

NEAR_COPY_SHINGLE = 5
#: the similarity to a document that stays from which near copies go
NEAR_COPY_SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs, NEAR_COPY_SHINGLE, similarity=NEAR_COPY_SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, mixing.word_count(F.col("text")), F.array("source"))
    name, taken = "copies", {c.lower() for c in docs.columns}
    while name in taken:
        name = f"mix_{name}"
    return mixed.filter("__wl_copies > 0").select(*docs.columns, F.col("__wl_copies").alias(name))


STAGES = [("quality rules", quality_rules), ("near copies", near_copies), ("benchmark", benchmark), ("personal data", personal_data), ("mixing", mix)]

#: No SQL: fingerprints, edit search, the tagger and the flow are beyond it. tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
