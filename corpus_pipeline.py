"""A training corpus from the table `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again for the next stage.  All but the last return the columns of
`documents`; the last returns the encoded documents.

1. language_id: documents without letters, or that no learned language explains, go;
   a missing `lang` is filled with the prediction.
2. line_dedup: copies and near copies of earlier lines are taken out of the texts; a
   document left without any of its lines goes; `n_chars` follows the text.
3. near_dedup: of each group of near duplicates the smallest doc_id stays.
4. decontamination: documents that hold a benchmark window go.
5. byte_bpe: token ids of each document, decoded again for a check of the bytes.

Every stage keeps null doc_ids and repeated rows apart as its operator defines it,
and an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.llm import bpe, decontaminate, langid, lines, neardup
from logveil.llm.exchange import cut, ensure_checkpoint_dir, few

#: A text whose best language explains less than this share of its n-grams is rejected.
LEAST_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    judged = langid.predict(docs, model, explained=True).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("explained") >= LEAST_SCORE))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup(docs).where((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = cut(neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.join(few(copies), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs.select("doc_id", "text"))
    decoded = bpe.decode(encoded.select("doc_id", "n_tokens", "token_ids"))
    return decoded.select("doc_id", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: No SQL: language filters, token merges and edit distances of all lines are beyond it; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`; tables in between stand in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
