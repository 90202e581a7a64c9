"""From raw documents to token ids: five stages, each written as Parquet and read again for the next.

1. quality: the quadratic discriminant scores every document; those below the threshold go.
2. near_duplicates: of each class of near-duplicates one document stays.
3. secrets: secrets are masked in the texts; every document stays.
4. mix: each document is repeated as the target weights of its source ask.
5. pieces: every text becomes piece ids, and is decoded from them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import mixing, pieces, quality, secrets, simhash
from quiverlake.llm.queries import PIECE_MODEL
from quiverlake.llm.runtime import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted on the labelled ones that are not held out, scores 0.7 or more.

    Null and empty texts are scored like others, so they go or stay by their score; equal texts fare alike; an empty table stays
    empty; all columns stay, whatever their names. Labels are read for the fit alone.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates among ``docs`` the row with the smallest doc_id.

    Null and empty texts are one class; of rows that repeat a doc_id and a text one stays; a class of rows without ids
    keeps one of them; an empty table stays empty; all columns stay, whatever their names.
    """
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the secrets in their texts masked, by models trained on words of ``docs``.

    All rows and columns stay; null and empty texts, and texts without secrets, as they are; equal texts are masked
    alike; an empty table stays empty.
    """
    return secrets.mask_secrets(docs, secrets.learn(secrets.samples(docs)))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, each row as often as the target of its source asks, which may be never.

    Null texts have size 0, a null source is a source, rows with one doc_id are taken alike, an empty table stays
    empty; all columns stay, whatever their names.
    """
    return mixing.mix(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, piece_ids, and whether the ids decode to the text (a U+2581 comes back a space).

    Null texts count as empty and have no ids; rows may repeat; an empty table gives no row; other columns are not read.
    """
    out = pieces.encode(docs.select("doc_id", "source", "lang", "text"), PIECE_MODEL, drop=("text",), round_trip="round_trip")
    return out.select("doc_id", "source", "lang", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mix", mix_stage),
    ("pieces", piece_stage),
]

#: The classifier, fingerprints and piece ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The tables of the others go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
