"""A corpus pipeline: documents whose language is sure, without toxic ones and near duplicates, packed into sequences."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import langid, minhash, packing, toxicity
from memlattice.llm._shared import prepare, table
from memlattice.shipping import shared_folder


def _new_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names that docs has no column of."""
    prefix = "_"
    while any(prefix + n in docs.columns for n in names):
        prefix += "_"
    return tuple(prefix + n for n in names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; learns from all that have a language.

    Rejected: documents without a letter (so also null and empty texts), and unsure ones. Repeated rows are decided alike. Columns
    and their order are those of docs, whatever their names; an empty table gives an empty one.
    """
    prepare(spark)
    names = _new_names(docs, "language", "likely", "rejected")
    out = langid.identify(docs, langid.fit(docs, F.lit(True)), names=names)
    return out.where(~F.col(names[2])).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score below the threshold; learns from the labelled ones among them.

    Null and empty texts have no evidence and get the calibration's score for it, so they stay unless most labelled texts are toxic.
    Repeated rows are decided alike; null ids teach nothing. Columns and their order are those of docs, whatever their names; an
    empty table gives an empty one.
    """
    names = _new_names(docs, "toxic", "evidence", "window")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, names=names).where(F.col(names[0]) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, that of the least id.

    Null and empty texts are linked with nothing and all stay. Repeated rows are copies. Columns and their order are those of
    docs, whatever their names; an empty table gives an empty one.
    """
    prepare(spark)
    return minhash.deduplicated(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens.

    A null or empty text is its end token alone. Repeated rows are packed as often as they occur; null ids are kept as they are.
    Only doc_id and text are read; an empty table gives no pieces.
    """
    prepare(spark)
    out = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL has no word for the trained models of the stages. Tests hold the first two to the operators' own decisions and to labels,
#: the third to a comparison of all pairs, the last to the tokenizer's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
