"""From raw documents to training ids.

Five stages, each over all that the one before has kept: quality rules judged by host, one document
of each group of near copies, secrets replaced by a mark, sources mixed to their target weights,
and token ids. All but the last return the columns of the documents.

Edge cases, stage by stage: documents without words (null or empty texts too) fail the quality rules; each row is judged
by itself, and a null source is a host of its own. Rows without an id are never near copies and stay; rows
that share an id stay or go together. Null texts stay null where secrets are replaced. The mix draws by id: rows that share
one are copied alike, a null source comes last. A null text has no token ids. Empty tables stay empty, and
further columns are carried through all stages but the last, whatever their names.

SQL can't express decoding layers, the component search and BPE, so there is no ``ORACLE_SQL``;
tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import byte_bpe, jaccard_join, mixing, quality_rules, secret_scan
from docflow.llm.common import computed, discard, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets, encoded ones too, replaced by a mark; lengths follow."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens`` of each row."""
    encoded = byte_bpe.encode(docs, *byte_bpe.default_vocabulary())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", good_quality),
    ("jaccard_join", without_near_copies),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
    ("byte_bpe", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written before the next begins. What a stage leaves behind is deleted, and so is
    its result once the next stage has its own."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = computed(spark, lambda now=docs, run_stage=stage: run_stage(spark, now, sf_dir), f"stage-{name}")
        if k:
            discard(docs)
        docs = made
    return docs
