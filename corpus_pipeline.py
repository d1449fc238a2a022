"""A training corpus from ``documents``, in five stages.

Rejected documents go, one document of each near-duplicate group stays, secrets are
replaced in the texts, sources are mixed to their target weights, and what is left is packed into
sequences. Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinledger.llm import op1_quality, op4_packing, op7_simhash, op8_secrets, op9_mixing
from kinledger.llm.common import written


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the pieces of all documents and their places in sequences.

    A null or empty text is its end id alone; repeated rows and rows without an id are packed each for
    itself; no rows give no pieces; columns but doc_id and text are not read.
    """
    import public_tokenizers

    # the workers hold what earlier stages left in them, so they keep fewer words than in packing alone
    return op4_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), remember=200_000)


STAGES = [
    ("quality classifier", op1_quality.stage),
    ("SimHash near-dedup", op7_simhash.stage),
    ("secret scans", op8_secrets.stage),
    ("mixing", op9_mixing.stage),
    ("packing", packing),
]

#: Stages that fit models, tokenise or look for near-duplicates have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
