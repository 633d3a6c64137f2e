"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; all but the last
return the columns of ``documents``:

1. ``toxicity`` drops the documents that the classifier rejects;
2. ``near_dedup`` keeps one document of each group of near copies;
3. ``decontaminate`` drops documents that hold benchmark passages;
4. ``secrets`` redacts secrets and keeps every document;
5. ``tokens`` encodes what is left: ids, their number and two digests.

No stage samples or caps its rows. SQL can't express the learned stages, so
there is no oracle; ``tests/llm`` holds the stages against planted cases and
their operators against brute force, libraries or held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revcast.llm import bpe_automaton, decontaminate, near_dup, secrets, toxicity
from revcast.llm.common import prepare, table, via_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.redact_secrets(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe_automaton.token_digests(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (decimal, joined by a blank)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = via_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
