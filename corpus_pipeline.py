"""Five stages over ``documents``: toxicity, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. The first four return the columns of ``documents``; the last returns packed pieces.

Null and empty texts: toxicity gives them a low score and they stay; quality scores them as one empty passage and keeps
or drops them by that score; they are near duplicates of nothing; mixing and packing take them as they are (one piece of
the end id). Rows with a null ``doc_id`` are scored, never compared, and of equal ones one stays; of rows with the same
``doc_id`` and text one stays, while two texts of one id are two documents, each kept or dropped by itself. Ties and repeated rows: see the operators. Texts of any length go through whole. Extra columns pass
through the first four stages, whatever their names. Without labels nothing is rejected; empty tables give no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollprobe.llm import jaccard_join, mixing, packing, quality, toxicity
from rollprobe.llm.chunk_tokens import tokenizer_path
from rollprobe.llm.common import drop, shared_dir, stored
from rollprobe.llm.quality import held_out
from rollprobe.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels), 0.7)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go."""
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0))
    return quality.keep_good(docs, quality.fit(docs, labels), 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more on five-word shingles the one with the smallest id stays."""
    return jaccard_join.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, so that any stretch of them holds the sources in their target shares."""
    columns = docs.columns
    return mixing.mix(docs).orderBy("position").select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # learned scores, tokenizers and an iterative join: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of what all stages keep; a stage's table is deleted when the next one's is written."""
    docs, at, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{at}/{k}-{name}")
        if before is not None:
            drop(spark, before)  # the last stage has stored its pieces
        before = f"{at}/{k}-{name}"
    return docs
