"""From raw documents to pieces: five stages, each over all that the one before kept.

Quality, language, near-duplicates and contamination each remove whole documents; what is
left is encoded. What holds for all stages:

- an empty table gives an empty table, with the same columns (the last stage: its own);
- other columns, whatever their names, go through unread and unchanged;
- a row with a null id is a row like any other;
- a very long text is read whole, in memory in proportion to its length, and does not widen
  the memory of others: workers take batches in parts by rows and bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, language, near, pieces, quality
from corpusloom.llm.cluster import shared, table

SURE = 0.3  # least probability of a document's language
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SMALL = 1000  # rows of an Arrow batch: with whole documents in them the default of 10,000 is 32 MB and more on either side


def _small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it has a smaller limit already."""
    if not 0 < int(spark.conf.get(BATCH)) <= SMALL:
        spark.conf.set(BATCH, SMALL)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line field, learned from ``labels``, gives a score of one half or more.

    Null, empty and blank texts have no good line and go. Equal rows stay or go together; a
    score of exactly one half stays.
    """
    _small_batches(spark)
    return quality.good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language has at least the probability ``SURE``; the network learns from ``lang`` where it is not null.

    Null texts and texts without a letter are of no language and go. Equal rows stay or go
    together; a tie between languages goes to the first by name and changes nothing here.
    """
    _small_batches(spark)
    return language.identified(docs, language.train(docs), SURE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id.

    Links are similarities of at least 0.8 of the sets of five-word shingles, verified on the
    whole sets. Candidates come from SimHash fingerprints by Golay keys first (exact and all but
    exact copies); at 0.8 fingerprints of 64 bits differ in ten, which such keys can't bridge,
    so the rest is searched by shared minima. Groups are whole: what links join, over any number
    of texts, is one. Null and wordless texts are one group. A null id stands for its group only if all ids in it are
    null. Of repeated rows one stays; of rows equal in id and text alone, the one whose columns
    have the smallest hash.
    """
    _small_batches(spark)
    return near.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window of ten words of a benchmark item (or no whole item of fewer).

    Null and wordless texts hold none and stay, as do their repeats. An empty benchmark, or
    items without words, remove nothing.
    """
    _small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document, checks that it decodes, and samples segmentations: doc_id, n_pieces, ids_sha256, decoded, samples, ids.

    A null text is an empty one: no pieces, no samples. Equal rows have equal results. A text
    with fewer segmentations than samples has all of them.
    """
    _small_batches(spark)
    return pieces.segmented(docs, with_ids=True, with_sample_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]

#: The fitted models have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet in the shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs
