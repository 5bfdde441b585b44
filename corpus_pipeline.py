"""A corpus pipeline: toxicity, language, near-duplicates, repeated passages, packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and judges the documents its
predecessor kept; all but the last return the columns of documents.  Other
columns of ``docs`` are dropped at each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.durable import ensure_checkpoint_dir
from plumbline.llm import language_id, near_copies, packing, substrings, toxicity
from plumbline.llm.batches import slices, texts_of
from plumbline.llm.shipping import ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text at least so long that is nearer than this to no language is in none of those learned.
LONG_TEXT = 1000
LEAST_COSINE = 0.1
#: Rows that go to a Python worker at once, at most; whole texts make large batches, which executor and worker both hold.
BATCH_ROWS = 1000
#: Bytes of text that a classifier judges at once; what it derives from a text is many times larger.
SLICE_BYTES = 1 << 18
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _begin(spark: SparkSession) -> None:
    """Ship the package and keep the session's Arrow batches small; a smaller limit of the user stays.

    The setting stays, because the frame a stage returns is only planned when it is written.
    """
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in COLUMNS[1:4]],
        F.col("n_chars").cast("bigint").alias("n_chars"),
    )


def _kept(docs: DataFrame, keeps) -> DataFrame:
    """The rows for which ``keeps(texts, batch)`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            yield part.filter(pa.array(keeps(texts_of(part.column("text")), part)))

    return docs.mapInArrow(run, docs.schema)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language.

    The classifier learns from the labels that are not held out.  Null and
    blank texts are scored as empty texts.
    """
    _begin(spark)
    rows = _documents(docs)
    model = toxicity.taught(rows, table(spark, sf_dir, "labels"))

    def keeps(texts: list[str], part: pa.RecordBatch) -> np.ndarray:
        limits = np.array([model.by_language.get(x, model.threshold) for x in part.column("lang").to_pylist()])
        return model.scores(texts) < limits

    return _kept(rows, keeps)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned.

    Null texts, texts without letters and long texts that are near no profile
    go.  Where no row names its language nothing can be learned, and only
    texts without letters go.
    """
    _begin(spark)
    rows = _documents(docs)
    profiles = language_id.taught(rows)

    def keeps(texts: list[str], part: pa.RecordBatch) -> np.ndarray:
        if not profiles.names:
            return np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        names, scores = profiles.predict(texts)
        far = (np.array([len(t) for t in texts], dtype=np.int64) >= LONG_TEXT) & (scores < LEAST_COSINE)
        return (np.array(names, dtype=object) != "und") & ~far

    return _kept(rows, keeps)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies.

    Near copies have a Jaccard coefficient of five-word shingles of at least
    0.8, step by step.  Of repeated rows one stays.  Rows without doc_id cannot
    be told apart and stay.
    """
    _begin(spark)
    rows = _documents(docs)
    found = near_copies.near_copies(rows.where(F.col("doc_id").isNotNull()))
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = rows.join(first, "doc_id").dropDuplicates(["doc_id"]).select(*COLUMNS)
    return kept.unionByName(rows.where(F.col("doc_id").isNull()))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words and more that an earlier document holds.

    A text that loses words keeps the others with one blank between; one that
    loses all goes.  ``n_chars`` follows the text.
    """
    _begin(spark)
    rows = _documents(docs)
    cut = substrings.without_repeats(rows, keep=("lang", "source", "n_chars"), as_is=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    count = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", count.alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in sequences of 1024 tokens."""
    _begin(spark)
    return packing.packed(_documents(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express the classifiers; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
