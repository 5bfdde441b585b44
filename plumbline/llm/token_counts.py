"""Token counts of a corpus from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.durable import stored
from plumbline.llm.batches import slices, texts_of
from plumbline.llm.byte_bpe import DEFAULT, byte_bpe

#: Lengths whose sums one window takes.
SPAN = 4096


def encoded_lengths(docs: DataFrame, text: str = "text", path: str = DEFAULT) -> DataFrame:
    """``(n_tokens)`` per row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path).ids
        for part in slices(batches, "text"):
            yield pa.record_batch([pa.array([len(encode(t)) for t in texts_of(part.column("text"))], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens bigint")


def histogram(docs: DataFrame, text: str = "text", path: str = DEFAULT) -> DataFrame:
    """``(n_tokens, documents)``: how many rows of ``docs`` have each encoded length."""
    return encoded_lengths(docs, text, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents"))


def suffix_sums(lengths: DataFrame, span: int = SPAN) -> DataFrame:
    """A histogram with, at each length, the sums over all documents at least as long.

    ``documents_at_least`` and ``tokens_at_least`` include the length itself,
    ``documents_below`` counts the shorter ones, and ``truncated_total`` is the
    corpus cut at the length as context limit.  Sums run inside spans of
    lengths; one row per span carries them across, so no task takes the whole
    histogram.  An empty histogram gives no rows.
    """
    tokens = F.col("n_tokens") * F.col("documents")
    rows = lengths.select("n_tokens", "documents", tokens.alias("tokens"), F.floor(F.col("n_tokens") / span).alias("_span"))
    spans = rows.groupBy("_span").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t"))
    longer = Window.orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    # One row per span of lengths, so at most the longest document over the span.
    carried = spans.select(
        "_span",
        F.coalesce(F.sum("_d").over(longer), F.lit(0)).alias("_d_after"),
        F.coalesce(F.sum("_t").over(longer), F.lit(0)).alias("_t_after"),
        F.coalesce(F.sum("_d").over(shorter), F.lit(0)).alias("_d_before"),
        F.coalesce(F.sum("_t").over(shorter), F.lit(0)).alias("_t_before"),
    )
    down = Window.partitionBy("_span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("_span").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at_least = F.col("_d_after") + F.sum("documents").over(down)
    below = F.col("_t_before") + F.coalesce(F.sum("tokens").over(up), F.lit(0))
    return rows.join(carried, "_span").select(
        "n_tokens", "documents", "tokens",
        at_least.alias("documents_at_least"),
        (F.col("_t_after") + F.sum("tokens").over(down)).alias("tokens_at_least"),
        (F.col("_d_before") + F.coalesce(F.sum("documents").over(up), F.lit(0))).alias("documents_below"),
        (below + F.col("n_tokens") * at_least).alias("truncated_total"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``(context_limit, documents_cut, truncated_total, tokens_lost)`` for any limits.

    A limit between two lengths follows from the next longer one: every
    document at least that long gives one token less per step down.
    """
    spark: SparkSession = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit bigint")
    # One aggregate per limit over the histogram.
    n, limit = F.col("n_tokens"), F.col("context_limit")
    cut = F.coalesce(F.sum(F.when(n > limit, F.col("documents"))), F.lit(0))
    kept = F.coalesce(F.sum(F.col("documents") * F.least(n, limit)), F.lit(0))
    every = F.coalesce(F.sum("tokens"), F.lit(0))
    return (
        asked.join(sums, F.lit(True), "left")
        .groupBy("context_limit")
        .agg(cut.alias("documents_cut"), kept.alias("truncated_total"), (every - kept).alias("tokens_lost"))
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(share, n_tokens)``: the smallest length that at least this share of documents does not exceed."""
    up_to = (F.col("documents_below") + F.col("documents")) / (F.col("documents_below") + F.col("documents_at_least"))
    columns = [F.min(F.when(up_to >= float(s), F.col("n_tokens"))).alias(f"q{k}") for k, s in enumerate(shares)]
    row = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, s in enumerate(shares)]))
    return sums.agg(*columns).select(row.alias("r")).select("r.*")


def token_counts(docs: DataFrame, text: str = "text", path: str = DEFAULT) -> DataFrame:
    """Histogram and suffix sums of ``docs``, one row per encoded length.

    Null and empty texts count as documents of 0 tokens; repeated rows count
    each time; an empty table gives no rows; other columns play no part.  With
    ``share_up_to``, the share of documents of at most this length, every
    quantile can be read off the rows.
    """
    # Stored: the sums read it twice, and texts are encoded once.
    sums = suffix_sums(stored(histogram(docs, text, path)))
    everything = F.col("documents_below") + F.col("documents_at_least")
    return sums.withColumn("share_up_to", (F.col("documents_below") + F.col("documents")) / everything)
