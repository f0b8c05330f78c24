"""Token counts: an exact histogram of encoded lengths answers every context limit.

Method. Texts are encoded (byte-level BPE) and only their lengths leave the Python workers. Texts are summed by
length (partial sums before the shuffle). Suffix sums over the lengths then say for every context limit how many
texts exceed it, with how many tokens, and what all texts come to if each is cut at it; prefix counts give quantiles.

Scale: the histogram has a row for each distinct length. Sums run within blocks of SPAN successive lengths and over
the blocks' totals, of which there are (longest text / SPAN), so no task gets all lengths.

Edge cases: null and empty texts have length 0; repeated rows count as often as they occur; an empty table has an
empty histogram; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import checkpoint, map_arrow, table, text_chunks
from .byte_bpe import PATTERN, _codec, default_ranks_path

SPAN = 512


def encoded_lengths(docs: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """n_tokens of each row."""
    path = ranks_path or default_ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in text_chunks(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(codec.encode(batch.column(text).to_pylist())[1].astype(np.int64))], ["n_tokens"])
        codec.forget()

    return map_arrow(docs.select(text), run, "n_tokens bigint")


def length_histogram(lengths: DataFrame, column: str = "n_tokens", span: int = SPAN) -> DataFrame:
    """For each length: n_docs, docs_at_most and tokens_at_most (prefix sums), docs_over and tokens_over (suffix sums), truncated_total (all texts cut at the length), share_at_most."""
    # read twice below; a row for each length, so writing it is cheaper than encoding again
    counted = checkpoint(lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))).withColumn("block", F.expr(f"n_tokens div {span}"))
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    over = Window.orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), zero).alias("d0"), F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)).join(blocks, "block")
    docs, tokens = F.col("d0") + F.col("d"), F.col("t0") + F.col("t")
    return summed.select(
        "n_tokens", "n_docs", docs.alias("docs_at_most"), tokens.alias("tokens_at_most"), (F.col("d_all") - docs).alias("docs_over"), (F.col("t_all") - tokens).alias("tokens_over"),
        (tokens + F.col("n_tokens") * (F.col("d_all") - docs)).alias("truncated_total"), (docs / F.col("d_all")).alias("share_at_most"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share q of the texts does not exceed."""
    return histogram.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: docs_over, tokens_kept when every text is cut at the limit, tokens_lost; exact for any limit, one of the lengths or not."""
    fits = F.col("n_tokens") <= limit
    total = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("long"))
    kept = total(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))
    return histogram.agg(total(F.when(~fits, F.col("n_docs"))).alias("docs_over"), kept.alias("tokens_kept"), (total(F.col("n_tokens") * F.col("n_docs")) - kept).alias("tokens_lost"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents").select("text")))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
