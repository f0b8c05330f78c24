"""From documents to token ids: five stages, each an operator of orthant.llm on all that its predecessor kept.

run(spark, sf_dir) writes every stage's rows as Parquet to the shared folder (spark.checkpoint.dir) and reads them
again, so a lost executor costs the tasks of one stage at most.

Edge cases: null and empty texts count as empty: the classifier scores them like any other, they have no near copies,
nothing is cut from them and they give no token ids; of repeated rows (equal id and text) one stays, documents that
share an id but not the text are told apart; null ids are an id like any other; empty tables give an empty result;
extra columns of any name pass through the first four stages as they are, and the last leaves them out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthant.llm import byte_bpe, decontaminate, mil_quality, ngram_join, suffix_dedup
from orthant.llm._util import checkpoint, checkpoint_dir, table


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and every column in one struct, so that no name of a caller's column meets an operator's own."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def unpacked(rows: DataFrame, docs: DataFrame, cut: bool = False) -> DataFrame:
    """The columns of docs again; cut: texts have changed, and n_chars with them."""
    changed = {"doc_id": F.col("doc_id"), "text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if cut else {})
    return rows.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model doesn't reject (score of 0.3 or more)."""
    model = mil_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = mil_quality.score(packed(docs), model, name="_score").where(F.col("_score") >= mil_quality.THRESHOLD)
    return unpacked(scored, docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their 5-word shingles) the document of least id; of its repeated rows one."""
    groups = ngram_join.jaccard_groups(docs, n=5, num=80, den=100)
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    counted = groups.groupBy("doc_id").agg(F.sum(is_first.cast("int")).alias("rows"))
    other = checkpoint(counted.where("rows <> 1"))  # ids of copies, which go, and of repeated rows; most have neither
    gone, again = other.alias("o"), other.where("rows > 1").alias("o")
    if other.count() <= ngram_join.KEYS:
        gone, again = F.broadcast(gone), F.broadcast(again)
    rows, same = packed(docs).alias("d"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id"))
    repeated = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return unpacked(rows.join(gone, same, "left_anti").unionByName(repeated), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and 250 bytes or more that stand elsewhere too."""
    done = suffix_dedup.remove_repeats(packed(docs), length=suffix_dedup.PASSAGE, gram=suffix_dedup.PASSAGE_GRAM, least_words=suffix_dedup.PASSAGE_WORDS, keep=("_row",), as_text=True)
    return unpacked(done.select("doc_id", F.col("kept").alias("text"), "_row"), docs, cut=True)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that mostly consist of them go."""
    clean = decontaminate.decontaminate(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(clean, docs, cut=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    encoded = byte_bpe.encode(docs)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("byte-level BPE", encode),
]

#: SQL can't train the classifier; tests/llm compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        path = f"{folder}/{number}"
        done.write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # its rows are in the new table
            place = spark._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        before = path
    return docs
