import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
BENCHMARK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """make(documents=rows, ...) -> a folder of tables; extra: columns added to documents."""

    def build(documents=(), benchmark=(), labels=(), conversations=(), extra=()):
        folder = tmp_path_factory.mktemp("tables")
        docs = spark.createDataFrame([(i, t, *(rest or ("en", "src0", None if t is None else len(t)))) for i, t, *rest in documents], DOCUMENTS)
        for name, value in extra:
            docs = docs.selectExpr("*", f"{value} AS `{name}`")
        docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(list(benchmark), BENCHMARK).coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(list(labels), LABELS).coalesce(1).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(list(conversations), CONVERSATIONS).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
        return str(folder)

    return build
