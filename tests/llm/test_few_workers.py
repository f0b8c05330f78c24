"""One Python worker a task, few links in one task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orthant.llm import components as C
from orthant.llm import decontaminate


def test_decontamination_is_one_map(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "one two x y z u v w 1 2 3"), (3, None), (4, "")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "b c d e f"), (2, "one two")], "item_id int, text string")
    done = decontaminate.decontaminate(docs, bench, window=4)
    assert {r.doc_id: r.text and r.text.split() for r in done.collect()} == {2: "x y z u v w 1 2 3".split(), 3: None, 4: ""}
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("small", [0, 50_000])
def test_components_of_links_that_a_map_makes(spark, small, monkeypatch):
    monkeypatch.setattr(C, "SMALL", small)
    pairs = lambda it: (pa.RecordBatch.from_arrays([b.column("x"), pa.array([x // 2 for x in b.column("x").to_pylist()], pa.int64())], ["a", "b"]) for b in it)
    rows = spark.range(1, 40).where("id <> 16").select(F.col("id").alias("x")).repartition(4)  # x - x // 2, and 1 - 0
    more = spark.createDataFrame([(100, 101), (7, 7), (101, 50)], "a long, b long")

    def root(x):
        return 16 if x == 16 or x // 2 == 16 else 0

    assert {r.node: r.component for r in C.components(rows, pairs, "bigint", more).collect()} == {x: root(x) for x in range(40)} | {50: 50, 100: 50, 101: 50}
