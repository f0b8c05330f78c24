"""Queries that once stopped short of the whole job, against the whole results."""

import os

import pytest

from orthant.functions import expr as E
from orthant.operators import knn
from orthant.plans.catalog import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data not here")


# count_ordered, btree_order


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ordered_queries_reach_every_row(spark, sf):
    import duckdb

    folder = f"/root/testdata/{sf}"
    rows = f"'{folder}/embeddings.parquet'"
    assert QUERIES["count_ordered"](spark, folder).first().n == duckdb.sql(f"SELECT count(*) FROM {rows}").fetchall()[0][0]
    expected = duckdb.sql(f"SELECT vec_id, row_number() OVER (ORDER BY embedding, vec_id) AS place FROM {rows} ORDER BY place").fetchall()
    assert len(expected) > 100 and list(map(tuple, QUERIES["btree_order"](spark, folder).collect())) == expected


def test_places_over_parts_and_nulls(spark):
    rows = [(i, None if i % 7 == 0 else [float(i * 37 % 11), float(i % 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = list(map(tuple, knn.placed(df, E.order_by("embedding"), df["vec_id"]).select("vec_id", "place").collect()))
    assert found == [(i, n + 1) for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or [], r[0])))]
    assert knn.placed(df.where("false"), df["vec_id"]).collect() == []


# ivf_probe, ivf_iterative


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_index_searches_find_the_real_neighbours(spark, sf):
    folder = f"/root/testdata/{sf}"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = df.where("vec_id % 20 = 0")
    plain = knn.recall_at_k(QUERIES["ivf_probe"](spark, folder), knn.knn_join(asked, df, 10, metric="cosine")).first()[0]
    filtered = knn.recall_at_k(QUERIES["ivf_iterative"](spark, folder), knn.knn_join(asked, df.where("label = 3"), 10)).first()[0]
    print(f"recall {sf}: ivf_probe {plain:.4f}, ivf_iterative {filtered:.4f}")
    assert plain >= 0.9 and filtered >= 0.9
