"""What only larger tables showed."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orthant.functions import expr as E
from orthant.operators import hnsw, ivf, knn, metrics
from orthant.plans.catalog import ORACLES, QUERIES


def random_rows(spark, n, seed=0):
    values = np.random.default_rng(seed).normal(size=(n, 64)).astype(np.float32)
    return spark.createDataFrame(pa.table({"vec_id": range(n), "embedding": pa.array(values.tolist(), pa.list_(pa.float32()))}))


def bits_of(df):
    return df.select("vec_id", E.binary_quantize("embedding").alias("embedding"))


def found(rows):
    return sorted((r.query_id, r.rank, r.vec_id) for r in rows.collect())


# cast_decimal_to_vector, cast_int_to_vector


@pytest.mark.parametrize("name", ["cast_decimal_to_vector", "cast_int_to_vector"])
def test_casts_multiply_in_single_precision(spark, tmp_path, name):
    import duckdb

    hundredths = np.arange(-96, 96, dtype=np.float32) / np.float32(100)
    values = np.concatenate([hundredths, np.nextafter(hundredths, np.float32(9)), np.nextafter(hundredths, np.float32(-9))]).reshape(-1, 64)
    path = tmp_path / "embeddings.parquet"
    pq.write_table(pa.table({"vec_id": range(len(values)), "embedding": pa.array(values.tolist(), pa.list_(pa.float32())), "label": [0] * len(values)}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    own = QUERIES[name](spark, str(tmp_path)).select("vec_id", "pos", "val").collect()
    assert sorted(map(tuple, own)) == sorted(con.execute(ORACLES[name]).fetchall())


# knn_join_*, half_knn_join, ivf_half_full_probe, ivf_bit_full_probe, recall


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1", "ivf l2", "ivf hamming"])
def test_distances_come_in_blocks(spark, monkeypatch, metric):
    """No matrix of distances grows with the queries, and the rows are the same."""
    metric, indexed = metric.split()[-1], metric.startswith("ivf")
    plain, most = metrics.METRICS[metric], 1 << 20

    def near(q, x):
        made = plain.near(q, x)
        assert made.size <= most, f"{made.shape} distances at once"
        return made

    df = random_rows(spark, 2500)
    df = bits_of(df) if metric == "hamming" else df
    asked = df.where("vec_id % 4 <> 0")
    expected = found(knn.knn_join(asked.where("vec_id % 50 = 1"), df.repartition(7), 5, metric=metric))
    for module in (knn, ivf):
        monkeypatch.setattr(module, "metric_of", lambda name, kind: replace(plain, near=near))
    own = ivf.IvfIndex.build(df.coalesce(1), metric=metric, lists=2).search(asked, 5, probes=2) if indexed else knn.knn_join(asked, df.coalesce(1), 5, metric=metric)
    assert [x for x in found(own) if x[0] % 50 == 1] == expected and len(expected) == 250


def test_rows_without_a_distance_give_way(spark):
    rows = [(i, [0.0, 0.0]) for i in range(3000)] + [(3000, [1.0, 0.5]), (3001, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    assert [x[2] for x in found(knn.knn_join(df.where("vec_id = 3001"), df, 3, metric="cosine"))] == [3001, 3000, 0]


def test_kernels_of_bits():
    r = np.random.default_rng(1)
    q, x = (metrics.BitBatch(np.full(n, 130), r.integers(0, 2**63, (n, 3)).astype(np.uint64) << np.uint64(1)) for n in (5, 9))
    ones = lambda words: bin(int(words[0]) | int(words[1]) << 64 | int(words[2]) << 128).count("1")
    apart = [[ones(a ^ b) for b in x.words] for a in q.words]
    both = [[ones(a & b) / ones(a | b) for b in x.words] for a in q.words]
    hamming, jaccard = metrics.METRICS["hamming"], metrics.METRICS["jaccard"]
    assert hamming.near(q, x).tolist() == apart and np.allclose(jaccard.near(q, x), 1 - np.array(both))
    i, j = np.arange(5), np.arange(5) + 3
    assert (hamming.exact(q.take(i), x.take(j)) == hamming.near(q, x)[i, j]).all() and (jaccard.exact(q.take(i), x.take(j)) == jaccard.near(q, x)[i, j]).all()


def test_pairs_of_bits_are_scored_together():
    """ivf_bit_full_probe: every pair once was two batches of its own, and ties make many pairs."""
    class Counted(metrics.BitBatch):
        taken = 0

        def take(self, which):
            Counted.taken += 1
            return super().take(which)

    words = np.arange(500, dtype=np.uint64)[:, None] << np.uint64(32)
    batch = Counted(np.full(500, 64), words)
    for metric in ("hamming", "jaccard"):
        metrics.METRICS[metric].exact(batch, batch)
    assert Counted.taken < 10


# hnsw_full, hnsw_bits, hnsw_sparse, hnsw_search, hnsw_half, hnsw_iterative


def test_wide_beams_score_few_pairs(spark, monkeypatch):
    """hnsw_full: what a beam finds is not scored, or held, all at once."""
    plain, most = metrics.METRICS["cosine"], 1 << 13

    def exact(q, x):
        assert len(q) <= most, f"{len(q)} pairs at once"
        return plain.exact(q, x)

    df = random_rows(spark, 900)
    expected = found(knn.knn_join(df, df, 10, metric="cosine"))
    monkeypatch.setattr(hnsw, "metric_of", lambda name, kind: replace(plain, exact=exact))
    assert found(hnsw.HnswIndex.build(df, metric="cosine", shard_rows=500).search(df, 10, ef_search=1000)) == expected


@pytest.mark.parametrize("metric", ["jaccard", "l2", "l1"])
def test_graphs_are_searched_for_many_queries_at_once(spark, monkeypatch, metric):
    """hnsw_bits, hnsw_search, hnsw_half: distances of one query to a few elements at a time took minutes."""
    plain = metrics.METRICS[metric]

    def near(q, x):
        assert len(q) > 1, "a query alone"
        return plain.near(q, x)

    df = random_rows(spark, 300)
    df = bits_of(df) if metric == "jaccard" else df
    expected = knn.knn_join(df.where("vec_id < 40"), df, 5, metric=metric).collect()
    monkeypatch.setattr(hnsw, "metric_of", lambda name, kind: replace(plain, near=near))
    own = hnsw.HnswIndex.build(df, metric=metric).search(df.where("vec_id < 40"), 5, ef_search=100)
    assert knn.recall_at_k(own, spark.createDataFrame(expected)).first()[0] >= 0.9


def plain_beam(links, near, start, ef):
    """One query, with sorted lists: (distance, element) of the beam."""
    seen, todo, best = {start}, [(near[start], start)], [(near[start], start)]
    while todo:
        d, i = todo.pop(0)
        if len(best) >= ef and d > best[-1][0]:
            break
        for j in links.get(i, ()):
            if j not in seen:
                seen.add(j)
                if len(best) < ef or near[j] < max(best)[0]:
                    todo = sorted([*todo, (near[j], j)])
                    best = sorted([*best, (near[j], j)])
                    if len(best) > ef:
                        best.remove(min(x for x in best if x[0] == max(best)[0]))
    return {j for _, j in best}


@pytest.mark.parametrize("ef", [1, 4, 25])
def test_beams_of_blocks_are_those_of_single_queries(ef):
    r = np.random.default_rng(ef)
    bits = metrics.BitBatch(np.full(260, 12), r.integers(0, 2**12, (260, 1)).astype(np.uint64) << np.uint64(52))  # many ties
    metric = metrics.METRICS["hamming"]
    graph = hnsw.Graph.build(bits, np.arange(260), metric, 4, 16, 0)
    near = metric.near(bits, graph.batch)
    element, distance = graph.found(near, ef, graph.tables())
    for q in range(260):
        start = graph.entry
        for layer in range(len(graph.links) - 1, 0, -1):
            start = min(plain_beam(graph.links[layer], near[q], start, 1))
        assert set(element[q][distance[q] < np.inf].tolist()) == plain_beam(graph.links[0], near[q], start, ef)


def test_sparse_graphs_are_read_once():
    rows = [(np.array([1, i + 2]), np.array([1.0, i + 1.0])) for i in range(30)]
    graph = hnsw.Graph.build(metrics.SparseBatch(np.full(30, 64), rows), np.arange(30), metrics.METRICS["l2"], 4, 16, 0)
    again = hnsw.Graph.unpack(graph.pack())
    assert [(i.tolist(), v.tolist()) for i, v in again.batch.rows] == [(i.tolist(), v.tolist()) for i, v in rows]
    assert all(i.base is again.batch.rows[0][0].base for i, _ in again.batch.rows)


def test_filtered_scans_pass_on_k_rows_a_query(spark, monkeypatch):
    """hnsw_iterative: the filter comes before the choice of k rows, in the task; results are those of a scan of all that is left."""
    passed = spark.sparkContext.accumulator(0)
    rows_of = hnsw._rows

    def counted(names, query, *rest):
        passed.add(len(query))
        return rows_of(names, query, *rest)

    df = random_rows(spark, 600)
    index = hnsw.HnswIndex.build(df.where("vec_id < 500"), shard_rows=600)
    index.delete(df.where("vec_id < 50"))
    index.insert(df.where("vec_id < 20 OR vec_id >= 500"))
    left = df.where("(vec_id < 20 OR vec_id >= 50) AND vec_id % 3 <> 0")
    expected = found(knn.knn_join(df.where("vec_id < 30"), left, 4))
    monkeypatch.setattr(hnsw, "_rows", counted)
    for options in ({"ef_search": 600}, {"ef_search": 20, "iterative": "strict_order"}):
        own = index.search(df.where("vec_id < 30"), 4, allowed=df.where("vec_id % 3 <> 0"), **options)
        assert options["ef_search"] == 20 or found(own) == expected
        assert own.groupBy("query_id").agg(F.count("vec_id").alias("n")).where("n = 4").count() == 30
    assert 0 < passed.value < 2000  # 500 rows a query once passed
