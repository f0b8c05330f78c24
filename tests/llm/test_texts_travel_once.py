"""The n-gram join deals the texts with candidates out by one exchange."""

import random

import pytest

from orthant.llm import ngram_join


@pytest.mark.parametrize(("block", "keys"), [(250_000, 250_000), (60, 250_000), (60, 0)])
def test_texts_travel_once(spark, block, keys, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(8):
        body = [f"w{r.randrange(10_000)}" for _ in range(40)]
        for j in range(i + 1):
            rows.append((100 * i + j, " ".join([*body, *(["end"] if j % 2 else []), *([f"x{j}"] if j > 3 else [])])))
    rows += [(1, None), (2, ""), (103, rows[5][1])]
    sets = [{tuple((t or "").split()[k : k + 4]) for k in range(len((t or "").split()) - 3)} for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    expected = sorted((rows[a][0], min(rows[b][0] for b in range(len(rows)) if label[b] == label[a])) for a in range(len(rows)))

    plans, run = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "KEYS", keys)
    monkeypatch.setattr(ngram_join, "components", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or run(df, *a))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        found = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id int, text string"), block=block).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((x.doc_id, x.component_id) for x in found) == expected
    if keys:
        assert plans[-1].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plans[-1]


def test_sizes_of_any_length_are_packed():
    import numpy as np

    for sizes in ([3, 65_535], [3, 65_536]):
        names, owners = np.arange(5, dtype=np.uint64), np.array([0, 1, 1, 0, 1])
        [row] = ngram_join._by_bucket(np.zeros(5, np.int64), 1, names, owners, np.array([7, -9]), np.array(sizes))
        found = ngram_join._unpacked([row[1:]])
        assert [x.tolist() for x in found] == [names.tolist(), [7, -9, -9, 7, -9], [sizes[i] for i in owners]]
        assert len(row[4]) == (4 if max(sizes) < 65_536 else 8)
