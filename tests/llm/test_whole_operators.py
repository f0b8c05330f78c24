"""Operators that once stopped short of the whole job, against brute force."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from orthant.llm import license_scan, ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MEDIUM = "/root/testdata/sf0.01"


def groups_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# pipeline: near copies


def brute_groups(texts, n, num, den):
    """Sizes of the sets and the least linked position of each text."""
    sets, holders, links = [], defaultdict(list), []
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        own = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        shared = defaultdict(int)
        for s in own:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        links += [(i, j) for j, both in shared.items() if den * both >= num * (len(own) + len(sets[j]) - both)]
        sets.append(own)
    return [len(s) for s in sets], groups_of(len(sets), links)


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="test data not here")
def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = docs.collect()
    sizes, roots = brute_groups([r.text for r in rows], 5, 80, 100)
    least = defaultdict(lambda: 2**60)
    for r, c in zip(rows, roots):
        least[c] = min(least[c], r.doc_id)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs, n=5, num=80, den=100).collect()}
    assert found == {r.doc_id: (size, least[c]) for r, size, c in zip(rows, sizes, roots)}
    assert len(set(roots)) < len(set(brute_groups([r.text for r in rows], 4, 85, 100)[1]))
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, MEDIUM).collect()) == sorted(least.values())


@pytest.mark.parametrize("num, den", [(80, 100), (95, 100)])
def test_trie_join_and_prefixes_at_a_threshold(num, den):
    rng, r = np.random.default_rng(0), random.Random(0)
    for _ in range(30):
        sets = []
        for _ in range(r.randrange(1, 4)):
            base = rng.integers(0, 2**60, r.randrange(1, 60)).astype(np.uint64)
            for _ in range(r.randrange(1, 10)):
                x = base.copy()
                for _ in range(r.randrange(0, max(1, len(x) // 4) + 1)):
                    x[r.randrange(len(x))] = rng.integers(0, 2**60)
                sets.append(np.unique(x[: max(1, len(x) - r.randrange(0, 5))]))
        sets = list({x.tobytes(): x for x in sets}.values())
        inside = lambda a, b: len(np.intersect1d(a, b))
        links = [(i, j) for i in range(len(sets)) for j in range(i) if den * inside(sets[i], sets[j]) >= num * (len(sets[i]) + len(sets[j]) - inside(sets[i], sets[j]))]
        assert groups_of(len(sets), links) == groups_of(len(sets), ngram_join.forest(sets, None, num, den))
        side = rng.integers(0, 2, len(sets))
        assert groups_of(len(sets), [p for p in links if side[p[0]] != side[p[1]]]) == groups_of(len(sets), ngram_join.forest(sets, side, num, den))
        p, common = ngram_join.bounds_of([len(x) for x in sets], num, den)
        assert all(len(np.intersect1d(sets[i][: p[i]], sets[j][: p[j]])) >= max(common[i], common[j]) for i, j in links)


# op6_license_scan: wrapped notices, names of licences


def test_wrapped_notices_and_names(spark):
    import textwrap

    wrapped = [(label, "intro words\n\n" + "\n".join(" * " + x for x in textwrap.wrap(text, width)) + "\nmore words") for label, text in license_scan.TEMPLATES for width in (24, 72)]
    other = ["Released under the BSD License", "released\nunder the\nlicense", "This work is licensed under the GNU General Public License, version 4", None, "", "of the and is to this a " * 60]
    rows = [*enumerate(x for _, x in wrapped), *((1000 + i, x) for i, x in enumerate(other))]
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases={"no such phrase": "none"}).collect()}
    assert [found[i] for i in range(len(wrapped))] == [([label], 1.0) for label, _ in wrapped]
    assert [found[1000 + i] for i in range(len(other))] == [([], 0.0)] * len(other)


def test_only_ascii_is_lowered(spark):
    rows = [(1, "This wor\u212a is licensed under the GNU General Public License, version 3"), (2, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3"), (3, "Released under\nthe MIT\nLicense")]
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases={"no such phrase": "none"}).collect()}
    assert found[1][0] == ["gpl-3"] and abs(found[1][1] - 11 / 12) < 1e-12 and found[2] == (["gpl-3"], 1.0) and found[3] == (["mit"], 1.0)
