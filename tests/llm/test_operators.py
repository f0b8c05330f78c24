"""The operators against brute-force versions, the public tokenizer and held-out labels."""

import base64
import hashlib
import json
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.llm import byte_bpe, decontaminate, mil_quality, ngram_join, quality_rules, suffix_dedup, token_counts, tool_calls, toxicity
from orthant.llm.components import components
from orthant.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not here")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


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


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    own = QUERIES[name](spark, SMALL)
    names = sorted(own.columns)
    expected = con.execute(ORACLES[name])
    order = [expected.description[i][0] for i in range(len(expected.description))]
    other = [tuple(r[order.index(c)] for c in names) for r in expected.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in own.collect()))) == sorted(map(repr, other))


# 7: byte-level BPE


def test_bpe_equals_the_public_tokenizer(docs):
    encoding, codec = tiktoken_encoding(), byte_bpe.ByteBpe(byte_bpe.default_ranks_path())
    random.seed(5)
    odd = ["".join(random.choice(["a", "b", "  ", "\n", "é", "日", "\U0001f600", "1", "\x1c", "\x00", "!!", "the", "ing", chr(random.randrange(32, 0x3000))]) for _ in range(random.randrange(300))) for _ in range(300)]
    texts = [*docs.text, *odd, None, "", "x" * 3000, "ab" * 2000, " " * 2000, "<|endoftext|>", "ü" * 500]
    flat, counts = codec.encode(texts)
    expected = [encoding.encode_ordinary(t or "") for t in texts]
    assert counts.tolist() == [len(e) for e in expected] and flat.tolist() == [i for e in expected for i in e]
    decoded, sizes = codec.decode(flat, counts)
    assert decoded.tobytes() == "".join(t or "" for t in texts).encode() and sizes.sum() == len(decoded)


def test_bpe_rows_and_heap_agree():
    codec = byte_bpe.ByteBpe(byte_bpe.default_ranks_path())
    for piece in ("abababababab" * 10, "the" * 60, "aaaaaaaaaaaaaaaaaaaaaaaaa", "zqxj" * 50):
        raw = codec.byte_ids[np.frombuffer(piece.encode(), np.uint8)][None, :]
        out, counts = codec.merge_rows(raw.copy())
        assert out[0, : counts[0]].tolist() == codec.merge_long(piece.encode())


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([(1, "Hello wörld"), (2, None), (3, "")], "id int, text string")
    back = byte_bpe.decode(byte_bpe.encode(df)).orderBy("id").collect()
    assert [bytes(r.decoded) for r in back] == ["Hello wörld".encode(), b"", b""] and [len(r.ids) > 0 for r in back] == [True, False, False]


# 2: decontamination


def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for name, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(LOWER))
        k = min(window, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_automaton_finds_every_window(spark, block):
    random.seed(3)
    pick = lambda n: " ".join(random.choice("abcd") for _ in range(n))
    items = [(i, pick(random.randrange(0, 9))) for i in range(12)]
    texts = [(i, pick(random.randrange(0, 40))) for i in range(60)]
    found = decontaminate.find_hits(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), window=4, block_bytes=block)
    for r in found.collect():
        assert (r.n_words, r.n_hit, r.hit_items) == brute_hits(r.text, items, 4)


def test_a_large_benchmark_takes_one_map(spark):
    r = random.Random(5)
    items = [(i, " ".join(f"w{r.randrange(30_000)}" for _ in range(9_000))) for i in range(90)]
    texts = [(i, " ".join(f"w{r.randrange(30_000)}" for _ in range(50)) + " " + " ".join(items[i][1].split()[100:130])) for i in range(0, 90, 7)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert sum(len(t) for _, t in items) > 5_000_000
    found = decontaminate.find_hits(spark.createDataFrame(texts, "doc_id int, text string"), bench, block_bytes=2 << 20)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {x.doc_id: (x.n_words, x.n_hit, x.hit_items) for x in found.collect()} == {i: brute_hits(t, [items[i]], 13) for i, t in texts}


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "keep this, One two THREE four; and that " + "more words " * 9), (2, "one two three four"), (3, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id int, text string")
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, window=4).collect()}
    assert set(left) == {1, 3} and left[1].startswith("keep this, ; and that") and left[3] is None


# 3: n-gram Jaccard join


def test_trie_join_and_prefixes():
    rng, r = np.random.default_rng(0), random.Random(0)
    for _ in range(60):
        sets = []
        for _ in range(r.randrange(1, 4)):
            base = rng.integers(0, 2**60, r.randrange(1, 60)).astype(np.uint64)
            for _ in range(r.randrange(1, 10)):
                x = base.copy()
                for _ in range(r.randrange(0, max(1, len(x) // 5) + 1)):
                    x[r.randrange(len(x))] = rng.integers(0, 2**60)
                sets.append(np.unique(x[: max(1, len(x) - r.randrange(0, 5))]))
        sets = list({x.tobytes(): x for x in sets}.values())
        inside = lambda a, b: len(np.intersect1d(a, b))
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * inside(sets[i], sets[j]) >= 85 * (len(sets[i]) + len(sets[j]) - inside(sets[i], sets[j]))]
        assert groups_of(len(sets), links) == groups_of(len(sets), ngram_join.forest(sets))
        side = rng.integers(0, 2, len(sets))
        assert groups_of(len(sets), [p for p in links if side[p[0]] != side[p[1]]]) == groups_of(len(sets), ngram_join.forest(sets, side))
        p, common = ngram_join.bounds_of([len(x) for x in sets])
        assert (common >= 1).all() and all(len(np.intersect1d(sets[i][: p[i]], sets[j][: p[j]])) >= max(common[i], common[j]) for i, j in links)


@pytest.mark.parametrize("num, den", [(4, 5), (85, 100), (1, 2), (1, 1)])
def test_prefixes_of_linked_sets(num, den):
    rng, r = np.random.default_rng(1), random.Random(1)
    p, common = ngram_join.bounds_of(np.arange(1, 5000), num, den)
    assert (np.diff(np.arange(1, 5000) - p) >= 0).all() and (common >= 1).all() and (common <= p).all()
    for _ in range(2000):
        both = rng.integers(0, 2**60, r.randrange(1, 200)).astype(np.uint64)
        rest = [rng.integers(0, 2**60, r.randrange(0, len(both) // 2 + 1)).astype(np.uint64) for _ in range(2)]
        x, y = (np.unique(np.concatenate([both, e])) for e in rest)
        if den * len(both) >= num * (len(x) + len(y) - len(both)):
            (p, q), common = ngram_join.bounds_of([len(x), len(y)], num, den)
            assert len(np.intersect1d(x[:p], y[:q])) >= max(common)


@pytest.mark.parametrize("holders", [ngram_join.HOLDERS, 1])
def test_hot_elements_lose_no_link(spark, monkeypatch, holders):
    """Groups of near copies that share a passage with each other; elements of more holders than one travel once."""
    monkeypatch.setattr(ngram_join, "HOLDERS", holders)
    r = random.Random(7)
    word = lambda: f"w{r.randrange(100_000)}"
    common, texts = [word() for _ in range(40)], []
    for _ in range(30):
        base = [word() for _ in range(60)] + common * r.randrange(2)
        for _ in range(r.randrange(1, 6)):
            own = list(base)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    roots = groups_of(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (ngram_join.BLOCK, 150):
        found = {x.doc_id: x.component_id for x in ngram_join.jaccard_groups(df, n=5, num=80, den=100, block=block).collect()}
        assert [found[i] for i in range(len(texts))] == roots


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 200])
def test_jaccard_groups(spark, docs, block):
    sets = []
    for t in docs.text:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    roots, ids = groups_of(len(sets), links), docs.doc_id.tolist()
    least = {}
    for i, c in enumerate(roots):
        least[c] = min(least.get(c, ids[i]), ids[i])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(spark.read.parquet(f"{SMALL}/documents.parquet"), block=block).collect()}
    assert links and found == {ids[i]: (len(sets[i]), least[roots[i]]) for i in range(len(sets))}


def test_components(spark):
    random.seed(1)
    chain = [(i, i + 1) for i in range(200)]
    links = chain + [(random.randrange(1000, 1300), random.randrange(1000, 1300)) for _ in range(200)] + [(5000, 5000 + i) for i in range(1, 400)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = groups_of(6000, links)
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert found == {x: roots[x] for x in nodes}


# 5: suffix arrays


def test_suffix_array():
    random.seed(2)
    for _ in range(200):
        b = bytes(random.choice(b"abc\x00") for _ in range(random.randrange(1, 50)))
        assert suffix_dedup.two_stage_suffix_array(b, 100).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("portion", [2, 5, 30_000])
def test_suffix_array_in_portions(monkeypatch, portion):
    monkeypatch.setattr(suffix_dedup, "COPIED", portion)
    for seed in range(100):
        r = random.Random(seed)
        alphabet = r.choice([1, 2, 256])
        b = bytes(r.randrange(alphabet) for _ in range(r.randint(1, 120))) * r.choice([1, 3])
        order = suffix_dedup.two_stage_suffix_array(b, 1000)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for most in (7, 8, 20):
            common = [len(os.path.commonprefix([b[x : x + most], b[y : y + most]])) for x, y in zip(order.tolist(), order.tolist()[1:])]
            assert suffix_dedup.common_prefixes(np.frombuffer(b, np.uint8), order, most).tolist() == common


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        out.append(bytes(b for i, b in enumerate(t) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats(spark, hot):
    random.seed(4)
    words = lambda n: " ".join(random.choice(["alpha", "beta", "gamma", "délta", "x"]) + str(random.randrange(50)) for _ in range(n))
    shared = [words(30) for _ in range(4)]
    texts = [words(random.randrange(0, 30)) + (random.choice(shared) if random.random() < 0.6 else "") + words(random.randrange(0, 20)) for _ in range(60)]
    texts += [texts[0], "abc" * 200, "", "z" * 130, "q" * 9000 + "r", "0123456789" * 12, "x" * 99, "lonely period of text, " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, length=100, gram=32, hot=hot).collect()}
    assert [found[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 100)


def brute_spans(texts, length, words):
    """[first, last] of what repeats, where it holds so many words."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, spans = np.zeros(len(t) + 2, bool), []
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).tolist()
        out.append([(a, b - 1) for a, b in zip(edges[::2], edges[1::2]) if len(t[a:b].split()) >= words])
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_shorter_repeats_are_reported_and_words_counted(spark, hot):
    r = random.Random(11)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "délta", "x"]) + str(r.randrange(50)) for _ in range(n))
    shared = [words(n) for n in (9, 12, 15, 20, 30)]
    texts = [words(r.randrange(0, 30)) + " ".join(r.sample(shared, r.randrange(3))) + words(r.randrange(0, 20)) for _ in range(80)]
    texts += [texts[0], "abc" * 200, "", "z" * 130, shared[1], shared[1], shared[2] + "!", "lonely period of text, " * 30, "q" * 9000 + "r"]
    raw = [t.encode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {x.doc_id: x for x in suffix_dedup.remove_repeats(df, length=120, gram=32, hot=hot, report=(70, 10)).collect()}
    as_pairs = lambda spans: [(s["first"], s["last"]) for s in spans]
    assert [as_pairs(found[i].spans) for i in range(len(texts))] == brute_spans(raw, 120, 0)
    assert [as_pairs(found[i].repeats) for i in range(len(texts))] == brute_spans(raw, 70, 10)
    assert [bytes(found[i].kept) for i in range(len(texts))] == brute_repeats(raw, 120)
    few = {x.doc_id: as_pairs(x.spans) for x in suffix_dedup.remove_repeats(df, length=70, gram=32, hot=hot, least_words=10).collect()}
    assert [few[i] for i in range(len(texts))] == brute_spans(raw, 70, 10)


def test_repeats_of_documents(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op5_suffix_dedup"](spark, SMALL).collect()}
    for i, kept, text in zip(docs.doc_id, brute_repeats([t.encode() for t in docs.text], 400), docs.text):
        assert (found[i].n_bytes, found[i].n_removed, found[i].kept_sha256) == (len(text.encode()), len(text.encode()) - len(kept), hashlib.sha256(kept).hexdigest())
    for i, spans in zip(docs.doc_id, brute_spans([t.encode() for t in docs.text], suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_WORDS)):
        assert found[i].n_passage_bytes == sum(b - a + 1 for a, b in spans)


# 1: quality rules


def test_binomial_tail(spark):
    from math import comb

    rows = [(n, k) for n in (1, 10, 500, 3000) for k in (0, 1, 2, 9) if k <= n]
    for limit in (0.005, 0.2):
        for r in spark.createDataFrame(rows, "n long, k long").select("n", "k", quality_rules._tail(limit).alias("p")).collect():
            exact = sum(comb(r.n, i) * limit**i * (1 - limit) ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * limit else 1.0
            assert r.p == pytest.approx(exact, rel=1e-9)


def test_false_rejections_stay_limited(spark):
    found = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    r = found.where("quality = 1 and not base_failed").agg(F.avg((~F.col("kept")).cast("int")).alias("good")).first()
    assert r.good <= quality_rules.LIMIT


# 4 and 9: held-out accuracy


def accuracy(spark, name, label, sf="/root/testdata/sf0.1"):
    found = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, score = found[label].to_numpy(), found.score
    ranks, ones = score.rank().to_numpy(), (y == 1).sum()
    auc = (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))
    return auc, (found.predicted.to_numpy() == y).mean(), found


def test_quality_on_held_out_rows(spark):
    auc, right, found = accuracy(spark, "op9_quality_mil", "quality")
    assert auc > 0.98 and right > 0.97 and (found[found.quality == 1].predicted == 0).mean() < 0.01


def test_toxicity_on_held_out_rows(spark):
    auc, right, found = accuracy(spark, "op4_toxicity", "toxic")
    assert auc > 0.9 and right > 0.95 and (found[found.toxic == 0].predicted == 1).mean() < 0.02


def test_levenshtein_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, z in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != z)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(40):
        terms = [(t, r.random() < 0.3) for t in {"".join(r.choice("abcd") for _ in range(r.randrange(3, 12))) for _ in range(6)}]
        automaton = toxicity.LexiconAutomaton(terms)
        classes = automaton.classes()
        words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 12))) for _ in range(150)] + [t[:i] + "b" + t[i + 1 :] for t, _ in terms for i in range(len(t))]
        codes, sizes = np.array([classes[ord(c)] for w in words for c in w]), np.array([len(w) for w in words])
        got = {w: c for w, _, c in zip(*(x.tolist() for x in automaton.run(codes, np.cumsum(sizes) - sizes, sizes)))}
        for i, w in enumerate(words):
            near = min((distance(w, t) for t, stem in terms if not stem and distance(w, t) <= toxicity.edits(t)), default=None)
            assert got.get(i) == (0 if any(stem and w.startswith(t) for t, stem in terms) else near)


def test_misspelt_and_quoted_terms():
    clean = [f"plain text about gardens and rivers number {i}" for i in range(200)]
    bad = [f"you are a worthless person number {i}" if i % 2 else f"what a horrible liar number {i}" for i in range(60)]
    terms, weights = toxicity.learn_terms(clean + bad, np.array([0] * 200 + [1] * 60))
    assert {"worthless"} & {t for t, _ in terms} or any(t.startswith("wor") for t, _ in terms)
    model = toxicity.ToxicityModel([("worthless", False)], [4.0], set(), set())
    plain, misspelt, quoted, none = model.score(["you are worthless", "you are worthles", 'he said "you are worthless" to me', "a calm day"])
    assert plain > misspelt > 0.5 > none and quoted < plain


# 8, 10 and the pipeline


def test_token_counts(spark, docs):
    encoding = tiktoken_encoding()
    lengths = sorted(len(encoding.encode_ordinary(t)) for t in docs.text)
    found = QUERIES["op8_token_counts"](spark, SMALL)
    for r in found.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert (r.docs_at_most, r.docs_over) == (sum(x <= r.n_tokens for x in lengths), sum(x > r.n_tokens for x in lengths))
        assert (r.tokens_at_most, r.tokens_over) == (sum(x for x in lengths if x <= r.n_tokens), sum(x for x in lengths if x > r.n_tokens))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
    assert token_counts.quantile(found, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]
    at = token_counts.at_limit(found, 333).first()
    assert (at.docs_over, at.tokens_kept, at.tokens_lost) == (sum(x > 333 for x in lengths), sum(min(x, 333) for x in lengths), sum(max(0, x - 333) for x in lengths))


def test_tool_calls(spark):
    call = lambda i, name, args: "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"
    result = lambda i, content: "<tool_result>" + json.dumps({"id": i, "content": content}) + "</tool_result>"
    messages = spark.createDataFrame(
        [
            (1, 0, "assistant", call("b", "sum", {"y": "$a", "x": 1}) + call("a", "get", {"key": "k"})), (1, 1, "tool", result("a", "1")), (1, 2, "tool", result("b", 'say "2"') + result("zz", "lost")),
            (1, 3, "assistant", call("c", "sum", {"x": 1, "y": "$d"}) + call("d", "sum", {"x": -5, "y": "$c"}) + "<tool_call>no json</tool_call>"), (2, 0, "assistant", call("a", "none", {}) + call("e", "get", {"key": 5})),
        ],
        "conv_id long, turn long, role string, text string",
    )
    fields = spark.createDataFrame([("sum", "x", "number", True, 0.0), ("sum", "y", "string", True, None), ("get", "key", "string", True, None), ("get", "limit", "integer", False, None)], tool_calls._FIELDS_SQL)
    found = {(r.conv_id, r.call_id): r for r in tool_calls.link(tool_calls.embedded_calls(messages), tool_calls.embedded_results(messages), fields).collect()}
    assert {k: (r.level, r.result_turn, r.valid) for k, r in found.items()} == {
        (1, "b"): (1, 2, True), (1, "a"): (0, 1, True), (1, "c"): (None, None, True), (1, "d"): (None, None, False), (1, None): (0, None, False), (2, "a"): (0, None, False), (2, "e"): (0, None, False),
    }
    assert found[1, "b"].json == '{"call":{"arguments":{"x":1,"y":"$a"},"id":"b","name":"sum"},"result":"say \\"2\\""}'
    assert found[1, "c"].json.endswith('"result":null}')


def test_tool_call_ids_and_references(spark):
    """Only whole "$id" values refer; ids in texts and turn numbers are told apart; turns come after their conversation's first."""
    call = "<tool_call>" + json.dumps({"id": "0", "name": "get", "arguments": {"key": "$9 off", "list": ["$0"]}}) + "</tool_call>"
    rows = [(1, 0, "user", 'He paid "$100" today'), (1, 1, "assistant", call), (1, 2, "user", "$5"), (1, 3, "assistant", "done"), (2, 4, "user", '{"x": "$4"}')]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = tool_calls.exchanges(messages)
    calls, results = calls.unionByName(tool_calls.embedded_calls(messages)), results.unionByName(tool_calls.embedded_results(messages))
    linked = tool_calls.link(calls, results, spark.createDataFrame(list(tool_calls.EXCHANGE_FIELDS), tool_calls._FIELDS_SQL)).collect()
    found = sorted((r.conv_id, r.turn, json.loads(r.json)["call"]["name"], r.level, r.result_turn) for r in linked)
    assert found == [(1, 0, "user", 0, 1), (1, 1, "get", 0, None), (1, 2, "user", 1, 3), (2, 4, "user", 0, None)]
    chain = [(1, "id", i, 0, f"c{i}", "get", "{}", [f"c{i - 1}"] if i else []) for i in range(6)] + [(1, "id", 9, 0, "x", "get", "{}", ["c1", "c4"])]
    df = spark.createDataFrame(chain, "conv_id long, space string, turn long, place int, call_id string, name string, arguments string, refs array<string>")
    assert {r.call_id: r.level for r in tool_calls.levels(df).collect()} == {f"c{i}": i for i in range(6)} | {"x": 5}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SMALL}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SMALL)
    model = mil_quality.train(docs, labels)
    rows = docs.collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r, s in zip(rows, model.score([r.text.encode() for r in rows])) if s >= 0.3}
    rows = good.collect()
    first = stages[1](spark, good, SMALL)
    groups = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(good, n=5, num=80, den=100).collect()}
    assert sorted(r.doc_id for r in first.collect()) == sorted(set(groups.values()))
    rows = {r.doc_id: r.text for r in first.collect()}
    cut = stages[2](spark, spark.createDataFrame(first.collect(), docs.schema), SMALL)
    expected = {}
    for (i, t), spans in zip(rows.items(), brute_spans([t.encode() for t in rows.values()], 250, 50)):
        cuts = [-1, *(x for s in spans for x in s), len(t.encode())]
        expected[i] = b"".join(t.encode()[a + 1 : b] for a, b in zip(cuts[::2], cuts[1::2])).decode("utf-8", "ignore")
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {i: (t, len(t)) for i, t in expected.items()}
    clean = stages[3](spark, cut, SMALL)
    left = {i for i, t in expected.items() if (h := brute_hits(t, bench, 13))[1] <= 0.5 * h[0]}
    found = {r.doc_id: r.text for r in clean.collect()}
    assert set(found) == left and all(brute_hits(expected[i], bench, 13)[1] or found[i] == expected[i] for i in left)
    encoding = tiktoken_encoding()
    ids = {r.doc_id: (r.n_tokens, list(r.ids)) for r in stages[4](spark, clean, SMALL).collect()}
    assert ids == {i: (len(e := encoding.encode_ordinary(t)), e) for i, t in found.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(found)


def test_results_reach_over_blocks_of_turns(spark):
    rows = [(1, 0, "user", "ask"), *((1, t, "assistant", f"answer {t}") for t in range(1, 900)), (1, 900, "user", "again"), (1, 901, "assistant", "last"), (2, 5, "assistant", "no call")]
    calls, results = tool_calls.exchanges(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = results.groupBy("conv_id", "call_id").count().collect()
    assert sorted(map(tuple, found)) == [(1, "0", 899), (1, "900", 1)] and calls.count() == 2
