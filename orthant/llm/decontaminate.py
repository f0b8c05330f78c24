"""Benchmark decontamination by a generalised suffix automaton.

Method: the words of all benchmark items build one generalised suffix automaton. A document's words
stream through it; at each word the automaton knows the longest item substring that ends there.
Where that length reaches `window` words, the last `window` words are a window of some item; items
of fewer words count as one window of their own length. Covered words form spans, which are removed
(with the whole document, where spans cover more than a given part of it).

Words that no item has, and neighbours that stand side by side in no item, end every match, so only
runs of known neighbours at least as long as the shortest window stream through the automaton.

Scale: no shuffle, and one map over the documents. Benchmark items come to the driver in blocks of at most
BLOCK_BYTES of text; each block's automaton is broadcast. A task with several blocks holds GROUP_BYTES of
texts and one automaton at a time, which it loads anew for every group, so a benchmark of any size keeps to
the same memory and a load is paid by much text.

Edge cases: null or empty texts have no words, no hits and are not contaminated; items without words,
with a null text or a null id are ignored; repeated item ids count once; repeated documents are
judged each for itself; other columns pass through: find_hits leaves out those that carry its results' names,
decontaminate none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import share
from ._util import map_arrow, table, text_chunks

WINDOW = 13
#: Benchmark text in one automaton, in bytes; a single longer item has one of its own.
BLOCK_BYTES = 1 << 20
#: Text that a task holds while it goes through several automata.
GROUP_BYTES = 16 << 20
_PAIR_BITS = 22
#: A-Z become a-z; bytes of no word become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """The generalised suffix automaton of (id, words) items, with what each state says of windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.word_ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.word_ids.setdefault(w, len(self.word_ids)) for w in item]) for name, item in items if item]
        for _, item in coded:
            last = 0
            for c in item:
                last = self._extend(last, c)
        n = len(self.next)
        self.shortest = min([window, *(len(item) for _, item in coded)])
        #: state -> the items that have its suffix of `window` words; of all states of such a length one holds them
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.top = [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[v] >= window:
                self.top[v] = v if self.length[self.link[v]] < window else self.top[self.link[v]]
        for name, item in coded:
            v = 0
            for at, c in enumerate(item):
                v = self.next[v][c]
                if at + 1 >= window:
                    self.windows.setdefault(self.top[v], set()).add(name)
            if len(item) < window:
                while self.length[self.link[v]] >= len(item):
                    v = self.link[v]
                self.short.setdefault(v, []).append((len(item), name))
        self.above = [0] * n  # the nearest shorter state that is a short item
        if self.short:
            for v in sorted(range(1, n), key=self.length.__getitem__):
                up = self.link[v]
                self.above[v] = up if up in self.short else self.above[up] if up > 0 else 0
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for _, item in coded:
            ids = np.array(item, np.int64)
            self.pairs[self.pair_slots(ids[:-1], ids[1:])] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    @staticmethod
    def pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)

    def code(self, texts: list[list[bytes]]) -> np.ndarray:
        """All texts' word ids (-1: in no item), each text followed by one -1."""
        get, size = self.word_ids.get, sum(map(len, texts)) + len(texts)
        return np.fromiter((i for t in texts for part in (map(get, t, repeat(-1)), (-1,)) for i in part), np.int64, size)

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """[start, end) of the stretches that can hold a window."""
        known = ids >= 0
        if self.shortest > 1:
            joined = known[:-1] & known[1:]
            joined[joined] = self.pairs[self.pair_slots(ids[:-1][joined], ids[1:][joined])]
            need = self.shortest - 1
        else:
            joined, need = known, 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= need
        extra = 1 if self.shortest > 1 else 0
        return zip(starts[long].tolist(), (ends[long] + extra).tolist())

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(last word, words, items) of every window that occurs in the run."""
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        v = matched = 0
        for at, c in enumerate(ids):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c not in nxt[v]:
                v = matched = 0
                continue
            v = nxt[v][c]
            matched += 1
            if matched >= window:
                yield at, window, self.windows[self.top[v]]
            if short:
                u = v if v in short else self.above[v]
                while u > 0:
                    for size, name in short[u]:
                        if size <= matched:
                            yield at, size, {name}
                    u = self.above[u]


def automata(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Automaton]:
    """An automaton for each block of items; each block of at most block_bytes (or of one item)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("body")).where("name is not null and body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    for block in range(max(1, blocks)):
        rows = items if blocks <= 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        yield Automaton([(r.name, words(r.body.encode("utf-8", "surrogatepass"))) for r in rows.toLocalIterator()], window)


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_RESULT = {"n_words": T.LongType(), "n_hit": T.LongType(), "hit_items": T.ArrayType(T.StringType()), "hit_spans": _SPANS}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finder(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, block_bytes: int) -> tuple[list, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """The columns of docs that stay, and what adds the columns _RESULT to their batches."""
    blocks = [share(docs.sparkSession, automaton) for automaton in automata(benchmark, item_id, item_text, window, block_bytes)]
    kept = [f for f in docs.schema if f.name not in _RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text) if len(blocks) == 1 else _groups(batches):
            sizes, spans, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for shared in blocks:
                at = 0
                for part in text_chunks([batch], text):
                    texts = [words(t) if t else [] for t in part.column(text).cast(pa.binary()).to_pylist()]
                    sizes[at : at + len(texts)] = [len(t) for t in texts]
                    _find(shared.value, texts, spans[at : at + len(texts)], found[at : at + len(texts)])
                    at += len(texts)
                if len(blocks) > 1:
                    shared.drop()
            merged = [_merged(s) for s in spans]
            results = [
                pa.array(sizes),
                pa.array([sum(b - a + 1 for a, b in s) for s in merged], pa.int64()),
                pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                pa.array([[{"first": a, "last": b} for a, b in s] for s in merged], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *results], [*(f.name for f in kept), *_RESULT])

    return kept, run


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words in windows), hit_items (sorted ids) and hit_spans (word spans, both ends in)."""
    kept, run = _finder(docs, benchmark, text, item_id, item_text, window, block_bytes)
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in _RESULT.items())])
    return map_arrow(docs.select(*(F.col(f"`{f.name}`") for f in kept)), run, schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GROUP_BYTES."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= GROUP_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _find(automaton: Automaton, texts: list[list[bytes]], spans: list[list[tuple[int, int]]], found: list[set[str]]) -> None:
    """Adds to each text's spans and items what the automaton finds."""
    ids = automaton.code(texts)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    for start, end in automaton.runs(ids):
        doc = int(np.searchsorted(bounds, start, "right"))
        base = start - (int(bounds[doc - 1]) if doc else 0)
        for at, size, items in automaton.stream(ids[start:end].tolist()):
            last, first = base + at, base + at - size + 1
            own = spans[doc]
            if own and own[-1][0] <= first <= own[-1][1] + 1:
                own[-1] = (own[-1][0], max(last, own[-1][1]))
            else:
                own.append((first, last))
            found[doc] |= items


def _cut(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, text):
        out = []
        for body, spans in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("hit_spans").to_pylist()):
            if body and spans:
                places = [m.span() for m in _WORD.finditer(body)]
                parts, at = [], 0
                for s in spans:
                    parts.append(body[at : places[s["first"]][0]])
                    at = places[s["last"]][1]
                body = b"".join([*parts, body[at:]])
            out.append(body)
        at = batch.schema.get_field_index(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()).cast(batch.schema.field(at).type))


def cut_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the words of its hit_spans and what stands between them."""
    return map_arrow(df, lambda it: _cut(it, text), df.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most_covered: float = 0.5) -> DataFrame:
    """docs without hit spans; a document of which more than most_covered is hit goes. Columns as in docs."""
    rows = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("_row"))
    kept, find = _finder(rows, benchmark, "_text", "item_id", "text", window, BLOCK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # one map: a second would hold a second Python worker a task
        left = (b.filter(pc.less_equal(b.column("n_hit").cast(pa.float64()), pc.multiply(b.column("n_words").cast(pa.float64()), max(0.0, most_covered)))) for b in find(batches))
        for batch in _cut(left, "_text"):
            yield batch.select([f.name for f in kept])

    return map_arrow(rows, run, T.StructType(kept)).select(*((F.col("_text") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)
),
m AS (SELECT doc_id, p, k, item FROM dw JOIN iw USING (win, k)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""

QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES = {"op2_decontaminate": ORACLE}
