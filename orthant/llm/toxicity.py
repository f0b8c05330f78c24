"""Toxicity by a learnt lexicon, Levenshtein automata and scores of what stands around a hit.

Method. From labelled texts a lexicon is learnt: whole words and word beginnings (stems) that mark toxic texts,
picked one after another by the toxic texts that no earlier one covers. Its trie is intersected with the
Levenshtein automaton of each whole word (one edit from five letters, two from ten; stems must match exactly), and
the product is made deterministic. All words of a batch run through it together in numpy, a letter a step, and
leave it when no term is in reach. Near misses that clean texts use are no misspellings: such spellings, and terms
with several of them, are struck out. Every hit is scored in its window of WINDOW words either side: inside
quotation marks it counts as quoted, other hits beside it strengthen it. A logistic model weighs exact and
misspelt, quoted and unquoted hits, their density and their greatest number in a window.

The sample to learn from is bounded: SAMPLE labelled rows, about, of texts up to LONGEST characters, by a hash of
the key; rows whose crc32(key) mod 5 is 0 are never among them. Only the text is an input. Scoring is one pass over
all rows, whole texts, without a shuffle; the model is bounded by TERMS and broadcast.

Edge cases: null and empty texts have no hits and get the model's lowest score; repeated rows get the same score;
with no labels, or labels of one kind only, the lexicon is empty; other columns pass through, but one named `score`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import share
from ._util import held_out, map_arrow, portions, table, text_chunks, training_sample, worker_cache

SAMPLE, LONGEST = 5000, 100_000
TERMS = 120
WINDOW = 6
_OPEN, _CLOSE = "\"“„«‹‘", "\"”“»›’"
#: Weights that the model starts from and is drawn to: bias, exact, misspelt, quoted exact, quoted misspelt, most in a window, density.
PRIOR = np.array([-3.5, 3.0, 2.6, 0.5, 0.3, 0.5, 0.3])


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def letters(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W_]+", text)]


class LexiconAutomaton:
    """Deterministic product of a lexicon's trie and Levenshtein automata. terms: (text, whether a stem)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        children: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, int]]] = [[]]  # terms that end at a node, and their edits
        allowed = [0]
        for number, (term, stem) in enumerate(terms):
            v, most = 0, 0 if stem else edits(term)
            allowed[0] = max(allowed[0], most)
            for c in term:
                if c not in children[v]:
                    children[v][c] = len(children)
                    children.append({})
                    ends.append([])
                    allowed.append(0)
                v = children[v][c]
                allowed[v] = max(allowed[v], most)
            ends[v].append((number, most))
        alphabet = sorted({c for t, _ in terms for c in t})
        self.letter = {c: i + 1 for i, c in enumerate(alphabet)}  # 0 is any other letter

        def closed(pairs: dict[int, int]) -> frozenset[tuple[int, int]]:
            todo = list(pairs.items())
            while todo:
                v, e = todo.pop()
                if pairs.get(v) == e:
                    for u in children[v].values():  # a letter left out
                        if e + 1 <= allowed[u] and pairs.get(u, 9) > e + 1:
                            pairs[u] = e + 1
                            todo.append((u, e + 1))
            return frozenset(pairs.items())

        start = closed({0: 0})
        number_of = {frozenset(): 0, start: 1}
        rows, whole, stems = [[0] * (len(alphabet) + 1)], [(-1, 0)], [-1]
        queue = [start]
        while queue:
            state = queue.pop(0)
            row = []
            for c in [None, *alphabet]:
                pairs: dict[int, int] = {}
                for v, e in state:
                    for d, u in children[v].items():  # the letter, or another in its place
                        cost = e + (d != c)
                        if cost <= allowed[u] and pairs.get(u, 9) > cost:
                            pairs[u] = cost
                    if e + 1 <= allowed[v] and pairs.get(v, 9) > e + 1:  # a letter too many
                        pairs[v] = e + 1
                nxt = closed(pairs)
                if nxt not in number_of:
                    number_of[nxt] = len(number_of)
                    queue.append(nxt)
                row.append(number_of[nxt])
            rows.append(row)
            hits = sorted((e, n) for v, e in state for n, most in ends[v] if not terms[n][1] and e <= most)
            whole.append((hits[0][1], hits[0][0]) if hits else (-1, 0))
            stems.append(min((n for v, e in state for n, _ in ends[v] if terms[n][1] and e == 0), default=-1))
        self.next = np.array(rows, np.int32)
        self.whole, self.whole_edits, self.stem = np.array([w[0] for w in whole]), np.array([w[1] for w in whole]), np.array(stems)

    def classes(self) -> np.ndarray:
        out = np.zeros(0x110000, np.uint8 if len(self.letter) < 256 else np.uint16)
        for c, i in self.letter.items():
            out[ord(c)] = i
        return out

    def run(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words that match; codes: letter classes of the text."""
        found = []
        at, state, step = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
        while len(at):
            state = self.next[state, codes[starts[at] + step]]
            step += 1
            stem = self.stem[state]
            ended = lengths[at] == step
            hit = np.where(stem >= 0, stem, np.where(ended, self.whole[state], -1))
            got = np.flatnonzero(hit >= 0)
            if len(got):
                found.append((at[got], hit[got], np.where(stem[got] >= 0, 0, self.whole_edits[state[got]])))
            on = (state > 0) & ~ended & (hit < 0)
            at, state = at[on], state[on]
        if not found:
            return (np.empty(0, np.int64),) * 3
        word, term, cost = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(word)
        return word[order], term[order], cost[order]


def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


class ToxicityModel:
    def __init__(self, terms: list[tuple[str, bool]], weights: list[float], struck: set[str], exact_only: set[int]):
        self.terms, self.term_weights, self.struck, self.exact_only = terms, np.array(weights), struck, exact_only
        self.automaton = LexiconAutomaton(terms)
        self.w = PRIOR.copy()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def hits(self, texts: list[str]) -> tuple[list[list[tuple[int, int, int, int, int, str]]], np.ndarray]:
        """For each text its hits (word number, term, edits, start and end in the text, spelling), and its words."""
        if not hasattr(self, "_classes"):
            self._classes, self._letters = self.automaton.classes(), worker_cache("letters", _letter_table)
        lowered = [low if len(low := t.lower()) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t) for t in texts]
        body = " ".join([*lowered, ""])
        codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], self._letters[codes], [False]]).astype(np.int8)))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        ends_of = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.searchsorted(starts, np.concatenate([[0], ends_of]))
        out: list[list[tuple[int, int, int, int, int, str]]] = [[] for _ in texts]
        if self.terms and len(starts):
            for word, term, cost in zip(*(x.tolist() for x in self.automaton.run(self._classes[codes], starts, lengths))):
                a, b = int(starts[word]), int(starts[word] + lengths[word])
                spelling = body[a:b]
                if cost and (spelling in self.struck or term in self.exact_only):
                    continue
                doc = int(np.searchsorted(ends_of, a, "right"))
                begin = int(ends_of[doc - 1]) if doc else 0
                out[doc].append((word - int(bounds[doc]), term, cost, a - begin, b - begin, spelling))
        self._starts = [starts[bounds[i] : bounds[i + 1]] - (ends_of[i - 1] if i else 0) for i in range(len(texts)) if out[i]]
        return out, np.diff(bounds)

    def features(self, texts: list[str]) -> np.ndarray:
        found, words = self.hits(texts)
        x = np.zeros((len(texts), len(PRIOR)))
        x[:, 0] = 1
        begins = iter(self._starts)
        for i, hits in enumerate(found):
            if not hits:
                continue
            starts, places = next(begins), np.array([h[0] for h in hits])
            sums = [0.0] * 4
            most = 0
            for at, term, cost, a, b, _ in hits:
                left = texts[i][int(starts[max(0, at - WINDOW)]) : a]
                right = texts[i][b : int(starts[at + WINDOW + 1]) if at + WINDOW + 1 < len(starts) else None]
                quoted = any(c in _OPEN for c in left) and any(c in _CLOSE for c in right)
                sums[2 * quoted + (cost > 0)] += self.term_weights[term] / (1 + cost)
                most = max(most, int(np.searchsorted(places, at + WINDOW, "right") - np.searchsorted(places, at - WINDOW)))
            x[i, 1:5] = np.log1p(sums)
            x[i, 5], x[i, 6] = np.log(most), np.log1p(100 * len(hits) / max(1, words[i]))
        return x

    def fit(self, texts: list[str], y: np.ndarray, ridge: float = 0.3) -> ToxicityModel:
        x = np.concatenate([np.zeros((0, len(PRIOR))), *(self.features(part) for part in portions(texts))])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            grad = x.T @ (p - y) + ridge * (self.w - PRIOR)
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(self.w))
            step = np.linalg.solve(curve, grad)
            self.w = self.w - step / max(1.0, np.abs(step).max())
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.w, -30, 30)))


def learn_terms(texts: list[str], y: np.ndarray, most: int = TERMS) -> tuple[list[tuple[str, bool]], list[float]]:
    """Terms (text, whether a stem) that mark toxic texts, and their log odds."""

    def beginnings(text: str) -> set[str]:
        out: set[str] = set()
        for word in {w for w, _, _ in letters(text) if len(w) >= 3}:
            out.add(word + "$")
            out.update(word[:n] for n in range(3, min(10, len(word)) + 1))
        return out

    toxic = [t for t, k in zip(texts, y) if k]
    clean = [t for t, k in zip(texts, y) if not k]
    if not toxic or not clean:
        return [], []
    counts: Counter[str] = Counter()
    for t in toxic:
        counts.update(beginnings(t))
    least = max(3, int(0.005 * len(toxic)))
    wanted = {k for k, n in counts.items() if n >= least}
    del counts
    against: Counter[str] = Counter()
    for t in clean:
        against.update(beginnings(t) & wanted)
    cover: dict[str, set[int]] = {}
    for i, t in enumerate(toxic):
        for k in beginnings(t) & wanted:
            cover.setdefault(k, set()).add(i)
    cover = {k: s for k, s in cover.items() if len(s) >= 12 * against[k]}
    support = {k: len(x) for k, x in cover.items()}
    chosen, weights = [], []

    def choose(term: str) -> None:
        chosen.append((term.rstrip("$"), not term.endswith("$")))
        weights.append(float(np.log((support[term] + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (against[term] + 0.5))))

    while cover and len(chosen) < most:
        best = max(cover, key=lambda k: (len(cover[k]) - 3 * against[k], len(k), k))
        if len(cover[best]) < least:
            break
        covered = cover.pop(best)
        choose(best)
        for k in list(cover):
            cover[k] -= covered
            if len(cover[k]) < least:
                del cover[k]
    # terms that stand beside others in the sample, but may stand alone elsewhere
    for term in sorted(support, key=lambda k: (-support[k], -len(k), k)):
        if support[term] < max(least, 0.02 * len(toxic)) or len(chosen) >= most:
            break
        bare = term.rstrip("$")
        if support[term] >= 50 * against[term] and not any(bare.startswith(t) or t.startswith(bare) for t, _ in chosen):
            choose(term)
    return chosen, [max(0.5, w) for w in weights]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> ToxicityModel:
    rows = training_sample(docs, labels, label, sample, longest, key, text).drop_duplicates("text")
    texts, y = rows["text"].tolist(), rows["y"].to_numpy(float)
    terms, weights = learn_terms(texts, y)
    loose = ToxicityModel(terms, weights, set(), set())
    struck: dict[int, set[str]] = {}
    for part in portions([t for t, k in zip(texts, y) if not k]):
        for hits in loose.hits(part)[0]:
            for _, term, cost, _, _, spelling in hits:
                if cost:
                    struck.setdefault(term, set()).add(spelling)
    spellings = {s for x in struck.values() for s in x}
    return ToxicityModel(terms, weights, spellings, {t for t, x in struck.items() if len(x) >= 3}).fit(texts, y)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `score` (double, 0 to 1)."""
    shared = share(docs.sparkSession, model)
    kept = [f for f in docs.schema if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            scores = shared.value.score([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())], [*(f.name for f in kept), name])

    return map_arrow(docs.select(*(F.col(f"`{f.name}`") for f in kept)), run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
