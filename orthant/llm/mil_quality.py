"""Quality classifier: attention over a document's passages (multiple-instance learning).

Method. A text is a bag of passages of PASSAGE words each. Every passage is encoded (statistics of its words and
letters, a learned layer), gated attention, tanh(V h) * sigmoid(U h), weighs the passages of a bag against
each other, and the weighted representation is scored. All weights are learned together from document labels
only, by gradient descent on the bags' log loss.

The sample to learn from is bounded: SAMPLE labelled rows, about, of texts up to LONGEST characters, chosen by a
hash of the key; rows whose crc32(key) mod 5 is 0 are never among them. Only the text is an input. Scoring is one
pass over all rows, whole texts, without a shuffle; the model (a few thousand numbers) is broadcast.

Edge cases: null and empty texts, and texts of white space, are one passage without words; repeated rows get the
same score; with no labels, or labels of one kind only, every score is that kind's rate (0.5 with none); other
columns pass through, but one named `score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import share
from ._util import held_out, map_arrow, portions, table, text_chunks, training_sample
from .ngram_join import _LOWER, _ODD, _SPACE, mix

PASSAGE = 48
SAMPLE, LONGEST = 5000, 100_000
HIDDEN, ATTENTION, EPOCHS = 16, 8, 120
THRESHOLD = 0.3

_SYMBOL, _UPPER, _DIGIT, _MARK, _PIPE, _HIGH = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?;:")] = True
_PIPE[list(b"|")] = True
_HIGH[128:] = True
WIDTH = 14


def passages(texts: list[bytes], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of every passage of every text, and the number of passages of each text (1 at least)."""
    body = b" ".join([*texts, b""])
    raw = np.frombuffer(body, np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    bounds = np.searchsorted(starts, np.concatenate([[0], ends_of]))
    words_of = np.diff(bounds)
    counts = np.maximum(1, -(-words_of // size))
    out = np.zeros((int(counts.sum()), WIDTH), np.float32)
    if not len(starts):
        return out, counts
    letters = np.flatnonzero(~space)
    offsets = np.cumsum(lengths) - lengths
    chars = raw[letters]
    place = np.arange(len(letters)) - np.repeat(offsets, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _ODD[1], np.uint64))
    hashes = mix(np.add.reduceat(mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])[_LOWER[chars]] * powers[place], offsets))
    doc = np.repeat(np.arange(len(texts)), words_of)
    ordinal = np.arange(len(starts)) - bounds[doc]
    passage = (np.cumsum(counts) - counts)[doc] + ordinal // size
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    which = passage[first]
    n = np.diff(np.concatenate([first, [len(starts)]])).astype(np.float32)
    per_letters = np.add.reduceat(lengths, first).astype(np.float32)
    of_chars = lambda mask: np.add.reduceat(np.add.reduceat(mask[chars].astype(np.int32), offsets), first)
    same_doc = lambda k: np.concatenate([np.zeros(k, bool), doc[k:] == doc[:-k]]) if len(doc) > k else np.zeros(len(doc), bool)
    after = np.concatenate([[False], hashes[1:] == hashes[:-1]]) & same_doc(1)
    # a word's four words up to it, seen before in the text
    grams = hashes.copy()
    for k in range(1, 4):
        grams[k:] += hashes[:-k] * np.uint64(int(_ODD[2 + k]))
    grams = mix(grams + doc.astype(np.uint64) * _ODD[3])
    order = np.argsort(grams, kind="stable")
    seen = np.zeros(len(grams), bool)
    seen[order[1:]] = grams[order[1:]] == grams[order[:-1]]
    seen &= same_doc(3)
    local = mix(hashes + passage.astype(np.uint64) * _ODD[3])
    order = np.argsort(local, kind="stable")
    again = np.zeros(len(local), bool)
    again[order[1:]] = local[order[1:]] == local[order[:-1]]
    sums = lambda flags: np.add.reduceat(flags.astype(np.float32), first)
    square = np.add.reduceat(lengths.astype(np.float64) ** 2, first)
    mean = per_letters / n
    columns = [
        n / size, mean / 8, np.sqrt(np.maximum(0, square / n - mean**2)) / 8,
        of_chars(_SYMBOL) / n, of_chars(_UPPER) / per_letters, of_chars(_DIGIT) / per_letters, of_chars(_MARK) / n, of_chars(_PIPE) / n, of_chars(_HIGH) / per_letters,
        sums(after) / n, sums(seen) / n, sums(again) / n, sums(lengths <= 3) / n, np.log1p(words_of[doc[first]]) / 8,
    ]
    out[which] = np.stack(columns, 1).astype(np.float32)
    return out, counts


class AttentionModel:
    """Passage encoder, gated attention and scorer; numpy throughout."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.w = {
            "E": r.normal(0, 0.3, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
            "a": r.normal(0, 0.3, ATTENTION), "c": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
        }
        self.constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.w, {}
        s["x"] = np.clip((x - self.mean) / self.scale, -8, 8)
        s["h"] = np.tanh(s["x"] @ w["E"] + w["e"])
        s["v"], s["u"] = np.tanh(s["h"] @ w["V"]), 1 / (1 + np.exp(-(s["h"] @ w["U"])))
        logits = (s["v"] * s["u"]) @ w["a"]
        first = np.cumsum(counts) - counts
        s["bag"] = np.repeat(np.arange(len(counts)), counts)
        raised = np.exp(logits - np.maximum.reduceat(logits, first)[s["bag"]])
        s["att"] = raised / np.add.reduceat(raised, first)[s["bag"]]
        s["z"] = np.add.reduceat(s["att"][:, None] * s["h"], first, 0)
        s["p"] = 1 / (1 + np.exp(-np.clip(s["z"] @ w["c"] + w["b"], -30, 30)))
        return s

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.03, decay: float = 1e-4) -> AttentionModel:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        first = np.cumsum(counts) - counts
        m, v = {k: 0 * a for k, a in self.w.items()}, {k: 0 * a for k, a in self.w.items()}
        for epoch in range(1, epochs + 1):
            s, w = self.forward(x, counts), self.w
            d = (s["p"] - y) / len(y)
            dz = d[:, None] * w["c"]
            into = dz[s["bag"]]
            g_att = (into * s["h"]).sum(1)
            g_logit = s["att"] * (g_att - np.add.reduceat(s["att"] * g_att, first)[s["bag"]])
            dv, du = g_logit[:, None] * w["a"] * s["u"] * (1 - s["v"] ** 2), g_logit[:, None] * w["a"] * s["v"] * s["u"] * (1 - s["u"])
            dh = (into * s["att"][:, None] + dv @ w["V"].T + du @ w["U"].T) * (1 - s["h"] ** 2)
            g = {"E": s["x"].T @ dh, "e": dh.sum(0), "V": s["h"].T @ dv, "U": s["h"].T @ du, "a": (s["v"] * s["u"]).T @ g_logit, "c": s["z"].T @ d, "b": np.array([d.sum()])}
            for k in w:
                grad = g[k] + decay * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), 0.5 if self.constant is None else self.constant)
        return self.forward(*passages(texts))["p"]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> AttentionModel:
    rows = training_sample(docs, labels, label, sample, longest, key, text)
    bags = [passages([t.encode("utf-8", "surrogatepass") for t in part]) for part in portions(rows["text"].tolist())]
    if not bags:
        return AttentionModel().fit(np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0))
    return AttentionModel().fit(np.concatenate([x for x, _ in bags]), np.concatenate([n for _, n in bags]), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: AttentionModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `score` (double, 0 to 1)."""
    shared = share(docs.sparkSession, model)
    kept = [f for f in docs.schema if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            scores = shared.value.score([t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())], [*(f.name for f in kept), name])

    return map_arrow(docs.select(*(F.col(f"`{f.name}`") for f in kept)), run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality_mil": op9_quality_mil}
ORACLES: dict[str, str] = {}
