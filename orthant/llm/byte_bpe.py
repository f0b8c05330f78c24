"""Byte-level BPE encoding and decoding.

Method: the texts' pieces (matches of the splitting pattern) are gathered by length into padded
numpy matrices, a row for each distinct piece. In every round each row merges its leftmost pair of
minimum rank: the ranks of all adjacent pairs come from an open-addressing hash table, the merged
row is compacted by one place, and only the two pairs beside the merge are looked up anew. Rows
without a mergeable pair leave the matrix. Pieces longer than LONGEST_ROW bytes, for which a round
per merge would cost the square of the length, are merged by a heap in the same order.

Edge cases: a null or empty text has no ids (an empty list, not null) and decodes to no bytes; any
other columns, whatever their names, pass through untouched; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import map_arrow, ragged_take, table, text_chunks, worker_cache

#: Splits text before the merges (a fixed value: the pattern of the rank files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece, in bytes, that goes through the matrices.
LONGEST_ROW = 256
#: Distinct pieces that a Python worker remembers before it starts afresh.
REMEMBERED = 250_000
NO_RANK = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PairTable:
    """(left id, right id) -> rank of the joined token, by open addressing in numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self.slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == -1]
            self.keys[slots[free]] = keys[free]  # of several for a slot the last stays
            self.ranks[slots[free]] = ranks[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NO_RANK for what doesn't merge; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, res = keys.ravel(), out.ravel()
        slots = self.slot(flat[todo])
        while len(todo):
            found = self.keys[slots]
            hit = found == flat[todo]
            res[todo[hit]] = self.ranks[slots[hit]]
            on = ~hit & (found != -1)
            todo, slots = todo[on], (slots[on] + 1) & self.mask
        return res.reshape(keys.shape)


class ByteBpe:
    """Encoder and decoder for a file of ranks (base64 token, rank)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.split = regex.compile(pattern).findall
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.table = PairTable(pairs)
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        by_rank = [b""] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.token_lengths = np.array([len(t) for t in by_rank], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Padded ids of bytes, a row for each piece -> ids left in each row, and how many."""
        n, width = rows.shape
        out, counts = np.full((n, width), -1, np.int32), (rows >= 0).sum(1)
        if width < 2:
            return rows, counts
        ranks, live = self.table.lookup(rows[:, :-1], rows[:, 1:]), np.arange(n)
        columns = np.arange(width)
        while len(live):
            at = ranks.argmin(1)  # the leftmost of equal ranks
            rank = ranks[np.arange(len(live)), at]
            done = rank == NO_RANK
            if done.any():
                out[live[done], : rows.shape[1]] = rows[done]
                rows, ranks, live, at, rank = rows[~done], ranks[~done], live[~done], at[~done], rank[~done]
                if not len(live):
                    break
            counts[live] -= 1
            each = np.arange(len(live))
            rows[each, at] = rank  # a merged pair's rank is the joined token's id
            after = columns[: rows.shape[1] - 1]
            gone = after[None, :] > at[:, None]
            rows = np.where(gone, rows[:, 1:], rows[:, :-1])
            ranks = np.where(gone[:, :-1], ranks[:, 1:], ranks[:, :-1]) if ranks.shape[1] > 1 else np.empty((len(live), 0), np.int32)
            keep = int(counts[live].max())
            rows, ranks = rows[:, :keep], ranks[:, : keep - 1]
            if keep < 2:
                out[live, :keep] = rows
                break
            right = np.minimum(at, keep - 2)
            nxt = np.where(at + 1 < keep, rows[each, np.minimum(at + 1, keep - 1)], -1)
            ranks[each, right] = np.where(at <= keep - 2, self.table.lookup(rows[each, np.minimum(at, keep - 1)], nxt), ranks[each, right])
            left = np.maximum(at - 1, 0)
            ranks[each, left] = np.where(at > 0, self.table.lookup(rows[each, left], rows[each, np.minimum(at, keep - 1)]), ranks[each, left])
        return out, counts

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece by a heap of (rank, place): the same merges in the same order."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        prev, nxt = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        array = np.array(ids, np.int32)
        first = self.table.lookup(array[:-1], array[1:])
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NO_RANK).tolist()]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j >= 0:
                pair = (ids[i], ids[j])
                if pair not in memo:
                    memo[pair] = int(self.table.lookup(np.array(pair[:1]), np.array(pair[1:]))[0])
                if memo[pair] != NO_RANK:
                    heapq.heappush(heap, (memo[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = rank, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return [x for x in ids if x >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Encodes distinct pieces, by length, and remembers them."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        begins = np.cumsum(sizes) - sizes
        ids, lengths = [], np.zeros(len(raw), np.int64)
        order, low = [], 0
        for high in (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, LONGEST_ROW):
            which = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(which, max(1, len(which) * high // 1_000_000)):
                if len(part):
                    rows = np.full((len(part), high), -1, np.int32)
                    inside = np.arange(high)[None, :] < sizes[part][:, None]
                    rows[inside] = self.byte_ids[ragged_take(flat, begins[part], sizes[part])]
                    out, counts = self.merge_rows(rows)
                    ids.append(out[np.arange(out.shape[1])[None, :] < counts[:, None]])
                    lengths[part] = counts
                    order.append(part)
            low = high
        for i in np.flatnonzero(sizes > LONGEST_ROW).tolist():
            ids.append(np.array(self.merge_long(raw[i]), np.int32))
            lengths[i] = len(ids[-1])
            order.append(np.array([i]))
        ranked = np.concatenate(order) if order else np.empty(0, np.int64)
        starts = np.zeros(len(raw), np.int64)
        starts[ranked] = len(self.ids) + np.cumsum(lengths[ranked]) - lengths[ranked]
        self.known.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *ids]).astype(np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many belong to each."""
        pieces = [self.split(t) if t else [] for t in texts]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.forget()
            new = set().union(*pieces)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        total = sum(map(len, pieces))
        which = np.fromiter((i for p in pieces for i in map(get, p)), np.int64, total)
        lengths = self.lengths[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        return ragged_take(self.ids, self.starts[which], lengths), ends[bounds[1:]] - ends[bounds[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the lists of ids, and how many belong to each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_lengths)):
            raise ValueError("an id is outside the vocabulary")
        lengths = self.token_lengths[ids]
        ends, bounds = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(counts)])
        return ragged_take(self.token_bytes, self.token_starts[ids], lengths), ends[bounds[1:]] - ends[bounds[:-1]]


def _codec(path: str, pattern: str) -> ByteBpe:
    return worker_cache(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """df with a column `ids` (array<int>) of its texts' token ids; it takes the place of a column of that name."""
    path = ranks_path or default_ranks_path()
    kept = [f for f in df.schema if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in text_chunks(batches, text):
            flat, counts = codec.encode(batch.column(text).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            arrays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, pa.array(flat))], [*(f.name for f in kept), ids])
        codec.forget()

    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return map_arrow(df.select(*(F.col(f"`{f.name}`") for f in kept)), run, schema)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """df with a column `decoded` (binary) of the bytes that its ids stand for; it takes the place of a column of that name."""
    path = ranks_path or default_ranks_path()
    kept = [f for f in df.schema if f.name != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, PATTERN)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = batch.column(ids)
                counts = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                flat, sizes = codec.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), binary], [*(f.name for f in kept), decoded])

    schema = T.StructType([*kept, T.StructField(decoded, T.BinaryType())])
    return map_arrow(df.select(*(F.col(f"`{f.name}`") for f in kept)), run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs).select("doc_id", "ids")
    return decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
