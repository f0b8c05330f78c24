"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays.

A byte goes if a string of `length` bytes covers it that also starts elsewhere, in this text or another.

Method. Every window of `length` bytes has one anchor, the leftmost of its GRAM-byte grams with the least hash.
Equal windows have equal anchors, so only texts around equal anchors need comparing. A maximal row of windows
whose anchors have one hash is a context (some hundred windows; periodic text has one context for up to LONGEST). Contexts are counted by (anchor, context) hash with partial
sums before the shuffle: a context that occurs twice repeats whole, and copies never travel. Of the others, where
an anchor has several distinct contexts, one text each is sorted: contexts are laid end to end, the suffixes
smaller than their successors are sorted directly, the rest is induced by scans over the buckets of first bytes,
and adjacent common prefixes of `length` bytes mark repeated windows. An anchor with more than HOT distinct
contexts (a passage inside very many texts) goes by the 128-bit hashes of its windows instead, packed and dealt by hash;
of a hash that a batch has twice one travels, so that no group comes to one task.

Shorter repeats can be reported beside (`report`): anchors are then those of the shorter windows, contexts reach on for
the longer ones, and one sort finds both by the same common prefixes.

Scale: three shuffles of about one small row for each 170 bytes of text (anchors; each 110 where repeats of 250 are
looked for), and two joins of the texts on their key, which share one exchange. Contexts are checkpointed in the
shared folder, 18 bytes each.

Edge cases: a null text is empty; texts below `length` bytes keep all; repeated rows count as several texts, so
each loses what is `length` long; spans of fewer words than `least_words` stay; texts that share a key are told apart by their hash; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import checkpoint, map_arrow, ragged_take, table, text_chunks

LENGTH = 400
GRAM = 64
#: Repeats that op5 reports beside: bytes and words (runs of anything but space and \\t-\\r) at least; and their anchors' grams.
PASSAGE, PASSAGE_WORDS, PASSAGE_GRAM = 250, 50, 32
#: Distinct contexts of an anchor that one task sorts.
HOT = 1000
#: Windows in one context; longer ones, of periodic text, are cut.
LONGEST = 4096
#: Bytes of contexts that are sorted at a time, and of texts hashed at a time.
SORTED_BYTES, HASHED_BYTES = 256 << 10, 1 << 20
#: Suffixes that agree so far and whose bytes are copied to sort them.
COPIED = 30_000
#: Low bits of a packed hash that hold the place; a longer text is cut into overlapping tiles.
_PLACE_BITS = 26


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of buf[i : i + gram] for each i; gram is a power of two."""
    base = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
    h, step, power = base[buf], 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[: len(h) - step] * np.uint64(power) + h[step:]
        step, power = step * 2, power * power % 2**64
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i, by running minima from either side of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, 1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, anchor hash, whether the anchor recurs in it) of every context of the texts buf[bounds[i] : bounds[i + 1]]."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    if len(buf) < length:
        return none
    out = []
    most = (1 << _PLACE_BITS) - length
    for at in range(0, len(buf) - length + 1, most):
        tile = buf[at : at + most + length - 1]
        hashes = gram_hashes(tile, gram)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_min(packed, length - gram + 1) & mask).astype(np.int64)
        starts = np.arange(len(place)) + at
        text = np.searchsorted(bounds, starts, "right") - 1
        inside = starts + length <= bounds[text + 1]
        starts, text, place = starts[inside], text[inside], place[inside]
        if len(starts):
            anchor = hashes[place]
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            counts = np.diff(np.concatenate([first, [len(starts)]]))
            pieces = -(-counts // LONGEST)
            if (pieces > 1).any():  # periodic text
                part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                left = np.repeat(counts, pieces) - part * LONGEST
                first, counts = np.repeat(first, pieces) + part * LONGEST, np.minimum(left, LONGEST)
            out.append((text[first], starts[first] - bounds[text[first]], counts, anchor[first], place[first] != place[first + counts - 1]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def sort_directly(text: bytes, places: np.ndarray, depth: int, at: int = 0) -> np.ndarray:
    """Places whose suffixes agree on `at` bytes, in the order of their first `depth`.

    Eight bytes as numbers first; what these leave equal is sorted by its bytes, some COPIED suffixes at a time, and by
    its next eight where more than that agree.
    """
    if at >= depth or len(places) < 2:
        return places
    padded = np.frombuffer(text + b"\0" * (at + 8), np.uint8)
    keys = np.ndarray((len(text) + 1,), ">u8", padded.data, offset=at, strides=(1,))[places].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    sizes = np.diff(cuts)
    for i in np.flatnonzero(sizes > COPIED).tolist():
        places[cuts[i] : cuts[i + 1]] = sort_directly(text, places[cuts[i] : cuts[i + 1]], depth, at + 8)
    few = (sizes > 1) & (sizes <= COPIED)
    slots, ends = np.flatnonzero(np.repeat(few, sizes)), np.cumsum(sizes[few])
    edges = np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(COPIED, len(slots), COPIED))], [len(slots)]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):  # whole groups, so each keeps its slots
        places[slots[a:b]] = sorted(places[slots[a:b]].tolist(), key=lambda i: text[i + at : i + depth])
    return places


def two_stage_suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of text in the order of their first `depth` bytes at least; the end counts as the least byte."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    unequal = t[1:] != t[:-1]
    differ = np.flatnonzero(unequal)
    nxt = np.concatenate([[0], np.cumsum(unequal)])  # where the run of equal bytes ends
    at = np.where(nxt < len(differ), differ[np.minimum(nxt, max(0, len(differ) - 1))] if len(differ) else 0, n - 1)
    small = np.zeros(n, bool)  # smaller than its successor
    within = at < n - 1
    small[within] = t[at[within]] < t[at[within] + 1]
    direct = np.flatnonzero(small)
    direct = sort_directly(text, direct, depth)
    cuts = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1]))
    result = []

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edges = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                induced[first[a]].append(before[a:b])

    for c in range(256):
        while induced[c]:  # runs of c add to their own bucket
            found, induced[c] = np.concatenate(induced[c]), []
            induce(found)
            result.append(found)
        own = direct[cuts[c] : cuts[c + 1]]
        if len(own):
            induce(own)
            result.append(own)
    return np.concatenate(result)


def common_prefixes(buf: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the next in order, in bytes, up to most."""
    padded = np.concatenate([buf, np.zeros(most + 8, np.uint8)])
    eights = np.ndarray((len(buf) + most + 1,), "<u8", padded.data, strides=(1,))
    left, right, out = order[:-1], order[1:], np.full(max(0, len(order) - 1), most)
    live, bytes_ = np.arange(len(out)), (np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)) - np.uint64(1)
    for step in range(0, most, 8):
        unequal = eights[left[live] + step] ^ eights[right[live] + step]
        ended = unequal != 0
        at = live[ended]
        out[at] = step + sum((unequal[ended] & low) == 0 for low in bytes_)
        live = live[~ended]
    return np.minimum(out, np.minimum(most, len(buf) - np.maximum(left, right)))


def repeated_windows(contexts: list[bytes], windows: list[int], length: int = LENGTH, longer: int | None = None) -> list[list[np.ndarray]]:
    """For `length` and `longer` each, and for each context, the starts below its windows that also start elsewhere among the contexts."""
    longer = longer or length
    text = b"\xff".join(contexts) + b"\xff" * (longer + 1)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = two_stage_suffix_array(text, longer)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    owner = np.concatenate([owner, np.full(len(text) - len(owner), max(0, len(contexts) - 1))])[order]
    inside = order - begins[owner] < np.array(windows, np.int64)[owner]  # what reaches on starts in another context
    order, owner = order[inside], owner[inside]
    shared, found = common_prefixes(np.frombuffer(text, np.uint8), order, max(length, longer)), []
    for n in dict.fromkeys((length, longer)):
        same = shared >= n
        marked = np.zeros(len(order), bool)
        marked[:-1] |= same
        marked[1:] |= same
        marked &= order + n <= begins[owner] + sizes[owner]
        places, owners = order[marked] - begins[owner[marked]], owner[marked]
        by_owner = np.lexsort((places, owners))
        places, owners = places[by_owner], owners[by_owner]
        edges = np.searchsorted(owners, np.arange(len(contexts) + 1))
        found.append([places[edges[i] : edges[i + 1]] for i in range(len(contexts))])
    return found


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each row of successive places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist()))


_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_RANGE_SQL = "array<struct<first:int,last:int>>"
#: Starts of repeated windows of a length.
_MARKS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("length", pa.int32())]))
_MARKS_SQL = "array<struct<first:int,last:int,length:int>>"
#: A context of a text; each begins where the windows of the one before end. windows: twice their number, and 1 if the anchor recurs.
_CONTEXT = np.dtype([("anchor", "<i8"), ("context", "<i8"), ("windows", "<u2")])


def _find_contexts(batches: Iterator[pa.RecordBatch], length: int, longer: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The texts' contexts, packed; texts without any are left out."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in text_chunks(batches, "_text", HASHED_BYTES):
        texts = [t or b"" for t in batch.column("_text").cast(pa.binary()).to_pylist()]
        body = b"".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        text, start, windows, hashes, inner = anchors(np.frombuffer(body, np.uint8), bounds, length, gram)
        view, begin = memoryview(body), bounds[text] + start
        end = np.minimum(begin + windows + longer - 1, bounds[text + 1])
        packed = np.empty(len(text), _CONTEXT)
        packed["anchor"], packed["windows"] = hashes.view(np.int64), 2 * windows + inner
        packed["context"] = np.fromiter((digest(view[a:b], w) for a, b, w in zip(begin.tolist(), end.tolist(), windows.tolist())), np.uint64, len(text)).view(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
        which = pa.array(text[cuts])
        blobs = [packed[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(text)])]
        yield pa.RecordBatch.from_arrays([batch.column("_k").take(which), batch.column("_x").take(which), pa.array(blobs, pa.binary())], ["_k", "_x", "contexts"])


def _unpack_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context; place: where it starts and its windows, as packed, below."""
    for batch in batches:
        blobs = batch.column("contexts").to_pylist()
        counts = np.array([len(b) // _CONTEXT.itemsize for b in blobs], np.int64)
        for at in range(0, len(blobs), 64):
            flat = np.frombuffer(b"".join(blobs[at : at + 64]), _CONTEXT)
            own = counts[at : at + 64]
            windows = (flat["windows"] >> 1).astype(np.int64)
            ends = np.cumsum(windows)
            firsts = (ends - windows)[np.cumsum(own) - own] if len(flat) else ends
            start = ends - windows - np.repeat(firsts, own)
            which = pa.array(np.repeat(np.arange(at, at + len(own)), own))
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(which), batch.column("_x").take(which), pa.array(flat["anchor"].copy()), pa.array(flat["context"].copy()), pa.array(start << 16 | flat["windows"])], ["_k", "_x", "anchor", "context", "place"])


def _cut_contexts(batches: Iterator[pa.RecordBatch], longer: int) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "_text"):
        texts = batch.column("_text").cast(pa.binary()).to_pylist()
        anchor, context, windows, body = [], [], [], []
        for text, wanted in zip(texts, batch.column("wanted").to_pylist()):
            for w in wanted:
                start, n = w["place"] >> 16, (w["place"] & 0xFFFF) >> 1
                anchor.append(w["anchor"])
                context.append(w["context"])
                windows.append(n)
                body.append(text[start : start + n + longer - 1])
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(context, pa.int64()), pa.array(windows, pa.int32()), pa.array(body, pa.binary())], ["anchor", "context", "windows", "body"])


def _sort_contexts(batches: Iterator[pa.RecordBatch], length: int, longer: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an anchor's rows are compared together, several anchors at a time."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = repeated_windows([x[3] for x in held], [x[2] for x in held], length, longer)
        marks = [[{"first": a, "last": b, "length": n} for n, one in zip((length, longer), each) for a, b in _ranges(one)] for each in zip(*found)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array(marks, _MARKS)], ["anchor", "context", "marks"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "windows", "body"))):
            if size > SORTED_BYTES and held[-1][0] != row[0]:
                yield flush()
                held, size = [], 0
            if not held or held[-1][:2] != row[:2]:  # repeated rows bring a context more than once
                held.append(row)
                size += len(row[3])
    if held:
        yield flush()


#: Hashes of windows, by bucket (-1: known to repeat): the hashes, which context of the row each is in, and where and how long.
_HASHED = "bucket int, digests binary, owners binary, places binary, anchors binary, contexts binary"
_DIGEST = np.dtype([("high", "<u8"), ("low", "<u8")])
#: Hashes in a bucket, about.
HASHES = 1_000_000


def _hash_windows(batches: Iterator[pa.RecordBatch], length: int, longer: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts -> rows of _HASHED; of a hash that a batch has twice one travels, and all its places are known to repeat."""
    import xxhash

    for batch in batches:
        if not batch.num_rows:
            continue
        anchors, contexts = (batch.column(c).to_numpy() for c in ("anchor", "context"))
        digests, owners, places = [], [], []
        for i, (windows, body) in enumerate(zip(batch.column("windows").to_pylist(), batch.column("body").to_pylist())):
            view = memoryview(body)
            for size in dict.fromkeys((length, longer)):
                n = max(0, min(windows, len(body) - size + 1))
                digests += [xxhash.xxh3_128_digest(view[j : j + size], size) for j in range(n)]
                owners.append(np.full(n, i))
                places.append(np.arange(n) << 32 | size)
        flat, owners, places = np.frombuffer(b"".join(digests), _DIGEST), np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((flat["low"], flat["high"]))
        flat, owners, places = flat[order], owners[order], places[order]
        first = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
        counts = np.diff(np.concatenate([np.flatnonzero(first), [len(flat)]]))
        again = np.repeat(counts > 1, counts)
        bucket = ((flat["high"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        rows = []
        for b, which in [(-1, np.flatnonzero(again)), *((b, np.flatnonzero(first & (bucket == b))) for b in range(buckets))]:
            if len(which):
                used, short = np.unique(owners[which], return_inverse=True)
                at = places[which] | (again[which].astype(np.int64) << 63 if b >= 0 else 0)  # the sign: it repeats anyway
                rows.append((b, flat[which].tobytes(), short.astype("<u4").tobytes(), at.astype("<i8").tobytes(), anchors[used].astype("<i8").tobytes(), contexts[used].astype("<i8").tobytes()))
        columns = [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 5]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "digests", "owners", "places", "anchors", "contexts"])


def _match_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _HASHED sorted by bucket -> anchor, context, marks of windows whose hash occurs again."""
    held: list[tuple] = []
    current = None

    def flush() -> pa.RecordBatch:
        flat = np.concatenate([np.frombuffer(r[0], _DIGEST) for r in held])
        owners = [np.frombuffer(r[1], "<u4") for r in held]
        places = np.concatenate([np.frombuffer(r[2], "<i8") for r in held])
        anchor, context = (np.concatenate([np.frombuffer(r[c], "<i8")[o] for r, o in zip(held, owners)]) for c in (3, 4))
        marked = np.ones(len(flat), bool)
        if current >= 0:
            order = np.lexsort((flat["low"], flat["high"]))
            flat, places, anchor, context = flat[order], places[order], anchor[order], context[order]
            run = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
            known = places < 0
            marked = ((np.bincount(run) > 1) | (np.bincount(run, known) > 0))[run] & ~known  # known ones are marked where they were found
        places, anchor, context = places[marked], anchor[marked], context[marked]
        size, at = places & 0xFFFFFFFF, places >> 32
        order = np.lexsort((at, size, context, anchor))
        size, at, anchor, context = size[order], at[order], anchor[order], context[order]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])[: len(at)]
        begin = new | np.concatenate([[True], (size[1:] != size[:-1]) | (at[1:] > at[:-1] + 1)])[: len(at)]
        starts = np.flatnonzero(begin)
        ends = np.concatenate([starts[1:], [len(at)]])[: len(starts)] - 1
        ranges = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (at[starts], at[ends], size[starts])], ["first", "last", "length"])
        lists = np.concatenate([np.searchsorted(starts, np.flatnonzero(new)), [len(starts)]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(context[new]), pa.ListArray.from_arrays(pa.array(lists), ranges)], ["anchor", "context", "marks"])

    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (bucket != current or bucket < 0 and len(held) >= 16):
                yield flush()
                held = []
            current = bucket
            held.append(tuple(row))
    if held:
        yield flush()


def _spans(text: bytes, marks: list[dict], length: int, least_words: int) -> list[list[int]]:
    """[from, to) of the bytes that repeated windows of this length cover, where they hold so many words."""
    merged: list[list[int]] = []
    for a, b in sorted((m["first"], min(m["last"] + length, len(text))) for m in marks if m["length"] == length and m["first"] + length <= len(text)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [x for x in merged if not least_words or len(text[x[0] : x[1]].split()) >= least_words]


def _cut_texts(batches: Iterator[pa.RecordBatch], length: int, as_text: bool, least_words: int, report: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    listed = lambda merged: [{"first": a, "last": b - 1} for a, b in merged]
    for batch in text_chunks(batches, "_text"):
        kept, sizes, spans, repeats = [], [], [], []
        for text, marks in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist()):
            text = text or b""
            merged = _spans(text, marks or [], length, least_words)
            parts, at = [], 0
            for a, b in merged:
                parts.append(text[at:a])
                at = b
            left = b"".join([*parts, text[at:]])
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            sizes.append(len(text))
            spans.append(listed(merged))
            repeats.append(listed(_spans(text, marks or [], *report)) if report else [])
        names = [n for n in batch.schema.names if n not in ("_text", "marks")]
        rest = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(spans, _RANGE), pa.array(repeats, _RANGE), pa.array(kept, pa.string() if as_text else pa.binary()), *rest], ["n_bytes", "spans", "repeats", "kept", *names])


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: tuple[str, ...] = (), as_text: bool = False, least_words: int = 0, report: tuple[int, int] | None = None
) -> DataFrame:
    """key, n_bytes, spans (removed bytes, both ends in), repeats, kept and the columns `keep` for each row.

    `length` is at least `gram`, a power of two. Spans of fewer words than `least_words` stay. kept is binary; with
    as_text it is a string, without the bytes of characters that a cut has split. report: bytes (`length` at most, `gram`
    at least) and words of shorter repeats, which `repeats` then lists and which stay in the text.
    """
    least = min(length, report[0]) if report else length
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_x"), F.col(text).cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *keep).alias("_rest"))
    found = checkpoint(map_arrow(rows.select("_k", "_x", "_text"), lambda it: _find_contexts(it, least, length, gram), f"_k {kind}, _x bigint, contexts binary"))
    found = map_arrow(found, _unpack_contexts, f"_k {kind}, _x bigint, anchor bigint, context bigint, place bigint")
    counted = found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_k", "_x", "place")).alias("one"))
    inner = F.col("one.place") % 2
    several = counted.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least"), F.max(inner).alias("any_inner")).where("total > 1 or any_inner = 1")
    repeated = checkpoint(counted.join(several.select("anchor", "contexts", "least"), "anchor"))
    last = (F.floor(F.col("one.place") / 2).cast("bigint") % 32768 - 1).cast("int")
    whole = [F.struct(F.lit(0).alias("first"), last.alias("last"), F.lit(n).alias("length")) for n in dict.fromkeys((least, length))]
    copies = repeated.where("n > 1").select("anchor", "context", F.array(*whole).cast(_MARKS_SQL).alias("marks"))
    wanted = repeated.where((F.col("least") == 1) & ((F.col("contexts") > 1) | (inner == 1))).select(F.col("one._k").alias("_k"), F.col("one._x").alias("_x"), F.struct("anchor", "context", F.col("one.place").alias("place")).alias("want"), "contexts")
    same = lambda a, b: a["_k"].eqNullSafe(b["_k"]) & (a["_x"] == b["_x"])
    marks = [copies]
    ones = repeated.where("n = 1").select("anchor", "context")

    def bodies(which: DataFrame) -> DataFrame:
        lists = which.groupBy("_k", "_x").agg(F.collect_list("want").alias("wanted"))  # as long as the text at most
        joined = rows.join(lists, same(rows, lists)).select("_text", "wanted", "_rest")  # the same columns as below, so both joins read one exchange
        return map_arrow(joined, lambda it: _cut_contexts(it, length), "anchor bigint, context bigint, windows int, body binary")

    cold = bodies(wanted.where(F.col("contexts") <= hot)).repartition("anchor").sortWithinPartitions("anchor", "context")
    marks.append(map_arrow(cold, lambda it: _sort_contexts(it, least, length), f"anchor bigint, context bigint, marks {_MARKS_SQL}").where(F.size("marks") > 0).join(ones, ["anchor", "context"], "left_semi"))
    hashed = wanted.where(F.col("contexts") > hot)
    total = hashed.agg(F.sum(F.col("want.place") % 65536)).first()[0]
    if total:
        buckets = 1 + int(total) // HASHES
        rows_of = map_arrow(bodies(hashed), lambda it: _hash_windows(it, least, length, buckets), _HASHED)
        dealt = rows_of.withColumn("salt", F.when(F.col("bucket") < 0, F.xxhash64("digests")).otherwise(F.lit(0))).repartition(max(2, buckets), "bucket", "salt").sortWithinPartitions("bucket").drop("salt")
        marks.append(map_arrow(dealt, _match_hashes, f"anchor bigint, context bigint, marks {_MARKS_SQL}").join(ones, ["anchor", "context"], "left_semi"))
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    start = F.shiftright("place", 16).cast("int")
    placed = found.join(every, ["anchor", "context"]).select("_k", "_x", F.transform("marks", lambda r: F.struct((r["first"] + start).alias("first"), (r["last"] + start).alias("last"), r["length"].alias("length"))).alias("marks"))
    per_text = placed.groupBy("_k", "_x").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    cut = rows.join(per_text, same(rows, per_text), "left").select("_text", "marks", rows["_k"], "_rest")
    kept = "string" if as_text else "binary"
    rest = rows.schema["_rest"].dataType.simpleString()
    done = map_arrow(cut, lambda it: _cut_texts(it, length, as_text, least_words, report), f"n_bytes bigint, spans {_RANGE_SQL}, repeats {_RANGE_SQL}, kept {kept}, _k {kind}, _rest {rest}")
    return done.select(F.col("_k").alias(key), "n_bytes", "spans", "repeats", "kept", *(F.col("_rest")[c].alias(c) for c in keep))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_bytes: bytes in repeats of PASSAGE bytes and PASSAGE_WORDS words, which stay."""
    done = remove_repeats(table(spark, sf_dir, "documents"), gram=PASSAGE_GRAM, report=(PASSAGE, PASSAGE_WORDS))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + (x["last"] - x["first"] + 1).cast("long"))
    return done.select("doc_id", "n_bytes", size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), size("repeats").alias("n_passage_bytes"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES: dict[str, str] = {}
