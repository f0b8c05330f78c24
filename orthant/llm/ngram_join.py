"""N-gram Jaccard self-join by prefix trees, and the groups that its links form.

A document's set: its distinct 4-word shingles (lower-cased A-Z; words are runs of anything but space and
\\t-\\r); of fewer words the whole sequence counts as one. Two documents link where 100 * |x & y| >= 85 * |x | y|.
These are op3's values; jaccard_groups takes others as n, num and den.

Method. Documents with equal sets are one class, whose links are its member's. Candidates come by prefixes: of
each set only the least hashes travel, a share of 2.5 times what linked sets may lack (half at 0.8). Of two sets
that link, these parts have a known number of elements in common (`bounds_of`). An element's holders are counted in
the bucket of its hash and told so; a set of which too few elements have another holder links with nothing and is
done. Of the others each takes the elements that the fewest hold, as many as must contain a shared one, so passages
that many documents share join nothing; sets with an equal one form loose groups (components), almost all of real
copies.

Each loose group is joined exactly by a prefix tree: elements in one global order (frequent first, so paths share
beginnings), each set a path, unary chains compressed. A probe descends level by level with numpy, the overlap of a
shared beginning counted once; a subtree is left where the overlap so far and what remains of the probe or of the
subtree's longest set can't reach the least overlap that its sizes need. A found set leaves the tree and probes in
its turn, so a group of m copies costs about m short probes and yields m - 1 links, not m * m / 2.

Scale: elements travel packed, 8 bytes each, in blobs dealt over as many buckets as the corpus needs; of an element
that over HOLDERS sets of a chunk hold, one travels for all, so a hot one costs an entry a chunk. In a loose group of
over BLOCK elements every member is first held against HUBS members; what these join (nearly all of a group of near
copies) needs no tests within, and the rest meets itself and the joined part block by block, each pair of blocks a
task of bounded memory. Text of the sets with candidates travels once, to its group's tasks (once for each task of a
large group); what is joined with it is broadcast up to KEYS rows and beyond takes a shuffle of the texts. Classes are told apart by 128-bit hashes of sets of 64-bit hashes.

Edge cases: null and empty texts have an empty set, no links, and are their own component; repeated rows are a
class; documents that share an id are told apart by their sets; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import checkpoint, map_arrow, ragged_take, table, text_chunks
from .components import components

N, NUM, DEN = 4, 85, 100
#: Elements that one task of the tree join holds, for each of its two sides.
BLOCK = 250_000
#: Members of a larger group that all others are held against first, and the most that their texts may take to be broadcast.
HUBS, HUB_BYTES = 4, 32 << 20
#: Packed elements in a bucket, about.
BUCKET = 1_000_000
#: Sets of a chunk that each send an element that they share; of more, one sends it for all.
HOLDERS = 8
#: Rows with candidates whose keys are broadcast; more are joined by a shuffle.
KEYS = 250_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""
    body = b" ".join([*texts, b""])
    raw = np.frombuffer(body, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sets = [np.empty(0, np.uint64)] * len(texts)
    if not len(starts):
        return sets
    lengths = ends - starts
    letters = np.flatnonzero(~space)
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(offsets, lengths)
    table_ = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
    powers = np.cumprod(np.full(int(lengths.max()), _ODD[1], np.uint64))
    words = mix(np.add.reduceat(table_[_LOWER[raw[letters]]] * powers[place], offsets) + lengths.astype(np.uint64) * _ODD[2])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    odd = [pow(int(_ODD[3]), i + 1, 2**64) | 1 for i in range(n)]
    shingles = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        shingles += words[i : len(words) - n + 1 + i] * np.uint64(odd[i])
    shingles = mix(shingles)
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a >= n:
            own = np.sort(shingles[a : b - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets[d] = own[keep]
        elif b > a:
            whole = sum(int(w) * o for w, o in zip(words[a:b], odd)) + (b - a) * int(_ODD[4])
            sets[d] = mix(np.array([whole % 2**64], np.uint64))
    return sets


def set_class(elements: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    import xxhash

    return xxhash.xxh3_128_digest(elements.tobytes())


def short_ids(classes: list[bytes]) -> np.ndarray:
    """The first 64 bits of classes, which name sets while candidates are looked for."""
    return np.frombuffer(b"".join(c[:8] for c in classes), ">i8").astype(np.int64)


def needed(x: int, y, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return -(-num * (x + y) // (num + den))


def bounds_of(size, num: int = NUM, den: int = DEN) -> tuple:
    """For sets of these sizes: p, how many least hashes travel, and how many of these a set that links shares with the other's.

    Proof: size - p never falls as sizes grow. Say x is not larger than y, so they share num / den of y at least. Up
    to the lesser of the two parts' last hashes the parts hold all that x and y share; above it stand size - p
    elements of that part's set, so the parts share num / den * |y| - (size - p) of either at least.
    """
    size = np.asarray(size, np.int64)
    p = np.clip(-(-5 * (den - num) * size // (2 * den)), np.minimum(1, size), size)
    return p, p - size + -(-num * size // den)


def names_of(bucket, low: np.ndarray, level) -> np.ndarray:
    """One number for an element in every task: its level (about how many hold it) above, 60 bits of hash below."""
    mixed = mix(low + (np.asarray(bucket).astype(np.uint64) + np.uint64(1)) * _ODD[4])
    return (np.asarray(level).astype(np.uint64) << np.uint64(60)) | (mixed >> np.uint64(4))


class Trie:
    """Sets of small numbers (ascending) as paths of a tree whose unary chains are compressed."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray, num: int = NUM, den: int = DEN):
        ordered = sorted(range(len(members)), key=lambda i: sets[members[i]].tobytes())  # big-endian, so bytes sort as numbers do
        members = members[ordered]
        paths = [sets[m].astype(np.int64) for m in members]
        sizes = np.array([len(p) for p in paths], np.int64)
        shared = np.zeros(len(paths) + 1, np.int64)
        for i in range(1, len(paths)):
            n = min(sizes[i - 1], sizes[i])
            unequal = np.flatnonzero(paths[i - 1][:n] != paths[i][:n])
            shared[i] = unequal[0] if len(unequal) else n
        depth, parent, sample, leaf, stack = [0], [-1], [0], [-1], [0]  # node 0 is the root

        def node(deep: int, path: int, ends: int) -> int:
            depth.append(deep)
            parent.append(-1)
            sample.append(path)
            leaf.append(ends)
            return len(depth) - 1

        def leave(common: int) -> int:
            """Takes the nodes below the common depth off the path; the topmost of them still lacks its parent."""
            last = -1
            while depth[stack[-1]] > common:
                v = stack.pop()
                if last >= 0:
                    parent[last] = v
                last = v
            return last

        for i, size in enumerate(sizes.tolist()):
            common = int(shared[i])
            last = leave(common)
            if last >= 0:
                if depth[stack[-1]] < common:
                    stack.append(node(common, i - 1, -1))
                parent[last] = stack[-1]
            stack.append(node(size, i, i))
        last = leave(0)
        if last >= 0:
            parent[last] = 0
        self.members, self.sizes = members, sizes
        self.num, self.den = num, den
        n = len(depth)
        slices = [np.empty(0, np.int64), *(paths[sample[v]][depth[parent[v]] : depth[v]] for v in range(1, n))]
        self.tokens = np.concatenate(slices)
        self.stop = np.cumsum([len(x) for x in slices])
        self.start = self.stop - np.array([len(x) for x in slices])
        self.parent, self.leaf, self.depth = np.array(parent, np.int64), np.array(leaf, np.int64), np.array(depth, np.int64)
        self.least, self.most = np.full(n, 2**40), np.zeros(n, np.int64)  # sizes of the sets in a subtree
        for v in np.argsort(-self.depth, kind="stable").tolist():
            if leaf[v] >= 0:
                self.least[v], self.most[v] = min(self.least[v], sizes[leaf[v]]), max(self.most[v], sizes[leaf[v]])
            if parent[v] >= 0:
                u = parent[v]
                self.least[u], self.most[u] = min(self.least[u], self.least[v]), max(self.most[u], self.most[v])
        by_parent = np.argsort(self.parent, kind="stable")
        self.children, self.first_child = by_parent, np.searchsorted(self.parent[by_parent], np.arange(n + 1))

    def probe(self, own: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Members that link with the set `own` (ascending numbers); held: a scratch mask, all False, over all numbers."""
        held[own] = True
        size, found, num, den = len(own), [], self.num, self.den
        at = self.children[self.first_child[0] : self.first_child[1]]
        above = np.zeros(len(at), np.int64)
        while len(at):
            lengths = self.stop[at] - self.start[at]
            hits = held[ragged_take(self.tokens, self.start[at], lengths)]
            sums = np.concatenate([[0], np.cumsum(hits)])
            ends = np.cumsum(lengths)
            overlap = above + sums[ends] - sums[ends - lengths]
            last = self.tokens[self.stop[at] - 1]
            left = np.minimum(size - np.searchsorted(own, last, "right"), self.most[at] - self.depth[at])
            live = (overlap + left >= needed(size, self.least[at], num, den)) & (self.most[at] * den >= num * size) & (self.least[at] * num <= den * size)
            at, overlap = at[live], overlap[live]
            leaves = self.leaf[at]
            ended = leaves >= 0
            own_leaves = leaves[ended]
            good = overlap[ended] >= needed(size, self.sizes[own_leaves], num, den)
            found.append(own_leaves[good])
            counts = self.first_child[at + 1] - self.first_child[at]
            above = np.repeat(overlap, counts)
            at = ragged_take(self.children, self.first_child[at], counts)
        held[own] = False
        return self.members[np.concatenate(found)] if found else np.empty(0, np.int64)


def forest(sets: list[np.ndarray], side: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Links that join what the exact join's links join: within the sets, or from side 0 to side 1 only."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    values, numbers, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    numbers = rank[numbers]
    ends = np.cumsum(sizes)
    own = [np.sort(numbers[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
    packed = [o.astype(">u4") for o in own]
    held = np.zeros(len(values), bool)
    active = np.ones(len(sets), bool)
    groups = [np.arange(len(sets))] if side is None else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    target = np.zeros(len(sets), np.int64) if side is None else 1 - side
    tries = [[None, 0] for _ in groups]
    links, queue, at = [], [], 0
    while True:
        if not queue:
            while at < len(sets) and not active[at]:
                at += 1
            if at == len(sets):
                return links
            queue.append(at)
            active[at] = False
        x = queue.pop()
        g = int(target[x])
        left = groups[g][active[groups[g]]]
        if not len(left):
            continue
        if tries[g][0] is None or 2 * len(left) <= tries[g][1]:
            tries[g] = [Trie(packed, left, num, den), len(left)]
        for y in tries[g][0].probe(own[x], held).tolist():
            if active[y]:
                active[y] = False
                links.append((x, y))
                queue.append(y)


def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "_text"):
        sets = shingle_sets([t or b"" for t in batch.column("_text").cast(pa.binary()).to_pylist()], n)
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_x"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) for s in sets], pa.binary())], ["_k", "_x", "n", "set"])


_PACKED = "bucket int, names binary, owners binary, sets binary, sizes binary"
_LINKS = "a binary, b binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 4], ["bucket", "names", "owners", "sets", "sizes"])


def _by_bucket(bucket: np.ndarray, buckets: int, names: np.ndarray, owners: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Rows of _PACKED; owners are places in ids and sizes."""
    if (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket, kind="stable")
        bucket, names, owners = bucket[order], names[order], owners[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        used, short = np.unique(owners[at:end], return_inverse=True)
        yield int(bucket[at]), names[at:end].astype("<u8").tobytes(), short.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(), ids[used].astype("<i8").tobytes(), sizes[used].astype("<u2" if sizes[used].max(initial=0) < 1 << 16 else "<u4").tobytes()


def _unpacked(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """names, set ids and set sizes of rows of _PACKED."""
    names = np.concatenate([np.frombuffer(r[0], "<u8") for r in held])
    owners = [np.frombuffer(r[1], "<u2" if 4 * len(r[1]) == len(r[0]) else "<u4") for r in held]
    return names, np.concatenate([np.frombuffer(r[2], "<i8")[o] for r, o in zip(held, owners)]), np.concatenate([np.frombuffer(r[3], "<u2" if 4 * len(r[3]) == len(r[2]) else "<u4")[o] for r, o in zip(held, owners)]).astype(np.int64)


def _bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows) of rows of _PACKED sorted by bucket; rows of a negative bucket stand for themselves and come in portions."""
    held: list[tuple] = []
    current = None
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (bucket != current or bucket < 0 and len(held) >= 256):
                yield current, held
                held = []
            current = bucket
            held.append(tuple(row))
    if held:
        yield current, held


def _deal(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(ids.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_LOW = np.uint64(2**62 - 1)


def _pack_prefixes(batches: Iterator[pa.RecordBatch], n: int, buckets: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The least hashes of every set, packed by bucket (bit 62: others of the chunk hold it); rows of bucket -1 are for the sets' own buckets."""
    for batch in text_chunks(batches, "_text", 3 << 20):
        sets = {set_class(s): s for s in shingle_sets([t or b"" for t in batch.column("_text").cast(pa.binary()).to_pylist()], n) if len(s)}
        if not sets:
            continue
        ids, own = short_ids(list(sets)), list(sets.values())
        sizes = np.array([len(s) for s in own], np.int64)
        p = bounds_of(sizes, num, den)[0]
        keys = mix(np.concatenate([s[:k] for s, k in zip(own, p.tolist())]) ^ _ODD[5])
        owners = np.repeat(np.arange(len(own)), p)
        order = np.argsort(keys)
        keys, owners = keys[order], owners[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.concatenate([heads, [len(keys)]]))
        hot = np.repeat(counts > HOLDERS, counts)
        sent = ~hot
        sent[heads] = True
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        flags = (keys & _LOW) | (hot.astype(np.uint64) << np.uint64(62))
        rows = list(_by_bucket(bucket[sent], buckets, flags[sent], owners[sent], ids, sizes))
        if hot.any():
            told = names_of(bucket[hot], keys[hot] & _LOW, 15)
            rows += [(-1, *r[1:]) for r in _by_bucket(np.zeros(len(told), np.int64), 1, told, owners[hot], ids, sizes)]
        yield _packed(rows)


def _count_holders(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Elements by their buckets -> those with another holder, by the buckets of their sets."""
    for current, held in _bucket_runs(batches):
        names, ids, sizes = _unpacked(held)
        if current >= 0:
            low = names & _LOW
            order = np.argsort(low)
            same = np.concatenate([[False], low[order[1:]] == low[order[:-1]], [False]])
            order = order[same[1:] | same[:-1] | (names[order] != low[order])]  # most have one holder and no flag
            low, ids, sizes, flag = low[order], ids[order], sizes[order], names[order] != low[order]
            order = np.lexsort((ids, low))
            low, ids, sizes, flag = low[order], ids[order], sizes[order], flag[order]
            first = np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]
            run = np.cumsum(first) - 1
            hot = np.bincount(run, flag) > 0
            fresh = first | np.concatenate([[True], ids[1:] != ids[:-1]])[: len(low)]
            holders = np.bincount(run, fresh).astype(np.int64)
            level = np.where(hot, 15, np.minimum(14, np.log2(np.maximum(holders, 1)).astype(np.int64)))
            told = fresh & ((holders > 1) | hot)[run]
            names, ids, sizes = names_of(np.full(int(told.sum()), current), low[told], level[run[told]]), ids[told], sizes[told]
        used, at = np.unique(ids, return_index=True)
        if len(used):
            yield _packed(list(_by_bucket(_deal(ids, buckets), buckets, names, np.searchsorted(used, ids), used, sizes[at])))


def _choose_elements(batches: Iterator[pa.RecordBatch], buckets: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """What sets share, by their buckets -> of each set the rarest elements that must hold a shared one, by element; of a task's sets with one only the least, linked (bucket -1)."""
    for _, held in _bucket_runs(batches):
        names, ids, sizes = _unpacked(held)
        order = np.lexsort((names, ids))
        names, ids, sizes = names[order], ids[order], sizes[order]
        fresh = np.concatenate([[True], (names[1:] != names[:-1]) | (ids[1:] != ids[:-1])])  # copies tell the same
        names, ids, sizes = names[fresh], ids[fresh], sizes[fresh]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(ids)]]))
        p, common = bounds_of(sizes[starts], num, den)
        wanted = (p - common + 1) - (p - counts)  # elements of one holder come first
        chosen = np.arange(len(ids)) - np.repeat(starts, counts) < np.repeat(wanted, counts)
        names, ids = names[chosen], ids[chosen]
        if not len(ids):
            continue
        order = np.lexsort((ids, names))
        names, ids = names[order], ids[order]
        first = np.concatenate([[True], names[1:] != names[:-1]])
        least = ids[first][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([ids[~first], least[~first]], 1), axis=0)
        used, owners = np.unique(ids[first], return_inverse=True)
        rows = list(_by_bucket(_deal(mix(names[first]), buckets), buckets, names[first], owners, used, np.zeros(len(used), np.int64)))
        if len(pairs):
            rows.append((-1, b"", b"", pairs.astype("<i8").tobytes(), b""))
        yield _packed(rows)


def _link_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements by their buckets -> links (a, b) of sets with an equal one."""
    for current, held in _bucket_runs(batches):
        if current < 0:
            pairs = np.concatenate([np.frombuffer(r[2], "<i8").reshape(-1, 2) for r in held])
        else:
            names, ids, _ = _unpacked([(*r[:3], b"\0" * (len(r[2]) // 2)) for r in held])
            order = np.lexsort((ids, names))
            names, ids = names[order], ids[order]
            first = np.concatenate([[True], names[1:] != names[:-1]])
            least = ids[first][np.cumsum(first) - 1]
            apart = ids != least
            pairs = np.stack([ids[apart], least[apart]], 1)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def _loose_groups(rows: DataFrame, n: int, buckets: int, num: int, den: int) -> DataFrame:
    """Components (node, component), by short ids, of links that connect all sets that link with each other and few more."""
    salted = lambda df: df.withColumn("salt", F.when(F.col("bucket") < 0, F.xxhash64("names", "sets")).otherwise(F.lit(0))).repartition(max(buckets, 2), "bucket", "salt").sortWithinPartitions("bucket").drop("salt")
    sent = map_arrow(rows.select("_text"), lambda it: _pack_prefixes(it, n, buckets, num, den), _PACKED)
    told = map_arrow(salted(sent), lambda it: _count_holders(it, buckets), _PACKED)
    chosen = map_arrow(salted(told), lambda it: _choose_elements(it, buckets, num, den), _PACKED)
    return components(salted(chosen), _link_holders, "bigint")


def _join_groups(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task -> links (a, b) of the exact join, as many as connect what it connects."""
    ids: list[bytes] = []
    texts: list[bytes] = []
    sides: list[int] = []
    current, found = None, []

    def flush() -> None:
        _, one, other = current
        if one == other:
            found.extend((ids[a], ids[b]) for a, b in forest(shingle_sets(texts, n), None, num, den))
        elif len(set(sides)) == 2:  # two blocks; their own tasks join what is within each
            found.extend((ids[a], ids[b]) for a, b in forest(shingle_sets(texts, n), np.array(sides, np.int64), num, den))

    for batch in batches:
        for group, one, other, side, ident, text in zip(*(batch.column(c).to_pylist() for c in ("group", "one", "other", "side", "set")), batch.column("_text").cast(pa.binary()).to_pylist()):
            task = (group, one, other)
            if task != current:
                if ids:
                    flush()
                current, ids, texts, sides = task, [], [], []
            if ids and ids[-1] == ident and sides[-1] == side:
                continue  # the class's member is a repeated row
            ids.append(ident)
            texts.append(text or b"")
            sides.append(side)
        if len(found) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])
            found = []
    if ids:
        flush()
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def _sent(df: DataFrame, count: int) -> DataFrame:
    """df for a join with texts, which then stay where they are if df has KEYS rows at most."""
    return F.broadcast(df) if count <= KEYS else df


def _same_row(a: DataFrame, b: DataFrame):
    return a["_k"].eqNullSafe(b["_k"]) & (a["_x"] == b["_x"])


def _probe_hubs(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (set, text, hubs of its group) -> links (a, b) of the set to hubs."""
    held: dict[bytes, np.ndarray] = {}
    for batch in text_chunks(batches, "_text"):
        sets = shingle_sets([t or b"" for t in batch.column("_text").cast(pa.binary()).to_pylist()], n)
        a, b = [], []
        for own, ident, hubs in zip(sets, batch.column("set").to_pylist(), batch.column("hubs").to_pylist()):
            for h in hubs:
                if h["hub"] not in held:
                    if len(held) > 64:
                        held.clear()
                    held[h["hub"]] = shingle_sets([(h["text"] or "").encode("utf-8", "surrogatepass")], n)[0]
                hub = held[h["hub"]]
                overlap = len(np.intersect1d(own, hub, assume_unique=True))
                if h["hub"] != ident and overlap >= needed(len(own), len(hub), num, den):
                    a.append(ident)
                    b.append(h["hub"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _hub_links(rows: DataFrame, large: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links of the members of large groups to HUBS members of each, picked by hashes: a row a member and hub at most."""
    picks = [F.min(F.struct(F.xxhash64("set", F.lit(i)).alias("h"), "set")).alias(f"h{i}") for i in range(HUBS)]
    hubs = checkpoint(large.groupBy("group").agg(*picks).select(F.explode(F.array(*(F.col(f"h{i}.set") for i in range(HUBS)))).alias("set")).distinct())
    texts = rows.join(_sent(hubs, hubs.count()), "set").groupBy("group", "set").agg(F.first("_text").alias("text")).groupBy("group").agg(F.collect_list(F.struct(F.col("set").alias("hub"), "text")).alias("hubs"))
    texts = checkpoint(texts)
    size = texts.agg(F.sum(F.aggregate("hubs", F.lit(0).cast("long"), lambda t, h: t + F.octet_length(h["text"])))).first()[0] or 0
    return map_arrow(rows.join(F.broadcast(texts) if size <= HUB_BYTES else texts, "group").select("set", "_text", "hubs"), lambda it: _probe_hubs(it, n, num, den), _LINKS)


def _block_tasks(large: DataFrame, joined: DataFrame, block: int) -> DataFrame:
    """set and the tasks (one, other, side) of the members of large groups.

    What hubs have joined into a group's largest part needs no tests within; the rest is tested against itself and
    against that part, block by block. So a group of near copies costs about as many tasks as it has blocks.
    """
    known = large.join(joined.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("part", F.coalesce("component", "set"))
    weights = known.groupBy("group", "part").agg(F.sum("n").alias("w"))
    totals = weights.groupBy("group").agg(F.max(F.struct("w", "part")).alias("top"), F.sum("w").alias("all"))
    cut = lambda w: F.ceil(w / F.lit(block)).cast("int")
    counts = totals.select("group", F.col("top.part").alias("main"), cut(F.col("top.w")).alias("inner"), cut(F.col("all") - F.col("top.w")).alias("outer"))
    placed = known.join(counts, "group").withColumn("_main", F.col("part") == F.col("main"))
    own = lambda blocks: F.pmod(F.xxhash64("set", F.lit(7)), F.greatest(blocks, F.lit(1)).cast("bigint")).cast("int")
    upto = lambda blocks: F.slice(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1))), F.lit(1), blocks)
    task = lambda one, other, side: F.struct(one.cast("int").alias("one"), other.cast("int").alias("other"), side.cast("int").alias("side"))
    mine = F.col("_own")
    inside = F.transform(upto(F.col("outer")), lambda b: task(F.least(b, mine), F.greatest(b, mine), mine > b))
    across = F.transform(upto(F.col("inner")), lambda c: task(mine, F.col("outer") + c, F.lit(0)))
    back = F.transform(upto(F.col("outer")), lambda i: task(i, F.col("outer") + mine, F.lit(1)))
    placed = placed.withColumn("_own", F.when(F.col("_main"), own(F.col("inner"))).otherwise(own(F.col("outer"))))
    return placed.select("set", F.when(F.col("_main"), back).otherwise(F.concat(inside, across)).alias("tasks")).where(F.size("tasks") > 0)


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, block: int = BLOCK, num: int = NUM, den: int = DEN) -> DataFrame:
    """key, n_shingles and component_id (the least key that links of den * |x & y| >= num * |x | y| reach) of each row."""
    if not 0 < num <= den:
        raise ValueError(f"{num} / {den} is no threshold")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_x"), F.col(text).cast("string").alias("_text"))
    described = checkpoint(map_arrow(rows, lambda it: _describe(it, n), f"_k {kind}, _x bigint, n bigint, set binary"))
    total = described.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-int(min(1.0, 2.5 * (den - num) / den) * total) // BUCKET))
    loose = _loose_groups(rows, n, buckets, num, den).select(F.col("node").alias("short"), F.col("component").alias("group"))
    classes = described.where("n > 0").groupBy("set").agg(F.min(F.struct("_k", "_x")).alias("one"), F.min("n").alias("n"), F.min("_k").alias("least"))
    short = F.conv(F.hex(F.substring("set", 1, 8)), 16, -10).cast("bigint")
    members = checkpoint(classes.withColumn("short", short).join(loose, "short").select("set", "group", "n", F.col("one._k").alias("_k"), F.col("one._x").alias("_x")))
    sizes = members.groupBy("group").agg((F.floor(F.sum("n") / F.lit(block)) + 1).cast("int").alias("blocks"))
    count = members.count()
    members = members.join(sizes, "group")
    wanted = _sent(members.select("set", "group", "blocks", "_k", "_x"), count)
    rows = checkpoint(rows.join(wanted, _same_row(rows, wanted)).select("set", "group", "blocks", "_text"))  # texts know their sets, so they need no join by key again
    zero = F.lit(0)
    dealt = rows.where("blocks = 1").select("group", zero.alias("one"), zero.alias("other"), zero.alias("side"), "set", "_text")
    hub_links = None
    large = members.where("blocks > 1")
    if not large.isEmpty():
        rows = rows.where("blocks > 1")
        hub_links = checkpoint(_hub_links(rows, large, n, num, den))
        tasks = checkpoint(_block_tasks(large, components(hub_links), block))
        tasks = _sent(tasks, tasks.agg(F.sum(F.size("tasks"))).first()[0] or 0)
        dealt = dealt.unionByName(rows.join(tasks, "set").select("group", "set", "_text", F.explode("tasks").alias("u")).select("group", "u.one", "u.other", "u.side", "set", "_text"))
    dealt = dealt.repartition("group", "one", "other").sortWithinPartitions("group", "one", "other", "set", "side")
    joined = components(dealt, lambda it: _join_groups(it, n, num, den), "binary", hub_links).select(F.col("node").alias("set"), "component")
    least = classes.join(joined, "set").groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = joined.join(least, "component").select("set", "component_id").unionByName(classes.join(joined, "set", "left_anti").select("set", F.col("least").alias("component_id")))
    full = described.where("n > 0").join(checkpoint(labelled), "set").select("_k", "n", "component_id")
    empty = described.where("n = 0").select("_k", "n", F.col("_k").alias("component_id"))
    return full.unionByName(empty).select(F.col("_k").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES: dict[str, str] = {}
