"""Exact self-join of word-shingle sets by Jaccard similarity, with set-relation skipping.

Sets with equal members are one class. Two similar sets share one of the first members of each, in any order that
all sets follow; the order here is rarest first. Counting every shingle would move more than the texts, so a part of
the shingles, chosen by hash and larger than a prefix, comes first and is counted exactly; behind it come the
others by hash, and last those that a count sketch over all texts calls hot. What one set has alone is in no list
and only moves the positions of the rest.

Index-level skipping: the entries of a list stand by set size and then by position, so each size is a block. From
an entry's position and size follows the last position of a block that can still reach the threshold, and the rest of
the block is skipped.

Answer-level skipping: of each list, every set is first compared with a few leaders. Similar sets join its component,
and their differences from the leader are kept. What a leader has answered for two sets is then derived for the pair:
their distances from it bound the distance between them from both sides, and where the bounds leave it open,
the symmetric difference of the two short differences is that of the sets, so the sets are not fetched again.
The question is what links reach, so a list whose sets are all in one component is done, and of the others only
pairs between components are looked at. Where a list has very many such pairs, each set is first asked for its nearest
ones; the rest is looked at again once these links have joined components, with more pairs each time, until a pass has
left none out. No candidate is dropped otherwise, and every link is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Bloom, Rolling, blocks, components, frugal, materialize, mix64, salted_join, salted_lookup, utf8

BLOCK = 1 << 20
#: Counters of the sketch that tells hot shingles and the segments it is summed in; hot: over WELL + TIMES the mean counter.
COUNTERS, SEGMENTS, WELL, TIMES = 1 << 19, 16, 64, 8
#: The share of shingles that is counted exactly, as a multiple of a prefix's share; counts above MANY are alike.
COUNTED, MANY = 2.5, 4096
#: Entries of a list that are compared in one place, members of sets that are verified in one place, pairs held at once.
CHUNK, LOAD, PAIRS = 4096, 1 << 20, 1 << 20
#: Rounds with leaders, leaders of a list in each; a difference from one is kept if it has at most the share KEPT of both sets.
ROUNDS, LEADERS, KEPT = 1, 4, 0.25
#: Pairs that a set is asked for in the first pass over a list that has more than FEW pairs, and more than that many a set; GROWTH times as many in each later pass.
NEAREST, FEW, GROWTH = 2, 4096, 8
#: Stands for a null doc_id.
NULL_ID = -(2**63)
#: Words longer than this are hashed on their own: a polynomial modulo 2**64 has known collisions from 1024 bytes on.
LONG_WORD = 256

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int):
    """The sorted distinct shingle hashes of each text laid end to end."""
    data = _lower[data]
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = _space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    word = ~edge
    start = np.flatnonzero(word[:-1] & (np.append(True, edge[:-2]) | cut[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word[:-1] & (edge[1:] | cut[1:])) + 1 if len(data) else start
    hashes = Rolling(data)(start, end) if len(start) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    bound = np.searchsorted(start, at)
    sums = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        sums += hashes[j : j + len(sums)] * (_odd[j % 5] + np.uint64(2 * j))
    sums = mix64(sums)
    for i in range(len(at) - 1):
        a, b = bound[i], bound[i + 1]
        if b - a >= k:
            yield np.unique(sums[a : b - k + 1])
        elif b > a:
            few = np.zeros(1, np.uint64)
            for j in range(b - a):
                few += hashes[a + j : a + j + 1] * (_odd[j % 5] + np.uint64(2 * j))
            yield mix64(few + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _each(batches, k: int):
    """(batch, text number, set) for all texts, block by block."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for first, last in blocks(at, BLOCK):
            for i, s in enumerate(shingle_sets(data[at[first] : at[last]], at[first : last + 1] - at[first], k)):
                yield batch, first + i, s


def class_of(s: np.ndarray, seed: int = 0) -> int:
    """A set's class: a 64-bit sum over its members."""
    return int((mix64(s ^ _odd[0] ^ np.uint64(seed)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64))


def _fresh(batches, k: int, seed: int):
    """(class, set) of the non-empty texts, mostly without classes that the task has seen."""
    seen: set[int] = set()
    for _, _, s in _each(batches, k):
        if len(s) and (node := class_of(s, seed)) not in seen:
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(node)
            yield node, s


class Threshold:
    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n):
        """Members that a set of n must share with any similar one."""
        return -(-self.num * n // self.den)

    def shared(self, n, m):
        """Members that sets of n and m must share."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def counted(self) -> int:
        """Of 1024 values of a shingle's last bits, those that are counted exactly."""
        return min(1024, int(1024 * COUNTED * (1 - self.num / self.den)) + 1)


SCAN = "doc_id bigint, n int, node bigint, twin bigint, mark binary, sketch binary, segment int, counts binary"


def sketch_of(s: np.ndarray) -> np.ndarray:
    """A bit for each member, rounded up to a power of two: set where an odd count of members falls on it.

    Bits that differ between two sets are at most the members that one of both has.
    """
    size = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(10)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch (bytes) that a set would have with fewer bits (bytes)."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _scan(k: int, seed: int):
    """Per text: doc_id, set size, class, a second hash of the set, sketch; per task the counts of its shingles, in segments."""
    width, names = COUNTERS // SEGMENTS, [x.split()[0] for x in SCAN.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches):
        counts, slots, held, rows, seen = np.zeros(COUNTERS, np.int64), [], 0, [], set()
        ids, marks, last = [], [], None

        def flush():
            arrays = [pa.array(c, x) for c, x in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names)

        for batch, i, s in _each(batches, k):
            if batch is not last:
                ids, marks, last = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch
            node = class_of(s, seed)
            rows.append((ids[i], len(s), node, class_of(s, seed + 0x5BD1E995), marks[i], sketch_of(s).tobytes()))
            if len(s) and node not in seen:
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(node)
                slots.append((s >> np.uint64(45)).astype(np.int32))
                held += len(s)
                if held >= 1 << 20:
                    counts += np.bincount(np.concatenate(slots), minlength=COUNTERS)
                    slots, held = [], 0
            if len(rows) >= 4096:
                yield flush()
                rows.clear()
        if rows:
            yield flush()
        if slots:
            counts += np.bincount(np.concatenate(slots), minlength=COUNTERS)
        for g in range(SEGMENTS):
            part = np.minimum(counts[g * width : (g + 1) * width], 2**32 - 1).astype(np.uint32)
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x) for x in types), pa.array([g], pa.int32()), pa.array([part.tobytes()], pa.binary())], names)

    return run


def _hot_bits(batches):
    """Sums a segment's counts over the tasks; one bit a counter, set where it is hot."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for g, raw in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(raw, np.uint32).astype(np.int64)
            sums[g] = sums[g] + part if g in sums else part
    for g, part in sums.items():
        bits = np.packbits(part > WELL + TIMES * part.mean()).tobytes()
        yield pa.RecordBatch.from_pydict({"segment": pa.array([g], pa.int32()), "bits": pa.array([bits], pa.binary())})


class Order:
    """The order of a set's members: the counted ones, the others by hash, the hot ones by hash."""

    def __init__(self, hot: np.ndarray, counted: int):
        self.hot, self.counted = hot, counted

    def split(self, s: np.ndarray):
        """(the counted members, the rest in order)."""
        slot = s >> np.uint64(45)
        hot = (self.hot[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1
        first = ~hot & ((s & np.uint64(1023)) < self.counted)
        return s[first], np.concatenate([s[~first & ~hot], s[hot]])


def _index(k: int, t: Threshold, order, seed: int):
    """(shingle, class, place) of every counted member, place: how many the set has; and of what a prefix needs besides them, place: -1 - position."""
    names = ["shingle", "node", "place"]

    def run(batches):
        parts, size = [], 0
        for node, s in _fresh(batches, k, seed):
            first, rest = order.value.split(s)
            rest = rest[: max(0, len(s) - int(t.least(len(s))) + 1 - len(first))]
            place = np.concatenate([np.full(len(first), len(first)), -1 - len(first) - np.arange(len(rest))]).astype(np.int32)
            parts.append((np.concatenate([first, rest]).view(np.int64), np.full(len(place), node), place))
            size += len(place)
            if size >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)
                parts, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)

    return run


def _shared(batches):
    """Rows of _index by shingle and class: the counted that several classes have, with their number, MANY at most; the others with 0.

    At most MANY rows of a shingle are held: from then on its number is known.
    """
    names = ["shingle", "node", "place", "classes"]
    held, full, last = [np.zeros(0, np.int64)] * 3, None, None  # rows of the last shingle; it, once it has MANY; the row before

    def out(cols, classes):
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:2]), pa.array(cols[2].astype(np.int32)), pa.array(classes.astype(np.int32))], names)

    def several(cols):
        head = np.ones(len(cols[0]), bool)
        head[1:] = cols[0][1:] != cols[0][:-1]
        group = np.cumsum(head) - 1
        size = np.minimum(np.bincount(group)[group], MANY)
        keep = size > 1
        if keep.any():
            yield out([c[keep] for c in cols], size[keep])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[:3]]
        other = cols[2] < 0
        if other.any():
            yield out([c[other] for c in cols], np.zeros(other.sum()))
            cols = [c[~other] for c in cols]
        if not len(cols[0]):
            continue
        shingle, node = cols[:2]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
        new[0] = last != (shingle[0], node[0])
        last = (shingle[-1], node[-1])
        cols = [c[new] for c in cols]
        if full is not None:
            more = int(np.searchsorted(cols[0], full, "right"))
            if more:
                yield out([c[:more] for c in cols], np.full(more, MANY))
                cols = [c[more:] for c in cols]
            if len(cols[0]):
                full = None
        cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if len(cols[0]) - cut >= MANY:
            full, cut = cols[0][-1], len(cols[0])
        held = [c[cut:] for c in cols]
        if cut:
            yield from several([c[:cut] for c in cols])
    if len(held[0]):
        yield from several(held)


def _groups(batches, names: list[str]):
    """Rows sorted by the first column, regrouped so that no value of it is split over two yields."""
    held = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None and len(held[0]):
        yield held


ENTRY = ["deal", "node", "n", "pos", "root", "probe", "sketch"]
PAIR = "a bigint, na int, b bigint, nb int"


class Sketches:
    """Sketches of many sets, in one table for each size, folded to that of the smaller of two."""

    def __init__(self, raw):
        self.raw, self.size = [np.frombuffer(x, np.uint8) for x in raw], np.array([len(x) for x in raw], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, size: int, rows: np.ndarray):
        """The words of the rows' sketches at a size, and where each row stands."""
        if size not in self.tables:
            own = np.flatnonzero((self.size >= size) & (self.size <= 2 * size))
            place = np.zeros(len(self.size), np.int64)
            place[own] = np.arange(len(own))
            self.tables[size] = place, np.stack([folded(self.raw[i], size) for i in own]).view(np.uint64)
        place, words = self.tables[size]
        return words[place[rows]]

    def differ(self, x: np.ndarray, y: np.ndarray, other: Sketches) -> np.ndarray:
        """Members that one of rows x here and y there has, at least. Sketch sizes differ by a factor of two at most where it is not 0."""
        size, far = np.minimum(self.size[x], other.size[y]), np.maximum(self.size[x], other.size[y])
        found = np.zeros(len(x), np.int64)
        told = far <= 2 * size  # else possible for small thresholds only
        for one in np.unique(size[told]):
            rows = np.flatnonzero((size == one) & told)
            step = max(1, (PAIRS << 2) // int(one))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                found[r] = np.bitwise_count(self._table(int(one), x[r]) ^ other._table(int(one), y[r])).sum(1, dtype=np.int64)
        return found

    def close(self, t: Threshold, x: np.ndarray, y: np.ndarray, other: Sketches, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether rows x here and y there may be similar: sizes n and m."""
        return self.differ(x, y, other) <= n + m - 2 * t.shared(n, m)


def _close(t: Threshold):
    """The pairs (a, na, b, nb) whose sketches allow it."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                n, m = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
                one, two = (Sketches(part.column(c).to_pylist()) for c in ("sketch_a", "sketch_b"))
                rows = np.arange(len(n))
                ok = one.close(t, rows, rows, two, n, m)
                yield part.select(["a", "na", "b", "nb"]).filter(pa.array(ok))

    return run


def nearest(cols: list[np.ndarray], each: int) -> list[np.ndarray]:
    """Of pairs (entry, size, probe, size, distance) the ``each`` nearest of every probe; of equally near entries those whose hash is least."""
    order = np.lexsort((mix64(cols[0].view(np.uint64)), cols[4], cols[2]))
    probe = cols[2][order]
    head = np.flatnonzero(np.append(True, probe[1:] != probe[:-1]))
    nth = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return [c[order[nth < each]] for c in cols]


def _outside(t: Threshold, each: int | None):
    """Pairs (entry, probe) of a deal whose components differ, block by block. Probes are searched among the other rows.

    each: a deal with more than FEW pairs, and more than ``each`` a row, gives the ``each`` nearest of every probe, and
    the task a row with na -1 that says so. None: all pairs.
    """

    def out(found):
        cols = [np.concatenate(c) for c in zip(*found)]
        order = np.lexsort((cols[0], cols[2]))
        cols = [c[order] for c in cols]
        new = np.ones(len(order), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])
        return pa.RecordBatch.from_arrays([pa.array(c[new].astype(np.int32) if i % 2 else c[new]) for i, c in enumerate(cols)], ["a", "na", "b", "nb"])

    def one(cols):
        probe = cols[5]
        p_node, p_n, p_pos, p_root = (c[probe].astype(np.int64) for c in cols[1:5])
        node, n, pos, root = (c[~probe].astype(np.int64) for c in cols[1:5])
        if not len(p_node) or not len(node):
            return
        order = np.lexsort((pos, n))
        node, n, pos, root = node[order], n[order], pos[order], root[order]
        p_sketch, sketch = Sketches(cols[6][probe]), Sketches(cols[6][~probe][order])
        sizes, first = np.unique(n, return_index=True)
        far = 1 << 32
        place = n * far + pos
        low = np.searchsorted(sizes, -(-t.num * p_n // t.den))
        count = np.searchsorted(sizes, p_n * t.den // t.num, "right") - low
        ends, at = np.cumsum(count), 0
        while at < len(p_node):  # as many probes at once as have 4096 blocks in reach
            stop = at + max(1, int(np.searchsorted(ends[at:] - (ends[at - 1] if at else 0), 4096, "right")))
            c = count[at:stop]
            p = np.repeat(np.arange(at, stop), c)
            s = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:stop], c)
            m = sizes[s]
            need = t.shared(p_n[p], m)
            begin = first[s]  # behind position m - need of a block nothing can reach the threshold
            until = np.where((p_n[p] - p_pos[p] >= need) & (m >= need), np.searchsorted(place, m * far + m - need, "right"), begin)
            width = np.maximum(until - begin, 0)
            done, total = 0, np.cumsum(width)
            while done < len(p):
                upto = done + max(1, int(np.searchsorted(total[done:] - (total[done - 1] if done else 0), PAIRS, "right")))
                w = width[done:upto]
                x = np.repeat(p[done:upto], w)
                y = np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[done:upto], w)
                other = p_root[x] != root[y]
                x, y = x[other], y[other]
                if len(x):
                    away = p_sketch.differ(x, y, sketch)
                    ok = away <= p_n[x] + n[y] - 2 * t.shared(p_n[x], n[y])
                    x, y, away = x[ok], y[ok], away[ok]
                if len(x):
                    yield node[y], n[y], p_node[x], p_n[x], away
                done = upto
            at = stop

    def cut(cols):
        """(pairs, whether none is left out) of a deal, PAIRS or so at a time."""
        most, held, size, total = max(FEW, each * len(cols[0])), [], 0, 0

        def part():
            pairs = [np.concatenate(c) for c in zip(*held)]
            return (pairs, True) if total <= most else (nearest(pairs, each), False)

        for pairs in one(cols):
            held.append(pairs)
            size += len(pairs[0])
            total += len(pairs[0])
            if size >= PAIRS:
                yield part()
                held, size = [], 0
        if held:
            yield part()

    def run(batches):
        left = False
        for cols in _groups(batches, ENTRY):
            head = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            found, size = [], 0
            for a, b in zip(head, np.append(head[1:], len(cols[0]))):
                deal = [c[a:b] for c in cols]
                for pairs, whole in ((p, True) for p in one(deal)) if each is None else cut(deal):
                    found.append(pairs[:4])
                    size += len(pairs[0])
                    left |= not whole
                    if size >= PAIRS:
                        yield out(found)
                        found, size = [], 0
            if found:
                yield out(found)
        if left:
            yield out([[np.zeros(1, np.int64), np.full(1, -1)] * 2])

    return run


def _sets(k: int, seed: int, asked):
    """(node, members) of the texts whose id may be among those asked for."""

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(asked.value.passes(batch.column("id").to_numpy(zero_copy_only=False))))

    def run(batches):
        rows, size = [], 0

        def flush():
            sizes = np.array([len(s) for _, s in rows], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([s for _, s in rows])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists], ["node", "members"])

        for node, s in _fresh(chosen(batches), k, seed):
            rows.append((node, np.sort(s.view(np.int64))))
            size += len(s)
            if size >= 1 << 17:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return run


VERIFIED = PAIR + ", distance int, linked boolean, difference array<bigint>"


def _measure(t: Threshold, differences: bool, keep: bool):
    """Rows by deal, first the members of its sets (b null), then its pairs: distance (members that one of both has), linked.

    differences: the members are the sets' differences from one leader, whose own difference is that of the sets.
    keep: gives the difference of a pair as well, where it is short.
    """

    def run(batches):
        deal, sets = None, {}
        for batch in batches:
            found = []
            members = batch.column("members")
            offsets, values = members.offsets.to_numpy(), members.flatten().to_numpy(zero_copy_only=False)
            names = ("deal", "a", "na", "b", "nb")
            for i, (d, a, na, b, nb) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if d != deal:
                    deal, sets = d, {}
                if b is None:
                    sets[a] = values[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]].copy()
                    continue
                x, y = sets[a], sets[b]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int((y[at] == x).sum()) if len(y) else 0
                distance = len(x) + len(y) - 2 * same
                linked = (na + nb - distance) // 2 >= t.shared(na, nb)
                short = keep and distance <= KEPT * (na + nb)
                found.append((a, na, b, nb, distance, linked, np.setxor1d(x, y, assume_unique=True) if short else None))
            if found:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*found), types)], ["a", "na", "b", "nb", "distance", "linked", "difference"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, t: Threshold, parts: int, differences: bool = False, keep: bool = False) -> DataFrame:
    """VERIFIED of the pairs. They are dealt by b; a b whose partners have many members is dealt on by a."""
    loads = salted_lookup(pairs, ["b"], [("load", F.sum("na"), F.sum)])
    split = F.pmod(F.xxhash64("a"), F.ceil(F.col("load") / LOAD))
    dealt = materialize(loads.select(F.xxhash64("b", split).alias("deal"), "a", "na", "b", "nb"), "dealt-pairs")
    needs = dealt.select("deal", F.col("a").alias("node")).unionByName(dealt.select("deal", F.col("b").alias("node"))).distinct()
    none = F.lit(None)
    # repeated texts may give a set twice; one is enough
    carried = needs.join(sets, "node").select("deal", F.col("node").alias("a"), none.cast("int").alias("na"), none.cast("bigint").alias("b"), none.cast("int").alias("nb"), "members")
    rows = carried.unionByName(dealt.withColumn("members", F.array().cast("array<bigint>")))
    met = rows.repartition(parts, "deal").sortWithinPartitions("deal", F.col("b").asc_nulls_first())
    return met.mapInArrow(frugal(_measure(t, differences, keep)), VERIFIED)


class _Join:
    """The steps of a join over one table of texts."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, mark=None):
        self.k, self.t, self.spark = k, Threshold(num, den), docs.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(None).cast("binary") if mark is None else mark).alias("mark"))
        self.seed = 0
        while True:  # classes are verified by a second hash; should two sets share one, they are made anew
            scanned = materialize(self.texts.mapInArrow(frugal(_scan(k, self.seed)), SCAN), "shingle-scan")
            self.facts = scanned.where("segment IS NULL").drop("segment", "counts")
            known = self.facts.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), (F.min("twin") != F.max("twin")).alias("several"))
            self.classes = materialize(known, "classes")
            if self.classes.where("several").isEmpty():
                break
            self.seed += 1
        sums = scanned.where("segment IS NOT NULL").select("segment", "counts").repartition(SEGMENTS, "segment")
        bits = np.zeros(COUNTERS // 8, np.uint8)
        for g, raw in sums.mapInArrow(frugal(_hot_bits), "segment int, bits binary").collect():  # 64 kB in all
            part = np.frombuffer(raw, np.uint8)
            bits[g * len(part) : (g + 1) * len(part)] = part
        self.order = self.spark.sparkContext.broadcast(Order(bits, self.t.counted()))

    def entries(self) -> DataFrame:
        """The index: (shingle, node, n, pos) of the prefixes, without what one class has alone of the counted."""
        rows = self.texts.select("text").mapInArrow(frugal(_index(self.k, self.t, self.order, self.seed)), "shingle bigint, node bigint, place int")
        spread = F.when(F.col("place") < 0, F.xxhash64("node", "shingle")).otherwise(F.col("shingle"))
        rows = rows.repartition(self.parts, spread).sortWithinPartitions("shingle", "node").mapInArrow(frugal(_shared), "shingle bigint, node bigint, place int, classes int")
        own, counted = Window.partitionBy("node"), F.col("place") >= 0
        rows = rows.join(self.classes.select("node", "n"), "node")
        nth, all_ = F.row_number().over(own.orderBy((~counted).cast("int"), "classes", "shingle")), F.sum(counted.cast("int")).over(own)
        pos = F.when(counted, F.col("place") - all_ + nth - 1).otherwise(-1 - F.col("place"))
        prefix = F.col("n") - F.ceil(F.lit(self.t.num) * F.col("n") / F.lit(self.t.den)) + 1
        return materialize(rows.select("shingle", "node", "n", pos.cast("int").alias("pos")).where(F.col("pos") < prefix).distinct(), "prefix-entries")

    def sketches(self, nodes: DataFrame) -> DataFrame:
        """(node, sketch) of the classes in a frame of nodes."""
        return self.facts.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches allow it."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        known = materialize(self.sketches(ends), "pair-sketches")
        for side in "ab":
            pairs = salted_join(pairs, side, known.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")))
        return materialize(pairs.mapInArrow(frugal(_close(self.t)), PAIR), "close-pairs")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(node, members) of the classes in the pairs, from one text of each."""
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        asked = Bloom.of(self.classes.join(nodes, "node", "left_semi").select(F.coalesce("least", F.lit(NULL_ID)).alias("id")))
        texts = self.texts.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
        return texts.mapInArrow(frugal(_sets(self.k, self.seed, self.spark.sparkContext.broadcast(asked))), "node bigint, members array<bigint>")

    def _reaches(self, n, i, m, j):
        """Whether entries (size, position) may belong to similar sets."""
        need = F.ceil(F.lit(self.t.num) * (n + m) / F.lit(self.t.num + self.t.den))
        return (F.lit(self.t.den) * F.least(n, m) >= F.lit(self.t.num) * F.greatest(n, m)) & (F.least(n - i, m - j) >= need)

    def open_entries(self, entries: DataFrame, roots: DataFrame) -> DataFrame:
        """The entries of the lists that hold several components, with root, the list's most frequent one, its entries (held) and the list's size."""
        entries = materialize(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-entries")
        parts = entries.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("size"))
        lists = parts.groupBy("shingle").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("kinds"))
        lists = lists.where("kinds > 1").select("shingle", F.col("most.root").alias("most"), F.col("most.size").alias("held"), "size")
        return materialize(salted_join(entries, "shingle", lists).where("size IS NOT NULL"), "open-entries")

    def with_leaders(self, rows: DataFrame, nth: int) -> DataFrame:
        """Each set of a list with LEADERS of it of other components, chosen by hash: from the most frequent component, if
        that has half of the list, and else from all sets, so that rounds differ while components are small."""
        own = [F.col(c) for c in ("node", "n", "pos", "root")]
        leads = [F.struct(((F.col("root") != F.col("most")) & (2 * F.col("held") >= F.col("size"))).alias("other"), F.xxhash64(F.lit(nth * LEADERS + i), "node").alias("h"), *own) for i in range(LEADERS)]
        rows = salted_lookup(rows, ["shingle"], [(f"lead{i}", F.min(lead), F.min) for i, lead in enumerate(leads)])
        rows = rows.select(*[c for c in rows.columns if not c.startswith("lead")], F.explode(F.array(*[f"lead{i}" for i in range(LEADERS)])).alias("lead"))
        rows = rows.where("root != lead.root").where(self._reaches(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        return materialize(rows.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("lead.node").alias("b"), F.col("lead.n").alias("nb")).distinct(), "leader-pairs")

    def between(self, rows: DataFrame, each: int | None = None) -> tuple[DataFrame, bool]:
        """Candidates between components, and whether they are all. Sets outside the most frequent component of a list
        are its probes; each pair has one. A list of over CHUNK entries is dealt out in chunks, and its probes go to
        each. each: what a probe is asked for in lists with very many pairs; None: everything."""
        rows = materialize(salted_join(rows, "node", self.sketches(rows)), "open-entries")
        chunks = F.ceil(F.col("size") / CHUNK)
        same = ["node", "n", "pos", "root", "sketch"]
        base = rows.select(F.xxhash64("shingle", F.pmod(F.xxhash64("node"), chunks)).alias("deal"), *same, F.lit(False).alias("probe")).select(*ENTRY)
        probes = rows.where("root != most").select(F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"), "shingle", *same)
        probes = probes.select(F.xxhash64("shingle", "chunk").alias("deal"), *same, F.lit(True).alias("probe")).select(*ENTRY)
        dealt = base.unionByName(probes).repartition(self.parts, "deal").sortWithinPartitions("deal", "n", "pos", "node")
        found = dealt.mapInArrow(frugal(_outside(self.t, each)), PAIR)
        # a pair of two probes comes from either side
        low, high = (F.struct(F.col(x).alias("node"), F.col(n).alias("n")) for x, n in (("a", "na"), ("b", "nb")))
        turned = found.select(F.least(low, high).alias("x"), F.greatest(low, high).alias("y")).distinct()
        pairs = materialize(turned.select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb")), "between-pairs")
        return pairs.where("na >= 0"), each is None or pairs.where("na < 0").isEmpty()

    def derived(self, pairs: DataFrame, led: DataFrame) -> DataFrame:
        """VERIFIED of the pairs; led: VERIFIED of sets with leaders, from which answers are derived where they can be."""
        own = led.where("difference IS NOT NULL").groupBy("a").agg(F.min_by(F.struct("b", "distance", "difference"), F.struct("distance", "b")).alias("l"))
        own = own.select(F.col("a").alias("node"), F.col("l.b").alias("leader"), F.col("l.distance").alias("away"), F.col("l.difference").alias("members"))
        heads = own.select(F.col("leader").alias("node")).distinct().join(own.select("node"), "node", "left_anti")
        own = materialize(own.unionByName(heads.select("node", F.col("node").alias("leader"), F.lit(0).alias("away"), F.array().cast("array<bigint>").alias("members"))), "leaders")
        rows = pairs
        for side in "ab":
            near = own.select(F.col("node").alias(side), F.col("leader").alias(f"leader_{side}"), F.col("away").alias(f"away_{side}"))
            rows = salted_join(rows, side, near)
        rows = materialize(rows, "led-pairs")
        n = F.col("na") + F.col("nb")
        need = F.ceil(F.lit(self.t.num) * n / F.lit(self.t.num + self.t.den))
        most, least = F.floor((n - F.abs(F.col("away_a") - F.col("away_b"))) / 2), F.floor((n - F.col("away_a") - F.col("away_b")) / 2)
        led_by_one = F.coalesce(F.col("leader_a") == F.col("leader_b"), F.lit(False))
        cols = ["a", "na", "b", "nb"]
        sure = rows.where(led_by_one & (least >= need)).select(*cols, F.lit(None).cast("int").alias("distance"), F.lit(True).alias("linked"), F.lit(None).cast("array<bigint>").alias("difference"))
        open_ = rows.where(led_by_one & (least < need) & (most >= need)).select(*cols)
        found = sure.unionByName(_verify(open_, own.select("node", "members"), self.t, self.parts, differences=True))
        other = materialize(rows.where(~led_by_one).select(*cols), "other-pairs")
        return found if other.isEmpty() else found.unionByName(_verify(other, self.sets(other), self.t, self.parts))

    def joined(self, roots: DataFrame, links: DataFrame) -> DataFrame:
        """(node, root) after more links (a, b): only the components that they touch are looked at."""
        for side in "ab":
            links = salted_join(links, side, roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")))
        links = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        new = materialize(components(links), "component-roots")
        old = salted_join(roots, "root", new.select(F.col("node").alias("root"), F.col("root").alias("now"))).select("node", F.coalesce("now", "root").alias("root"))
        return materialize(old.unionByName(new).distinct(), "roots")

    def roots(self, rounds: int) -> DataFrame:
        """(node, root) of the sets that links reach. After ``rounds`` with leaders come passes over the pairs that are
        left between components, until one has looked at all."""
        entries, led = self.entries(), self.spark.createDataFrame([], VERIFIED)
        roots, whole, nth = self.spark.createDataFrame([], "node bigint, root bigint"), False, 0
        while not whole:
            rows = self.open_entries(entries, roots)
            if rows.isEmpty():
                break
            if nth < rounds:
                pairs = self.close(self.with_leaders(rows, nth))
            else:
                pairs, whole = self.between(rows, NEAREST * GROWTH ** (nth - rounds))
            nth += 1
            if pairs.isEmpty():
                continue
            if nth <= rounds:
                found = materialize(_verify(pairs, self.sets(pairs), self.t, self.parts, keep=True), "led")
                led = led.unionByName(found)
            else:
                found = self.derived(pairs, led)
            roots = self.joined(roots, materialize(found.where("linked").select("a", "b"), "links"))
        return roots

    def components(self, rounds: int) -> DataFrame:
        """doc_id, n, node, mark, root, component_id of every row."""
        classes = self.classes.select("node", "least").join(self.roots(rounds), "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = materialize(salted_join(classes, "root", least).select("node", "root", "component_id"), "components")
        return salted_join(self.facts.select("doc_id", "n", "node", "mark"), "node", classes)


def join_sets(docs: DataFrame, k: int, num: int, den: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    A text's words are runs of characters other than white space (ASCII), A-Z lower-cased; its set has its
    distinct k-word shingles, or, with fewer words, all of them as one. Texts without words have an empty
    set, and their component is themselves. Two sets link when den * shared >= num * union. component_id is
    the smallest doc_id that links reach; texts with equal sets are linked. Null text counts as empty. A null
    doc_id is never the smallest; rows that repeat a doc_id are each answered from their own text. An empty
    table gives an empty result; other columns are not looked at.
    """
    full = _Join(docs, k, num, den).components(rounds)
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_pairs(docs: DataFrame, k: int, num: int, den: int = 100) -> DataFrame:
    """left_id, right_id, shared, n_left, n_right: all links between different sets, each told by its smallest doc_id.

    Every pair is listed, so a group of many near copies gives as many rows as it has pairs; join_sets does not need them.
    Texts with equal sets are one: join_sets tells which they are.
    """
    j = _Join(docs, k, num, den)
    pairs, _ = j.between(j.open_entries(j.entries(), j.spark.createDataFrame([], "node bigint, root bigint")))
    found = _verify(pairs, j.sets(pairs), j.t, j.parts).where("linked")
    ids = j.classes.select("node", "least")
    for side, name in (("a", "left"), ("b", "right")):
        found = salted_join(found, side, ids.select(F.col("node").alias(side), F.col("least").alias(f"{name}_id")))
    shared = ((F.col("na") + F.col("nb") - F.col("distance")) / 2).cast("long")
    return found.select("left_id", "right_id", shared.alias("shared"), F.col("na").cast("long").alias("n_left"), F.col("nb").cast("long").alias("n_right"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id, all columns as they were.

    A row is told by doc_id and text together: rows without a doc_id, or that repeat one, stay if no links join
    their texts. Texts without words all stay; a row that repeats both stays once.
    """
    mark = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    told, rows = docs.withColumn("_text", mark), _Join(docs, k, num, den, mark).components(ROUNDS)
    least = rows.where((F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    alone = F.when(F.col("n") == 0, F.col("mark")).alias("alone")
    kept = least.groupBy("root", F.col("doc_id").alias("_kept_id"), alone).agg(F.min("mark").alias("_kept_text")).select("_kept_id", "_kept_text").distinct()
    same = told["doc_id"].eqNullSafe(kept["_kept_id"]) & (told["_text"] == kept["_kept_text"])
    return told.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text"]).drop("_text")
