"""Benchmark decontamination: q-gram lemma in diagonal bands, then banded alignment.

A stretch of a document within e edits of a benchmark item of n bytes shares at least n - q + 1 - q * e of the
item's q-grams with it, and these lie on diagonals (place in the text minus place in the item) that differ
by at most e. Shared q-grams are counted in bands of diagonals; neighbouring bands overlap by e, so that one of
them holds all of a stretch's. Bands with enough are verified by an alignment within the band.

The edit budget is ``rate`` of the item's bytes. q is MOST_Q, or less for items so short that the bound would be
void. Comparison is on UTF-8 bytes with A-Z lower-cased and every white space (ASCII) a space. Items are
indexed in parts of at most PART bytes, so what is sent to the executors at once is bounded.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, blocks, materialize, salted_join, utf8

RATE, MOST_Q = 0.1, 8
BLOCK, PART = 1 << 19, 16 << 20
#: Bands times items that are counted in an array; more are counted by sorting. Alignments made at once.
CELLS, BATCH = 1 << 22, 256
#: Shared q-grams whose bands are counted at once.
ENTRIES = 1 << 21
BITS = 22

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[9:14] = 32


class Index:
    """q-grams of some items. items: (item_id, text)."""

    def __init__(self, items, rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [_fold[np.frombuffer(t.encode(), np.uint8)] for _, t in items]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(self.sizes * rate).astype(np.int64)
        q = np.minimum(MOST_Q, self.sizes // (self.edits + 1))
        self.need = self.sizes - q + 1 - q * self.edits
        #: Bands begin every ``step`` diagonals and hold step + e of them.
        self.step = int(max(16, self.edits.max(initial=0) + 1))
        self.grams = []
        for size in np.unique(q):
            hashes, owner, place = [], [], []
            for k in np.flatnonzero(q == size):
                start = np.arange(self.sizes[k] - size + 1)
                hashes.append(Rolling(self.texts[k])(start, start + size))
                owner.append(np.full(len(start), k, np.int32))
                place.append(start.astype(np.int32))
            hashes, owner, place = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
            order = np.argsort(hashes, kind="stable")
            known, first = np.unique(hashes[order], return_index=True)
            bits = np.zeros(1 << BITS, bool)
            bits[(known >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.grams.append((int(size), bits, known, np.append(first, len(order)), owner[order], place[order]))

    def bands(self, data: np.ndarray):
        """(item, band) of the bands of data that hold enough q-grams; band b begins at diagonal b * step."""
        hashes = Rolling(data)
        most = int(self.sizes.max(initial=0)) // self.step + 2  # diagonals may be negative
        width = len(data) // self.step + most + 3
        few = width * len(self.ids) <= CELLS
        counts = np.zeros(width * len(self.ids) if few else 0, np.int64)
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for q, bits, known, first, owner, place in self.grams:
            if len(data) < q:
                continue
            start = np.arange(len(data) - q + 1)
            h = hashes(start, start + q)
            at = np.flatnonzero(bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            where = np.searchsorted(known, h[at])
            where[where == len(known)] = 0
            ok = known[where] == h[at]
            at, where = at[ok], where[ok]
            count = first[where + 1] - first[where]
            ends, i = np.cumsum(count), 0
            while i < len(at):  # a q-gram that repeats in both gives very many entries: so many at once as ENTRIES
                j = i + max(1, int(np.searchsorted(ends[i:] - (ends[i - 1] if i else 0), ENTRIES, "right")))
                c = count[i:j]
                entry = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[where[i:j]], c)
                item, diagonal = owner[entry].astype(np.int64), np.repeat(at[i:j], c) - place[entry]
                band = diagonal // self.step
                # a band holds step + e diagonals: those of the next band's first e are in it as well
                again = (diagonal - band * self.step) < self.edits[item]
                key = np.concatenate([item * width + band + most, (item * width + band + most - 1)[again]])
                if few:
                    counts += np.bincount(key, minlength=len(counts))
                else:
                    key, n = np.unique(key, return_counts=True)
                    keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                    times = np.bincount(back, np.concatenate([times, n]), len(keys)).astype(np.int64)
                i = j
        if few:
            found, band = np.nonzero(counts.reshape(len(self.ids), width) >= np.maximum(1, self.need)[:, None])
        else:
            found, band = keys // width, keys % width
            ok = times >= np.maximum(1, self.need)[found]
            found, band = found[ok], band[ok]
        return found, band - most

    def align(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, band: np.ndarray):
        """Least edits of each item with a stretch of data[low:high] in its band: edits, start, end (edits over the budget: e + 1)."""
        best = np.full(len(item), 1 << 30)
        start, end = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        for size in np.unique(self.sizes[item]):
            rows = np.flatnonzero(self.sizes[item] == size)
            for i in range(0, len(rows), BATCH):
                r = rows[i : i + BATCH]
                best[r], start[r], end[r] = self._align(data, low[r], high[r], item[r], band[r], int(size))
        return best, start, end

    def _align(self, data, low, high, item, band, n):
        e = int(self.edits[item[0]])
        width = self.step + 3 * e + 1
        origin = band * self.step - e  # text place of row 0, column 0
        cols = np.arange(n + width)
        at = origin[:, None] + cols
        inside = (at >= low[:, None]) & (at < high[:, None])
        text = np.where(inside, data[np.clip(at, 0, len(data) - 1)].astype(np.int64), -1)
        pattern = np.stack([self.texts[k] for k in item]).astype(np.int64)
        far = 1 << 20  # a cost is edits * far + start column: of equal edits the earlier start wins
        lane = np.arange(width) * far
        cost = np.broadcast_to(np.arange(width), (len(item), width)).astype(np.int64)
        over = (e + 1) * far
        for i in range(n):
            change = cost + np.where(text[:, i : i + width] == pattern[:, i : i + 1], 0, far)
            change[:, :-1] = np.minimum(change[:, :-1], cost[:, 1:] + far)
            cost = np.minimum.accumulate(change - lane, axis=1) + lane
            if i % 32 == 31 and cost.min() >= over:
                break
        column = cost.argmin(1)
        least = cost[np.arange(len(item)), column]
        begin = np.maximum(origin + (least & (far - 1)), low)
        return least // far, begin, np.minimum(origin + n + column, high)


def _found(index: Index, texts: np.ndarray, at: np.ndarray):
    """Leaks (text number, item, start, end, edits) of texts laid end to end; a long text comes in overlapping pieces."""
    data = _fold[texts]
    reach = int(index.sizes.max(initial=0) + 2 * index.edits.max(initial=0)) + index.step
    for first, last in blocks(at, BLOCK):
        a, b = int(at[first]), int(at[last])
        for s in range(a, max(b, a + 1), BLOCK if b - a > 2 * BLOCK else max(1, b - a)):
            e = b if b - a <= 2 * BLOCK else min(b, s + BLOCK + reach)
            item, band = index.bands(data[s:e])
            if not len(item):
                continue
            # a band may lie over several short texts: each that it touches is tried
            begin = np.clip(s + band * index.step - index.edits[item], a, b - 1)
            stop = np.clip(s + (band + 1) * index.step + 2 * index.edits[item] + index.sizes[item], a + 1, b)
            head = np.searchsorted(at, begin, "right") - 1
            tail = np.searchsorted(at, stop - 1, "right") - 1
            times = tail - head + 1
            text = np.repeat(head, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item, band = np.repeat(item, times), np.repeat(band, times)
            ok = (at[text + 1] - at[text]) >= index.sizes[item] - index.edits[item]
            text, item, band = text[ok], item[ok], band[ok]
            if not len(text):
                continue
            edits, x, y = index.align(data[s:e], np.maximum(at[text] - s, 0), np.minimum(at[text + 1], e) - s, item, band)
            good = edits <= index.edits[item]
            yield from zip(*(v[good].tolist() for v in (text, item, x + s - at[text], y + s - at[text], edits)))


def _merged(leaks: list[tuple]) -> list[dict]:
    """Of leaks of one item that overlap, the one with the fewest edits, then the first."""
    out, by = [], defaultdict(list)
    for item, start, end, edits in leaks:
        by[item].append((edits, start, end))
    for item, found in by.items():
        kept: list[tuple] = []
        for edits, start, end in sorted(set(found)):
            if all(end <= s or start >= e for _, s, e in kept):
                kept.append((edits, start, end))
        out += [{"item_id": item, "start": s, "end": e, "edits": d} for d, s, e in kept]
    return sorted(out, key=lambda x: (x["start"], x["item_id"]))


_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def _parts(benchmark: DataFrame, rate: float):
    """Indexes over the items, each over at most about PART bytes of text."""
    items = benchmark.where("text IS NOT NULL AND length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = -(-total // PART)
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, many))))
    for p in range(many):
        yield Index(sorted(((r[0], r[1]) for r in dealt.where(F.col("part") == p).select("item_id", "text").collect()), key=lambda x: (x[0] is not None, x)), rate)


def _hits(docs: DataFrame, index: Index, columns: str) -> DataFrame:
    """Rows (columns, then leaks) of the texts in which an item of the index is found; docs: columns, text."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            found = defaultdict(list)
            for text, item, start, end, edits in _found(shared.value, data, at):
                found[text].append((shared.value.ids[item], start, end, edits))
            rows = sorted(found)
            hit = batch.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
            yield hit.append_column("leaks", pa.array([_merged(found[i]) for i in rows], _LEAK))

    return docs.mapInArrow(run, f"{columns}, leaks {KIND}")


KIND = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with a column leaks: the (item_id, start, end, edits) of every benchmark item found, in bytes of the text.

    Null and empty texts and items match nothing; without items leaks is empty. Rows that repeat are answered
    alike. docs must not have a column leaks. A benchmark of several parts is searched for part by part: each part's
    hits are written before the next is sent out, and told by a hash of the text, so they are few rows to join.
    """
    parts = _parts(benchmark, rate)
    first, second = next(parts, None), next(parts, None)
    none = F.array().cast(KIND)
    if first is None:
        return docs.withColumn("leaks", none)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            for batch in batches:
                data, at = utf8(batch.column("text"))
                found = defaultdict(list)
                for text, item, start, end, edits in _found(shared.value, data, at):
                    found[text].append((shared.value.ids[item], start, end, edits))
                yield batch.append_column("leaks", pa.array([_merged(found[i]) if i in found else [] for i in range(batch.num_rows)], _LEAK))

        return docs.mapInArrow(run, docs.withColumn("leaks", none).schema)
    mark = F.sha2("text", 256)
    texts, hits = docs.select(mark.alias("_mark"), "text"), None
    for index in chain((first, second), parts):
        part = materialize(_hits(texts, index, "_mark string").dropDuplicates(["_mark"]), "leaks")
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.groupBy("_mark").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    joined = salted_join(docs.withColumn("_mark", mark), "_mark", hits).drop("_mark")
    return joined.withColumn("leaks", F.coalesce("leaks", none))


def report(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, contaminated, n_leaks, items, leaks: one row per row of docs."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, rate)
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_leaks"),
        F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"]))).alias("items"), "leaks",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no benchmark item is found, all columns as they were."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return find_leaks(inner, benchmark, rate).where(F.size("leaks") == 0).select("row.*")
