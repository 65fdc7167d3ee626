"""Removal of repeated byte stretches by suffix arrays, whatever shard their copies are in.

A byte goes if a string of ``width`` bytes that covers it also starts earlier in the corpus. Strings are
routed so that equal ones meet: each is assigned the least of its k-gram hashes (its anchor), neighbouring
strings with one anchor form a stretch, and stretches are dealt out by anchor.

1. Equal stretches collapse: the first stays, the others are repeats as a whole, within each task before
   anything is shuffled, where repeats that follow each other become one run. Stretches of at most 1.5 ``width`` bytes
   count as equal when the 64-bit hashes of their anchors and of their bytes are. An anchor with one stretch left holds
   no repeat.
2. Where an anchor has several different stretches, their bytes are fetched, and each shard of them gets
   a suffix array (Larsson-Sadakane refinement) with common prefixes (Kasai): strings that share ``width``
   bytes are neighbours there. An anchor with more bytes than a shard spreads over several, which are merged
   by binary search of a later shard's strings in the earlier ones.
3. An anchor with more than HOT different stretches, such as one in a line that a third of all texts hold,
   is dealt out again by the strings' own hashes, so that no task gets all of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Bloom, Rolling, blocks, materialize, utf8
from .suffix_array import common_prefixes, lookup, packed, suffix_array, words

WIDTH = 100
#: Bytes of text handled at once, bytes of a suffix-array shard, stretches of an anchor before it is dealt out anew.
BLOCK, SHARD, HOT = 1 << 20, 1 << 18, 4096
#: Rows kept in a task before equal stretches are collapsed.
FLUSH = 1 << 20
NULL_ID = -(2**63)


def stretches(data: np.ndarray, at: np.ndarray, width: int):
    """Stretches of texts laid end to end: text number, start in data, strings, anchor hash, content hash."""
    k = width // 2
    w, n = width - k + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = Rolling(data)
    start = np.arange(n - k + 1)
    value, index, span = h(start, start + k), start.astype(np.int32), 1

    def least(v, i, shift):
        m = len(v) - shift
        left = v[:m] <= v[shift:]
        return np.where(left, v[:m], v[shift:]), np.where(left, i[:m], i[shift:])

    hashes = value
    while span * 2 <= w:
        value, index = least(value, index, span)
        span *= 2
    if span < w:
        value, index = least(value, index, w - span)
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)[: len(index)]
    valid = np.flatnonzero(np.arange(len(index)) + width <= at[1:][text])
    if not len(valid):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = index[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    head = np.flatnonzero(new)
    first, count = valid[head], np.diff(np.append(head, len(valid)))
    return text[first], first, count, hashes[anchor[head]], h(first, first + count - 1 + width)


def _pieces(at: np.ndarray, width: int):
    """Runs of texts of about BLOCK bytes; a longer text comes in overlapping pieces. (first text, byte range, offsets within)"""
    for first, last in blocks(at, BLOCK):
        begin, end = int(at[first]), int(at[last])
        if end - begin <= 2 * BLOCK:
            yield first, begin, end, at[first : last + 1] - begin
        else:
            for s in range(begin, end, BLOCK):
                e = min(end, s + BLOCK + width - 1)
                yield first, s, e, np.array([0, e - s])


def _repeats(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray):
    """Order of the rows by keys, doc, start; which of them begin a key; which start later than their key's first."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, s = doc[order], start[order]
    return order, new, (d != d[first]) | (s != s[first])


#: strings below 0: that many repeat, whatever the anchor
STRETCH = "anchor bigint, content bigint, doc bigint, mark bigint, start bigint, strings int"


def _runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, strings: np.ndarray):
    """Stretches that follow each other without a gap, as one."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start, strings = doc[order], mark[order], start[order], strings[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + strings[:-1])
    head = np.flatnonzero(new)
    return doc[head], mark[head], start[head], np.add.reduceat(strings, head) if len(head) else strings


def _find(width: int):
    """Texts to stretches; equal ones of a task are collapsed to the first, and the others, as runs, marked as repeats."""

    def flush(parts):
        anchor, content, doc, mark, start, strings = (np.concatenate(x) for x in zip(*parts))
        order, _, repeat = _repeats([anchor, content], doc, start)
        rest, gone = order[~repeat], order[repeat]
        runs = _runs(doc[gone], mark[gone], start[gone], strings[gone])
        none = np.zeros(len(runs[0]), np.int64)
        for cols in ([x[rest] for x in (anchor, content, doc, mark, start, strings)], [none, none, *runs[:3], -runs[3]]):
            cols[5] = cols[5].astype(np.int32)
            for i in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], ["anchor", "content", "doc", "mark", "start", "strings"])

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            data, at = utf8(batch.column("text"))
            doc, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            for first, begin, end, inner in _pieces(at, width):
                text, start, strings, anchor, content = stretches(data[begin:end], inner, width)
                own = text + first
                parts.append((anchor.view(np.int64), content.view(np.int64), doc[own], mark[own], start + begin - at[own], strings))
                rows += len(own)
            if rows >= FLUSH:
                yield from flush(parts)
                parts, rows = [], 0
        if rows:
            yield from flush(parts)

    return run


def _sort_out(hot: int):
    """Stretches sorted by anchor, content, doc, start, to those that matter: kind 1 repeats as a whole,
    kind 2 has to be compared with others of its anchor, kind 3 too and its anchor is hot."""
    names = ["anchor", "doc", "mark", "start", "strings", "kind"]

    def out(cols, kind):
        anchor, doc, mark, start, strings = cols
        return pa.RecordBatch.from_arrays([*map(pa.array, (anchor, doc, mark, start, strings)), pa.array(kind.astype(np.int32))], names)

    def run(batches):
        held: list[np.ndarray] | None = None  # rows of the last anchor seen, which may go on
        hot_anchor, prior = None, None  # the anchor known to be hot; (content, doc, start) of the first of its last content
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "content", "doc", "mark", "start", "strings")]
            gone = cols[5] < 0
            if gone.any():
                yield out([*(cols[i][gone] for i in (0, 2, 3, 4)), -cols[5][gone]], np.ones(gone.sum()))
                cols = [c[~gone] for c in cols]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            held = None
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if len(cols[0]) - cut > 4 * hot:  # its rows would pile up: it is decided now
                cut = len(cols[0])
            held, cols = [c[cut:] for c in cols], [c[:cut] for c in cols]
            if cut:
                found, hot_anchor, prior = decide(cols, hot_anchor, prior, len(held[0]) == 0)
                yield found
        if held is not None and len(held[0]):
            yield decide(held, hot_anchor, prior, False)[0]

    def decide(cols, hot_anchor, prior, open_end):
        anchor, content, doc, mark, start, strings = cols
        n = len(anchor)
        new_a, new = np.ones(n, bool), np.ones(n, bool)
        new_a[1:] = anchor[1:] != anchor[:-1]
        new[1:] = new_a[1:] | (content[1:] != content[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        d, s = doc[first].copy(), start[first].copy()
        if prior is not None and hot_anchor == anchor[0] and prior[0] == content[0]:  # the content goes on from the rows before
            same = first == 0
            d[same], s[same] = prior[1], prior[2]
        repeat = (doc != d) | (start != s)
        group = np.cumsum(new_a) - 1
        contents = np.bincount(group, new)
        is_hot = contents > hot
        if hot_anchor is not None and anchor[0] == hot_anchor:
            is_hot[0] = True
        if open_end:
            is_hot[-1] = True
        kind = np.where(repeat, 1, np.where(is_hot[group], 3, np.where(contents[group] > 1, 2, 0)))
        keep = kind > 0
        tail = (anchor[-1], (content[-1], d[-1], s[-1])) if open_end else (None, None)
        anchor = np.where(kind == 1, 0, anchor)
        return out([c[keep] for c in (anchor, doc, mark, start, strings)], kind[keep]), *tail

    return run


BYTES = "deal bigint, key bigint, content bigint, doc bigint, mark bigint, start bigint, stretch binary"


def _fetch(width: int):
    """Texts with their lists of stretches, to bytes by anchor, and for hot anchors to hashes by string."""
    names = ["deal", "key", "content", "doc", "mark", "start", "stretch"]

    def run(batches):
        for batch in batches:
            cold, hot = [], []
            marks = batch.column("mark").to_pylist()
            for text, doc, mark, asked in zip(batch.column("text"), batch.column("doc").to_pylist(), marks, batch.column("asked").to_pylist()):
                raw = (text.as_py() or "").encode()
                for x in asked:
                    s, stop = x["start"], x["start"] + x["strings"] - 1 + width
                    if x["kind"] == 2:
                        cold.append((x["anchor"], x["anchor"], 0, doc, mark, s, raw[s:stop]))
                    else:
                        h = Rolling(np.frombuffer(raw[s:stop], np.uint8))
                        i = np.arange(x["strings"])
                        one, two = h(i, i + width).view(np.int64), h(i + width // 3, i + width).view(np.int64)
                        hot.append((one, two, np.full(len(i), doc), np.full(len(i), mark), s + i))
            if cold:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*cold))[:-1]] + [pa.array([c[-1] for c in cold], pa.binary())], names)
            if hot:
                one, two, doc, mark, start = (np.concatenate(c) for c in zip(*hot))
                order, _, repeat = _repeats([one, two], doc, start)
                one, two, doc, mark, start = (c[order] for c in (one, two, doc, mark, start))
                deal = np.where(repeat, doc * 0x9E3779B1 + start, one)
                flag = pa.array(np.where(repeat, b"r", b"").tolist(), pa.binary())  # r: repeats a string of this task
                yield pa.RecordBatch.from_arrays([*map(pa.array, (deal, one, two, doc, mark, start)), flag], names)

    return run


def _compare(width: int, shard: int):
    """Bytes sorted by key, content, doc, start, to the strings that repeat: (doc, mark, start, strings)."""
    names = ["doc", "mark", "start", "strings"]

    def out(doc, mark, start):
        strings = pa.array(np.ones(len(doc), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(mark), pa.array(start), strings], names)

    def shards(rows, earlier):
        """One suffix array over rows; earlier: sorted strings of the first row's key in shards before."""
        sizes = np.array([len(r[4]) for r in rows])
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)])
        own = np.repeat(np.arange(len(rows)), sizes)
        pos = np.arange(len(data))
        left = at[1:][own] - pos
        key = packed(data, left)
        order = suffix_array(key, left, width)
        lcp = common_prefixes(order, key, left, data)
        place = np.flatnonzero(left[order] >= width)
        strings = order[place]
        new = lcp[place] < width
        if len(new):
            new[0] = True
        doc = np.array([r[1] for r in rows])[own[strings]]
        mark = np.array([r[2] for r in rows])[own[strings]]
        start = np.array([r[3] for r in rows])[own[strings]] + strings - at[own[strings]]
        group = np.cumsum(new) - 1
        by = np.lexsort((start, doc, group))
        heads = np.searchsorted(group[by], np.arange(group[-1] + 1 if len(group) else 0))
        d, s = doc[by][heads][group], start[by][heads][group]
        repeat = (doc != d) | (start != s)
        last_key, tables = rows[-1][0], []
        if earlier:
            mine = np.array([r[0] == rows[0][0] for r in rows])[own[strings]]
            for table, first_doc, first_start in earlier:
                hit = lookup(table, words(data, strings[mine], width))
                ok = hit >= 0
                before = (first_doc[hit] < doc[mine]) | ((first_doc[hit] == doc[mine]) & (first_start[hit] < start[mine]))
                repeat[np.flatnonzero(mine)[ok & before]] = True
            if last_key == rows[0][0]:
                tables = earlier
        ours = np.array([r[0] == last_key for r in rows])[own[strings]] & new
        tables = [*tables, (words(data, strings[ours], width), d[ours], s[ours])]
        return out(doc[repeat], mark[repeat], start[repeat]), last_key, tables

    def run(batches):
        rows, size, carried = [], 0, (None, [])
        prior = None  # (one, two, doc, start) of the first of the last hashed string

        def close(rows):
            nonlocal carried
            found, key, tables = shards(rows, carried[1] if carried[0] == rows[0][0] else [])
            carried = (key, tables)
            return found

        for batch in batches:
            key, content, doc, mark, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "content", "doc", "mark", "start"))
            raw = batch.column("stretch").to_pylist()
            long_ = np.array([len(x) > 1 for x in raw], bool)
            hashed = np.flatnonzero(~long_)
            if len(hashed):
                k, c, d, m, s = (x[hashed] for x in (key, content, doc, mark, start))
                gone = np.array([raw[i] == b"r" for i in hashed], bool)
                rest = ~gone
                k2, c2, d2, s2 = k[rest], c[rest], d[rest], s[rest]
                if len(k2):
                    new = np.ones(len(k2), bool)
                    new[1:] = (k2[1:] != k2[:-1]) | (c2[1:] != c2[:-1])
                    first = np.maximum.accumulate(np.where(new, np.arange(len(k2)), 0))
                    fd, fs = d2[first].copy(), s2[first].copy()
                    if prior is not None and prior[:2] == (k2[0], c2[0]):
                        fd[first == 0], fs[first == 0] = prior[2:]
                    prior = (k2[-1], c2[-1], fd[-1], fs[-1])
                    again = np.flatnonzero(rest)[(d2 != fd) | (s2 != fs)]
                    gone[again] = True
                yield out(d[gone], m[gone], s[gone])
            for i in np.flatnonzero(long_):
                if size >= shard:
                    yield close(rows)
                    rows, size = [], 0
                rows.append((key[i], doc[i], mark[i], start[i], raw[i]))
                size += len(raw[i])
        if rows:
            yield close(rows)

    return run


def repeated(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Texts (doc, mark, text) and the repeats in them (doc, mark, start, strings): strings in a row that start earlier elsewhere.

    mark tells rows apart that repeat a doc_id (_mark).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(_doc().alias("doc"), _mark(docs).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(_find(width), STRETCH)
    place = F.when(F.col("strings") < 0, F.xxhash64("doc", "start")).otherwise(F.col("anchor"))
    dealt = found.repartition(parts, place).sortWithinPartitions("anchor", "content", "doc", "start")
    kinds = materialize(dealt.mapInArrow(_sort_out(hot), "anchor bigint, doc bigint, mark bigint, start bigint, strings int, kind int"), "stretches")
    asked = kinds.where("kind > 1").groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "start", "strings", "kind")).alias("asked"))
    some = Bloom.of(kinds.where("kind > 1").select(_text_key().alias("k")).distinct()).filter(texts.withColumn("k", _text_key()), "k").drop("k")
    fetched = some.join(asked.hint("shuffle_hash"), ["doc", "mark"]).mapInArrow(_fetch(width), BYTES)
    dealt = fetched.repartition(parts, "deal").sortWithinPartitions("key", "content", "doc", "start")
    compared = dealt.mapInArrow(_compare(width, shard), "doc bigint, mark bigint, start bigint, strings int")
    whole = kinds.where("kind = 1").select("doc", "mark", "start", "strings")
    return texts, materialize(whole.unionByName(compared), "repeats")


def _doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def _mark(docs: DataFrame):
    """A hash of the text, or nothing where no doc_id repeats: it goes with every stretch."""
    again = docs.groupBy(_doc().alias("doc")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return F.lit(0).cast("bigint") if again.isEmpty() else F.xxhash64("text")


def _text_key():
    return F.xxhash64("doc", "mark")


def spans_of(starts: np.ndarray, strings: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) of one text from its repeated strings."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], (starts + strings - 1 + width)[order]
    reach = np.maximum.accumulate(e)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return list(zip(s[head].tolist(), np.maximum.reduceat(e, head).tolist()))


def remove_repeats(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: one row per row of docs.

    Texts are UTF-8 bytes; null counts as empty. A string starts earlier in a smaller doc_id, or in the same
    document at an earlier byte; a null doc_id is smaller than any other. Rows that repeat a doc_id stand at
    the same place: neither removes bytes of the other, but strings within one count for the other when they
    start at an earlier byte. An empty table gives an empty result; other columns are not looked at.
    spans: (start, end) of the maximal removed runs.
    """
    texts, repeats = repeated(docs, width, shard, hot)
    lists = repeats.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "strings")).alias("found"))
    hit = Bloom.of(repeats.select(_text_key().alias("k")).distinct())
    changed = hit.filter(texts.withColumn("k", _text_key()), "k").drop("k")

    def cut(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
                raw = text.as_py().encode()
                spans = spans_of(np.array([x["start"] for x in found]), np.array([x["strings"] for x in found]), width)
                digest, at = hashlib.sha256(), 0
                for s, e in spans:
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                rows.append((sum(e - s for s, e in spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind)],
                ["doc", "mark", "n_removed", "kept", "spans"],
            )

    schema = "doc bigint, mark bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>"
    cuts = changed.dropDuplicates(["doc", "mark"]).join(lists.hint("shuffle_hash"), ["doc", "mark"]).mapInArrow(cut, schema)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _mark(docs).alias("mark"))
    rows = rows.select("doc_id", _doc().alias("doc"), "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.join(cuts, ["doc", "mark"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"), F.coalesce("spans", none).alias("spans"),
    )
