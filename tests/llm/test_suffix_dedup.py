import random

import numpy as np
import pytest

from gaugework.llm import suffix_dedup as S
from gaugework.llm.suffix_array import common_prefixes, lookup, packed, suffix_array, words

from .brute import repeats

SCHEMA = "doc_id long, text string, mark string, spans int"


def rows():
    rng = random.Random(3)
    vocabulary = ["the", "on", "re", "éa", "tion", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, out = [text(40) for _ in range(4)], []
    for i in range(120):
        parts = [text(rng.randint(0, 60))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(common))
        if rng.random() < 0.2 and out:
            parts.append(rng.choice(out)[1] or "")
        out.append((i, " ".join(parts)))
    return out + [(400, None), (401, ""), (402, "a" * 500), (403, "ab" * 400)]


@pytest.mark.parametrize(("width", "options"), [(100, {}), (20, {"shard": 600}), (20, {"hot": 3, "shard": 300})])
def test_removal_equals_brute_force(spark, width, options):
    data = rows()
    df = spark.createDataFrame([(*r, "m", 1) for r in data], SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df, width, **options).collect()}
    assert got == repeats(data, width)


def test_null_ids_repeated_rows_and_empty_table(spark):
    t = "x" + "abcdefgh" * 20
    df = spark.createDataFrame([(None, t, "m", 1), (7, t, "m", 1), (7, t, "m", 1), (8, "own text " * 3, None, None)], SCHEMA)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in S.remove_repeats(df, 100).collect())
    inner = repeats([(0, t)], 100)[0][1]
    assert got == [("7", len(t)), ("7", len(t)), ("8", 0), ("None", inner)]
    assert S.remove_repeats(df.limit(0), 100).collect() == []


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = [bytes(rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8)) for _ in range(12)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        own = np.repeat(np.arange(len(texts)), np.diff(at))
        left = at[1:][own] - np.arange(len(data))
        key = packed(data, left)
        order = suffix_array(key, left, 60)
        suffixes = [data[i : i + left[i]].tobytes() for i in order]
        assert suffixes == sorted(suffixes)
        lcp = common_prefixes(order, key, left, data)
        for j in range(1, len(order)):
            a, b = suffixes[j - 1], suffixes[j]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert lcp[j] == n


def test_binary_search_of_rows():
    data = np.frombuffer(bytes(range(200)) + b"\0" * 20, np.uint8)
    table = words(data, np.arange(0, 100), 10)
    assert (lookup(table, words(data, np.array([5, 99, 150]), 10)) == [5, 99, -1]).all()


def test_long_texts_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    at = np.array([0, 3000, 3050, 5000])
    monkeypatch.setattr(S, "BLOCK", 500)
    seen = []
    for first, begin, end, inner in S._pieces(at, 100):
        text, start, strings, _, _ = S.stretches(data[begin:end], inner, 100)
        for t, s, n in zip(text, start, strings):
            seen += [(first + t, begin + s - at[first + t] + i) for i in range(n)]
    want = [(t, i) for t in range(3) for i in range(int(at[t + 1] - at[t]) - 99)]
    assert sorted((int(a), int(b)) for a, b in seen) == want


def test_runs_of_one_byte_are_few_rows(spark):
    """Neighbouring repeats are one row, not one a position."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc": pa.array([1, 2]), "mark": pa.array([0, 0]), "text": pa.array(["a" * 300_000, "ab" * 100_000])})
    found = list(S._find(100)([batch]))
    strings = np.concatenate([b.column("strings").to_numpy() for b in found])
    assert np.abs(strings).sum() == 300_000 - 99 + 200_000 - 99 and len(strings) < 1000
    df = spark.createDataFrame([(1, "a" * 300_000, "m", 1)], SCHEMA)
    assert S.remove_repeats(df).first()["n_removed"] == 299_999
