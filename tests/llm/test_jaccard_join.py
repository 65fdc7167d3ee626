import random

import numpy as np
import pytest

from gaugework.llm import jaccard_join as J

from .brute import near, shingles

SCHEMA = "doc_id long, text string, node string, n int"


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([4, 12, 60, 150]))] for _ in range(8)]
    out = []
    for i in range(220):
        b = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            if b:
                b[rng.randrange(len(b))] = rng.choice(words)
        out.append((i * 3 + 7, " ".join(b)))
    return out + [(2, None), (1, ""), (3, "  \n"), (9001, "one two"), (9000, "One  two"), (9003, "one"), (9004, "É one"), (9005, "é one"), (9006, "a " * 20000)]


@pytest.mark.parametrize(("k", "num", "rounds", "chunk"), [(3, 90, 2, 4096), (5, 80, 2, 3), (3, 80, 0, 5), (3, 40, 1, 4096)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, rounds, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    data = rows()
    df = spark.createDataFrame([(*r, "x", 0) for r in data], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join_sets(df, k, num, rounds=rounds).collect()}
    assert got == near(data, k, num)


def ring(rng, n=40):
    """Sets in a ring around one that is not there: neighbours are similar, and most are not similar to any leader."""
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(n):
        words = list(base)
        for j in range(5 * i, 5 * i + 10):
            words[j % 200] = f"x{j % 200}"
        out.append((i + 1, " ".join(words)))
    return out


def test_answers_derived_from_leaders(spark, monkeypatch):
    """Components that only pairs between sets of one leader connect; the bounds and the differences give them."""
    data = ring(random.Random(1))
    df = spark.createDataFrame([(*r, "x", 0) for r in data], SCHEMA)
    monkeypatch.setattr(J, "LEADERS", 1)
    asked = []
    verify = J._verify
    monkeypatch.setattr(J, "_verify", lambda pairs, *a, **b: asked.append((b.get("differences", False), pairs.count())) or verify(pairs, *a, **b))
    for num in (75, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join_sets(df, 3, num, rounds=1).collect()}
        assert got == near(data, 3, num)
    assert any(derived and n for derived, n in asked)


def near_group(rng, n=250):
    """Copies of one text with 1 to 16 words in a row that differ: the more words, the fewer others are similar."""
    base = [f"b{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = list(base)
        at = rng.randrange(380)
        for j in range(at, at + rng.randrange(1, 17)):
            words[j] = f"x{rng.randrange(10**6)}"
        out.append((i + 1, " ".join(words)))
    return out


@pytest.mark.parametrize("seed", [3, 5])
def test_a_group_of_near_copies_is_asked_for_few_of_its_pairs(spark, monkeypatch, seed):
    """However the classes' hashes fall, and so the leaders."""
    data = near_group(random.Random(1))
    df = spark.createDataFrame([(*r, "x", 0) for r in data], SCHEMA)
    scan, index, sets = J._scan, J._index, J._sets
    monkeypatch.setattr(J, "_scan", lambda k, s: scan(k, s + seed))
    monkeypatch.setattr(J, "_index", lambda k, t, o, s: index(k, t, o, s + seed))
    monkeypatch.setattr(J, "_sets", lambda k, s, a: sets(k, s + seed, a))
    monkeypatch.setattr(J, "FEW", 64, raising=False)
    asked, write = [], J.materialize

    def counted(frame, tag):
        out = write(frame, tag)
        if tag in ("leader-pairs", "between-pairs"):
            asked.append(out.count())
        return out

    monkeypatch.setattr(J, "materialize", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join_sets(df, 3, 90).collect()}
    want = near(data, 3, 90)
    links = [shingles(t, 3) for _, t in data]
    pairs = sum(100 * len(a & b) >= 90 * len(a | b) for i, a in enumerate(links) for b in links[:i])
    assert got == want
    assert sum(asked) < pairs / 4, (asked, pairs)


def test_single_sets_get_several_leaders(spark):
    """While no component has half of a list, its leaders are not one set, and those of the next round are others."""
    j = object.__new__(J._Join)
    j.t = J.Threshold(90, 100)
    rows = spark.createDataFrame([(1, i, 100, 0, i, 39, 1, 40) for i in range(40)], "shingle long, node long, n int, pos int, root long, most long, held long, size long")
    first, second = ({r["b"] for r in j.with_leaders(rows, nth).collect()} for nth in (0, 1))
    assert len(first) > 1 and len(second) > 1 and first != second


def test_nearest_pairs_of_each_probe():
    rng = np.random.default_rng(4)
    cols = [rng.integers(0, 50, 400), np.full(400, 9), rng.integers(0, 20, 400), np.full(400, 9), rng.integers(0, 5, 400)]
    got = J.nearest(cols, 3)
    for probe in range(20):
        own = np.sort(cols[4][cols[2] == probe])
        assert np.sort(got[4][got[2] == probe]).tolist() == own[:3].tolist()


def test_all_pairs_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 0) for r in data], SCHEMA)
    sets = {}
    for i, t in sorted(data, key=lambda r: r[0]):
        if s := shingles(t, 3):
            sets.setdefault(s, i)
    each = list(sets.items())
    want = {(min(i, j), max(i, j), len(a & b)) for x, (a, i) in enumerate(each) for b, j in each[:x] if 100 * len(a & b) >= 70 * len(a | b)}
    got = [(min(r["left_id"], r["right_id"]), max(r["left_id"], r["right_id"]), r["shared"]) for r in J.similar_pairs(df, 3, 70).collect()]
    assert len(got) == len(want) and set(got) == want


def test_long_words_are_told_apart():
    """The Thue-Morse word and its complement have one value under every polynomial modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} x y{other} x y".encode(), np.uint8)
    one, two = J.shingle_sets(data, np.array([0, len(word) + 4, len(data)]), 3)
    assert one.tolist() != two.tolist()


def test_counts_of_shingles_stop_at_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(J, "MANY", 5)
    rng = np.random.default_rng(2)
    shingle = np.sort(rng.choice([1, 2, 2, 2, 3, 4, 4, 5, 6], 90))
    node = np.concatenate([np.sort(rng.integers(0, 12, (shingle == s).sum())) for s in np.unique(shingle)])
    shingle, node = np.append(shingle, 9), np.append(node, 1)
    want = {(s, x): min(5, len(set(node[shingle == s]))) for s, x in zip(shingle.tolist(), node.tolist()) if len(set(node[shingle == s])) > 1}
    for size in (1, 4, 17, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(shingle[i : i + size]), pa.array(node[i : i + size]), pa.array(np.full(len(node[i : i + size]), 3, np.int32))], ["shingle", "node", "place"]) for i in range(0, len(shingle), size)]
        got = [r for b in J._shared(batches) for r in zip(*(b.column(c).to_pylist() for c in (0, 1, 3)))]
        assert len(got) == len(want) and {r[:2]: r[2] for r in got} == want


def test_empty_table_repeats_and_dropping(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x", 0), (5, "a b c d e f", "x", 0), (4, "a b c d e f", "y", 1), (9, "q r s t u v", None, None), (None, "a b c d e f", "z", 2)], SCHEMA)
    assert J.join_sets(df.limit(0), 3, 90).collect() == []
    got = J.drop_near_copies(df, 3, 90)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [4, 9]


def test_texts_without_an_id_of_their_own_stay(spark):
    a, b, c, d = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    data = [(None, a), (None, a.upper()), (None, b), (None, c), (4, c + " "), (7, d), (7, d + " "), (7, b + " z y"), (7, "x y z q q q q"), (2, "x y z q q q  q"), (None, ""), (None, " "), (8, None), (8, "")]
    df = spark.createDataFrame([(*r, "x", 0) for r in data], SCHEMA)
    got = [(r["doc_id"], " ".join((r["text"] or "").lower().split())) for r in J.drop_near_copies(df, 3, 90).collect()]
    want = [(None, a), (None, b), (4, c), (7, d), (7, b + " z y"), (2, "x y z q q q q"), (None, ""), (None, ""), (8, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    t = J.Threshold(80, 100)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**60, 150).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, 150)], rng.integers(0, 2**60, rng.integers(1, 60)).astype(np.uint64)]))
        x, y = J.Sketches([J.sketch_of(a).tobytes()]), J.Sketches([J.sketch_of(b).tobytes()])
        size = min(x.size[0], y.size[0])
        differ = int(np.bitwise_count(J.folded(x.raw[0], size) ^ J.folded(y.raw[0], size)).sum())
        assert differ <= len(np.setxor1d(a, b))
        zero = np.zeros(1, np.int64)
        similar = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert not similar or x.close(t, zero, zero, y, np.array([len(a)]), np.array([len(b)]))[0]
