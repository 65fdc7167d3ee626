import random

from gaugework.llm.exact_dedup import drop_exact_copies, exact_groups

from .brute import exact

SCHEMA = "doc_id long, text string, recipe string, keep_id int"


def rows():
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma is", "delta of\n", "été", "x"]
    out = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 200, 900])))
        out.append((i, text))
        if rng.random() < 0.3:
            out.append((1000 + i, text.upper() if text.isascii() else text))
    out += [(5000, None), (5001, ""), (5002, "É"), (5003, "é"), (5004, "a" * 30000), (5005, "A" * 30000), (5006, "a" * 30001), (None, "alone"), (5007, "tie"), (5007, "tie")]
    return out


def answer(df):
    return sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def expected(data):
    return sorted((str(i), k, n, kept, h) for i, k, n, kept, h in exact(data))


def test_groups_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)
    assert answer(exact_groups(df)) == expected(data)


def test_colliding_chunk_hashes_are_told_apart(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)
    assert answer(exact_groups(df, least=8, most=64, hash_bits=6)) == expected(data)


def test_hot_group_and_empty_table(spark):
    data = [(i, "Same") for i in range(300)] + [(i, f"own {i}") for i in range(300, 400)]
    df = spark.createDataFrame([(*r, None, None) for r in data], SCHEMA)
    assert answer(exact_groups(df)) == expected(data)
    assert exact_groups(df.limit(0)).collect() == []
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [299, *range(300, 400)]


def test_texts_without_an_id_of_their_own_stay(spark):
    data = [(None, "one"), (None, "ONE"), (None, "two"), (None, "three"), (3, "Three"), (7, "four"), (7, "five"), (7, "six"), (9, "SIX"), (7, "five"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    left = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in got.collect()), key=str)
    assert left == sorted([(None, "one"), (None, "two"), (3, "three"), (7, "four"), (7, "five"), (9, "six"), (None, "")], key=str)
