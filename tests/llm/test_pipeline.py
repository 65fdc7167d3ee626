"""The pipeline against its stages by brute force; the classifier's part is taken from the operator."""

import corpus_pipeline
from gaugework.llm import toxicity
from gaugework.llm.decontaminate import RATE

from .brute import distance_to_stretch, exact, near

SF = "/root/testdata/sf0.001"


def test_run_equals_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = toxicity.drop_toxic(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    kept = {i for i, _, _, stays, _ in exact(rows) if stays}
    rows = [r for r in rows if r[0] in kept]
    comp = near(rows, 5, 80)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        fold = lambda t: bytes(c + 32 if 65 <= c < 91 else 32 if 9 <= c < 14 else c for c in t.encode())
        raw = fold(text)
        for item in map(fold, items):
            if item in raw:
                return True
            if any(item[i : i + 16] in raw for i in range(0, len(item), 16)) and distance_to_stretch(item, raw) <= int(len(item) * RATE):
                return True
        return False

    want = {i for i, t in rows if not leaks(t)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert all(r["round_trip"] for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
