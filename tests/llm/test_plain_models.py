"""The toxicity classifier and the language fusion against plain versions, number by number."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugework.llm import language_id, toxicity


def grams(text):
    data = re.sub(rb"[\x09-\x0d]", b" ", (text or "").encode()).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return {data[i : i + n] for n in (4, 5) for i in range(len(data) - n + 1)}


def test_toxicity_equals_a_plain_classifier(spark):
    rng = random.Random(11)
    mild, bad = ["River", "stone", "walk", "lamp"], ["vilest", "scumbag"]
    rows, labels = [], []
    for i in range(260):
        toxic = int(rng.random() < 0.25)
        words = [rng.choice(mild) for _ in range(rng.randint(2, 30))]
        if toxic and rng.random() < 0.9:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
        labels.append((i, toxic))
    rows += [(900, None), (901, ""), (902, "abc"), (903, "walk lamp"), (903, "walk lamp")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))

    train = [(grams(t), y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5]
    size = 1 << toxicity.BITS
    p, q = Counter(), Counter()
    for g, y in train:
        (p if y else q).update(g)
    everything = sorted(p.keys() | q.keys())
    bucket = {g: int(toxicity._grams(np.frombuffer(g, np.uint8))[toxicity.ORDERS.index(len(g))][0]) for g in everything}
    assert len(set(bucket.values())) == len(everything)  # no two n-grams here share a bucket
    total_p, total_q = size + sum(p.values()), size + sum(q.values())
    ratio = {g: math.log((p[g] + 1) / total_p * total_q / (q[g] + 1)) if p[g] + q[g] >= 3 else 0.0 for g in everything}
    assert all((model.weights[bucket[g]] == 0) for g in everything if ratio[g] == 0)

    used = [g for g in everything if ratio[g]]
    place = {g: k for k, g in enumerate(used)}
    x = np.zeros((len(train), len(used)))
    for k, (g, _) in enumerate(train):
        for one in g:
            if one in place:
                x[k, place[one]] = ratio[one] * 8 / math.sqrt(len(g))
    y = np.array([t for _, t in train], float)
    share = y.mean()  # the sample is all there is
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + (v[:-1] ** 2).sum() / 2

    def slope(v):
        err = weight * (1 / (1 + np.exp(-(x @ v[:-1] + v[-1]))) - y)
        return np.append(x.T @ err + v[:-1], err.sum())

    found = np.array([float(model.weights[bucket[g]]) / 8 / ratio[g] for g in used] + [model.bias])
    start = np.append(np.zeros(len(used)), math.log(share / (1 - share)))
    assert np.linalg.norm(slope(found)) < 0.02 * np.linalg.norm(slope(start))
    assert all(loss(found) < loss(found + 0.05 * np.random.default_rng(k).normal(size=len(found))) for k in range(20))

    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    want = sorted((i, 1 / (1 + math.exp(-(sum(float(model.weights[bucket[g]]) for g in own if g in bucket) / math.sqrt(max(1, len(own))) + model.bias)))) for i, own in ((i, grams(t)) for i, t in rows))
    for r, (i, score) in zip(sorted(got, key=lambda r: r["doc_id"]), want):
        assert r["doc_id"] == i and r["score"] == pytest.approx(score, abs=1e-5) and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_of_ties_and_odd_rows(spark):
    even = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0)
    docs = spark.createDataFrame([(None, "a", 1, True), (1, None, 1, True), (1, None, 1, True)], "doc_id long, text string, score int, held_out boolean")
    got = toxicity.score_toxicity(docs, even).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.5, 1)] * 3
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [zlib.crc32(b"") % 5 == 0]


def plain_fusion(pages, docs):
    """Every step as in the docstring of language_id, over dictionaries."""
    buckets = lambda text: language_id._buckets(text.encode()).tolist()
    languages = sorted({lang for _, _, lang in docs if lang is not None})
    counts = {lang: Counter() for lang in languages}
    for _, text, lang in docs:
        if lang is not None and text is not None:
            counts[lang].update(buckets(text))
    size = 1 << language_id.BITS
    log = lambda lang, b: math.log((counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * size))
    rows = []
    for page, url, html in pages:
        found = re.search("://([^/?#]*)", url or "")
        host = found[1].lower() if found else ""
        said = re.search(r"<html lang=[\"']?([a-z]+)", html or "")
        declared = "none" if not said else said[1] if said[1] in languages else "other"
        bits = buckets(language_id.visible(html or ""))
        logs = {lang: language_id.TEMPER * sum(log(lang, b) for b in bits) for lang in languages}
        top = max(logs.values())
        z = sum(math.exp(v - top) for v in logs.values())
        rows.append({"page": page, "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "declared": declared, "logs": logs, "p": {k: round(math.exp(v - top) / z, 6) for k, v in logs.items()}})
    sums = {key: defaultdict(lambda: defaultdict(float)) for key in ("host", "domain", "suffix", "declared")}
    whole = {lang: 1 + sum(r["p"][lang] for r in rows) for lang in languages}
    for r in rows:
        for key, table in sums.items():
            for lang in languages:
                table[r[key]][lang] += r["p"][lang]
    out = []
    for r in rows:
        def shrunk(key, parent, r=r):
            rest = {lang: sums[key][r[key]][lang] - r["p"][lang] for lang in languages}
            n = max(0.0, sum(rest.values()))
            return {lang: (max(0.0, rest[lang]) + language_id.SHRINK * parent[lang]) / (n + language_id.SHRINK) for lang in languages}

        prior = shrunk("host", shrunk("domain", {lang: whole[lang] / sum(whole.values()) for lang in languages}))
        v = {}
        for lang in languages:
            declared = (sums["declared"][r["declared"]][lang] + 1) / (whole[lang] + len(languages) + 2)
            suffix = (max(0.0, sums["suffix"][r["suffix"]][lang] - r["p"][lang]) + 1) / (whole[lang] + 1)
            v[lang] = math.log(prior[lang]) + r["logs"][lang] + math.log(declared) + math.log(suffix)
        best = min(languages, key=lambda lang: (-v[lang], lang))
        sure = 1 / sum(math.exp(x - v[best]) for x in v.values())
        out.append((r["page"], best, sure, r["declared"], r["host"]))
    return out


def test_fusion_equals_a_plain_version(spark):
    rng = random.Random(6)
    words = {"aa": ["the", "and", "with", "house"], "bb": ["der", "und", "mit", "haus"], "cc": ["le", "et", "avec", "maison"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    docs = [(i, text(lang, 12), lang) for i, lang in enumerate(list(words) * 5)] + [(90, None, "aa"), (91, "zz", None)]
    pages = []
    for i in range(60):
        lang = rng.choice(list(words))
        tag = rng.choice(["", f' lang="{lang}"', " lang=xx", ' lang="bb"'])
        pages.append((i, f"http://{rng.choice('pqr')}.{lang if i % 3 else 'aa'}{i % 2}.{'org' if i % 4 else 'de'}/{i}", f"<html{tag}><p>{text(lang, rng.choice([1, 1, 3]))}</p></html>"))
    pages += [(900, None, None), (901, "http://p.aa0.org/x", ""), (902, "none", "<html lang='xx'>und"), (59, pages[59][1], pages[59][2])]
    got = language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    want = sorted(plain_fusion(pages, docs))
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: (r["page_id"], r["lang"])), want):
        assert (r["page_id"], r["lang"], r["declared"], r["host"]) == (w[0], w[1], w[3], w[4])
        assert r["confidence"] == pytest.approx(w[2], abs=1e-4)
