"""Language identification of web pages by Bayesian fusion of four kinds of evidence.

P(language | page) is proportional to P(language | host) P(text | language) P(declared | language) P(suffix | language).
Text: character trigrams, naive Bayes, learned from at most MOST_TEXTS documents of each language. Declared:
the lang attribute of the markup. Suffix: the last label of the host. Host prior: counts of the host shrunk
towards those of its domain, and these towards all pages'; counts are sums of text posteriors over all
pages, by grouped aggregation, and a page's own text is taken out of the counts it is judged with.

Every language with a labelled document counts. Likelihoods are kept in parts of PART languages, of which a
process holds one at a time; sums and priors are rows of (page, language).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Bloom, Rolling, materialize, salted_lookup, utf8

#: Bound of the training sample of a language, and languages whose likelihoods are held at once.
MOST_TEXTS, PART = 300, 50
BITS, ORDER = 16, 3
#: Weight of a parent's distribution, in pages; the share of a text's log likelihood that counts, for n-grams overlap.
SHRINK, TEMPER = 5.0, 0.3


@dataclass
class Model:
    languages: list[str]
    parts: list  # broadcasts of bucket x language, PART languages each


def _fold(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
    return table[data]


def _buckets(text: bytes) -> np.ndarray:
    data = _fold(np.frombuffer(text, np.uint8))
    start = np.arange(max(0, len(data) - ORDER + 1))
    return (Rolling(data)(start, start + ORDER) >> np.uint64(64 - BITS)).astype(np.int64)


def train(docs: DataFrame) -> Model:
    """Trigram likelihoods from documents (text, lang); none without languages."""
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return Model([], [])
    # the first texts of a language by hash: of each of 64 shares first, so that a frequent language is no single task's work
    ids = known.where("doc_id IS NOT NULL").select("lang", "doc_id").distinct().withColumn("h", F.xxhash64("doc_id"))
    for keys in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("nth") <= MOST_TEXTS)
    ids = materialize(ids.select("lang", "doc_id", "h"), "language-sample")
    asked = Bloom.of(ids.select("h"))
    texts = asked.filter(known.withColumn("h", F.xxhash64("doc_id")), "h").join(ids.drop("h"), ["lang", "doc_id"]).select("lang", "text")

    def run(batches):
        for batch in batches:
            found: dict[str, np.ndarray] = {}
            data, at = utf8(batch.column("text"))
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                b, n = np.unique(_buckets(data[at[i] : at[i + 1]].tobytes()), return_counts=True)
                if lang not in found and len(found) == PART:
                    yield from counted(found)
                    found = {}
                found.setdefault(lang, np.zeros(1 << BITS))[b] += n
            yield from counted(found)

    def counted(found):
        for lang, own in found.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "b": pa.array(used), "n": pa.array(own[used])})

    counts = materialize(texts.mapInArrow(run, "lang string, b bigint, n double").groupBy("lang", "b").agg(F.sum("n").alias("n")), "language-counts")
    parts = []
    for first in range(0, len(languages), PART):
        some = languages[first : first + PART]
        own = np.full((1 << BITS, len(some)), 0.5)
        part = counts.where((F.col("lang") >= some[0]) & (F.col("lang") <= some[-1])).toArrow()
        place = {lang: k for k, lang in enumerate(some)}
        own[part.column("b").to_numpy(), [place[x] for x in part.column("lang").to_pylist()]] += part.column("n").to_numpy()
        parts.append(spark.sparkContext.broadcast(np.log(own / own.sum(0))))
        if len(languages) > PART:
            vars(parts[-1]).pop("_value", None)  # what was sent lies on disk
    return Model(languages, parts)


_OPEN, _HTML = re.compile(r"(?i)<(script|style)\b"), re.compile(r"(?i)<html\b")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_DECLARED = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]+)""")
_ENTITY = re.compile(r"&\w+;")
_HOST = re.compile(r"://([^/?#]*)")


def visible(html: str) -> str:
    """The text of a page: without tags, comments, scripts, styles and named entities. What is never closed is not
    looked for again, so the time is linear in the page."""
    out, at, missing = [], 0, set()
    while (tag := html.find("<", at)) >= 0:
        out.append(html[at:tag])
        end = -1
        if html.startswith("<!--", tag) and "--" not in missing:
            end = html.find("-->", tag + 4) + 3
            if end == 2:
                missing.add("--")
        elif (opened := _OPEN.match(html, tag)) and (name := opened[1].lower()) not in missing:
            closed = _CLOSE[name].search(html, opened.end())
            end = closed.end() if closed else -1
            if not closed:
                missing.add(name)
        if end < 3:
            end = html.find(">", tag) + 1
        if not end:  # no tag ends any more
            at = tag
            break
        at = end
    out.append(html[at:])
    return _ENTITY.sub(" ", " ".join(out))


def declared_language(html: str) -> str:
    """The lang attribute of the first html tag, lower-cased, without a region; empty without one."""
    tag = _HTML.search(html)
    if not tag:
        return ""
    end = html.find(">", tag.end())
    said = _DECLARED.search(html, tag.end(), end if end >= 0 else len(html))
    return said[1].lower() if said else ""


def host_of(url: str) -> str:
    """The host of a url, lower-cased, without user and port; empty without ://."""
    found = _HOST.search(url)
    host = found[1].rpartition("@")[2].lower() if found else ""
    return host if host.startswith("[") else host.partition(":")[0]


def evidence(pages: DataFrame, model: Model) -> DataFrame:
    """row (a number of its own), page_id, host, domain, suffix, declared, logs (of the text, by language)."""
    names = pages.sparkSession.sparkContext.broadcast(frozenset(model.languages))
    parts = model.parts

    def run(batches):
        for batch in batches:
            hosts, domains, suffixes, declared, texts = [], [], [], [], []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url or "")
                labels = host.split(".")
                hosts.append(host)
                domains.append(".".join(labels[-2:]))
                suffixes.append(labels[-1])
                said = declared_language(html or "")
                declared.append(said if said in names.value else ("other" if said else "none"))
                texts.append(visible(html or "").encode())
            logs = [[] for _ in texts]
            for part in parts:
                own = part.value
                for text, row in zip(texts, logs):
                    row += (own[_buckets(text)].sum(0) * TEMPER).tolist()
                if len(parts) > 1:
                    vars(part).pop("_value", None)  # one part at a time is held
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("page_id"), pa.array(hosts), pa.array(domains), pa.array(suffixes), pa.array(declared), pa.array(logs, pa.list_(pa.float64()))],
                ["row", "page_id", "host", "domain", "suffix", "declared", "logs"],
            )

    kind = dict(pages.dtypes)["page_id"]
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html")
    return numbered.mapInArrow(run, f"row bigint, page_id {kind}, host string, domain string, suffix string, declared string, logs array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host: one row per row of pages.

    A null url has an empty host, which is a host like any other; null or empty html has no text, and its
    language comes from the priors. Ties go to the language first in the alphabet. Rows that repeat are
    answered alike. Without any labelled document lang is null. Other columns are not looked at.
    """
    model = train(docs)
    languages = model.languages
    if not languages:
        none = F.lit(None).cast("string")
        return evidence(pages, model).select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared", "host")
    spark = pages.sparkSession
    pages_ = materialize(evidence(pages, model), "page-evidence")
    top = F.array_max("logs")
    total = F.aggregate(F.transform("logs", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    rows = pages_.select("row", "host", "domain", "suffix", "declared", top.alias("top"), total.alias("total"), F.posexplode("logs").alias("k", "log"))
    rows = rows.withColumn("p", F.round(F.exp(F.col("log") - F.col("top")) / F.col("total"), 6)).drop("top", "total")
    rows = materialize(rows, "page-language")
    whole = rows.groupBy("k").agg((F.sum("p") + 1).alias("w")).collect()  # a row a language
    all_w = sum(r["w"] for r in whole)
    known = spark.createDataFrame([(r["k"], r["w"], languages[r["k"]]) for r in whole], "k int, w double, lang string")
    for name, key in (("h", "host"), ("d", "domain"), ("s", "suffix"), ("said", "declared")):
        rows = materialize(salted_lookup(rows, [key, "k"], [(name, F.round(F.sum("p"), 6), F.sum)]), f"page-{key}")  # a lookup reads its rows twice
    rows = rows.join(F.broadcast(known.drop("lang")), "k")
    own = Window.partitionBy("row")

    def shrunk(name: str, parent):
        rest = F.col(name) - F.col("p")
        n = F.sum(rest).over(own)
        return (F.greatest(rest, F.lit(0.0)) + SHRINK * parent) / (F.greatest(n, F.lit(0.0)) + SHRINK)

    rows = rows.withColumn("prior", shrunk("d", F.col("w") / F.lit(all_w))).withColumn("prior", shrunk("h", F.col("prior")))
    declared = (F.col("said") + 1) / (F.col("w") + len(languages) + 2)
    suffix = (F.greatest(F.col("s") - F.col("p"), F.lit(0.0)) + 1) / (F.col("w") + 1)
    rows = rows.select("row", "k", "log", (F.log("prior") + F.col("log") + F.log(declared) + F.log(suffix)).alias("v"))
    rows = rows.withColumn("top", F.max("v").over(own))
    best = rows.groupBy("row").agg(
        F.max(F.struct("v", (-F.col("k")).alias("k"))).alias("best"), F.max(F.struct("log", (-F.col("k")).alias("k"))).alias("text"), (1 / F.sum(F.exp(F.col("v") - F.col("top")))).alias("sure"),
    ).select("row", (-F.col("best.k")).alias("k"), (-F.col("text.k")).alias("text_k"), F.round("sure", 6).alias("confidence"))
    names = known.select("k", "lang")
    best = best.join(F.broadcast(names), "k").join(F.broadcast(names.toDF("text_k", "text_lang")), "text_k")
    return pages_.join(best, "row").select("page_id", "lang", "confidence", "text_lang", "declared", "host")
