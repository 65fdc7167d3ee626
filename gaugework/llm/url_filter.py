"""URL filtering: a rule list first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs: those that a rule decides, with the rule's verdict as label, from at most
MOST_LABELLED of either verdict, chosen by a hash of the url and weighted back to the verdicts' shares among all
labelled URLs. Features: lengths, depth, digit ratio, entropy, parameter counts, and statistics of the host's
suffixes and the first segment (share of blocked among all labelled URLs, by grouped aggregation).
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import boost
from .shared import ascii_lower, materialize, salted_join, salted_lookup

MOST_LABELLED = 5000
#: Weight of the share among all labelled urls in a suffix's, in urls.
PULL = 5
#: Verdict, host and path prefix of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def split_url(url):
    """Host (A-Z lower-cased) and path of a url column; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict): the longest rule that fits."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for what, of_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == of_host) | F.col("host").endswith("." + of_host)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, of_host + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def with_cell(rows: DataFrame) -> DataFrame:
    """rows with cell: the last two labels of the host, then the first segment of the path behind a slash."""
    return rows.withColumn("cell", F.concat(F.substring_index("host", ".", -2), F.lit("/"), F.regexp_extract("path", "^/*([^/]*)", 1)))


def suffix_shares(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(cell, shares) of every cell, and how many labelled urls there are and how many of them are blocked.

    shares: the share of blocked among all labelled urls with the cell's top-level domain, domain, first segment,
    and top-level domain with first segment, drawn towards that of all by PULL urls. Each url counts once.
    """
    ruled = F.col("ruled").isNotNull().cast("long")
    urls = rows.select("url", "cell", "ruled").distinct()
    cells = materialize(urls.groupBy("cell").agg(F.sum(ruled).alias("n"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked")), "url-cells")
    total, blocked = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    domain, first = F.substring_index("cell", "/", 1), F.substring_index("cell", "/", -1)
    tld = F.substring_index(domain, ".", -1)
    kinds = F.array(tld, domain, first, F.concat(tld, F.lit("/"), first))
    long_ = cells.select("cell", "n", "blocked", F.posexplode(kinds).alias("kind", "key"))
    sums = salted_lookup(long_, ["kind", "key"], [("all_n", F.sum("n"), F.sum), ("all_blocked", F.sum("blocked"), F.sum)])
    share = (F.col("all_blocked") + PULL * (blocked / max(1, total))) / (F.col("all_n") + PULL)
    wide = sums.groupBy("cell").agg(*[F.max(F.when(F.col("kind") == k, share)).alias(f"k{k}") for k in range(4)])
    return materialize(wide.select("cell", F.array(*[f"k{k}" for k in range(4)]).alias("shares")), "url-shares"), total, blocked


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    _, n = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(url: str, host: str, path: str) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    segments = [s for s in path.split("/") if s]
    first = segments[0] if segments else ""
    digits = len(re.findall(r"\d", url))
    return [
        len(url), len(host), len(path), len(segments), host.count("."), host.count("-"), path.count("-"),
        digits / max(1, len(url)), len(re.findall(r"\d", host)), _entropy(host), _entropy(path),
        query.count("=") + query.count("&"), len(query), float("#" in url), float(url.startswith("https:")), len(first),
        float(path.endswith("/")), len(re.findall(r"%[0-9A-Fa-f]{2}", url)),
    ]


def features(urls, hosts, paths, shares) -> np.ndarray:
    rows = [lexical(url or "", host, path) + list(own) for url, host, path, own in zip(urls, hosts, paths, shares)]
    return np.array(rows, float) if rows else np.zeros((0, 1))


def fit(labelled, total: int, blocked: int):
    """Trees from rows of (url, host, path, shares, ruled), weighted so that blocked of total weigh as they do among all labelled urls."""
    urls, hosts, paths, shares, ruled = zip(*labelled) if labelled else [()] * 5
    y = np.array([r == "block" for r in ruled], float)
    weight = np.ones(len(y))
    for label, of_all in ((1.0, blocked), (0.0, total - blocked)):
        weight[y == label] = of_all / total * len(y) / max(1, (y == label).sum()) if total else 1.0
    return boost(features(urls, hosts, paths, shares), y, weight=weight)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the trees: likelihood of block), one row per row of pages.

    A null url, or one without ://, has an empty host and path and gets the trees' verdict. Without labelled
    urls of both verdicts the trees give a constant: allow unless all labels say block. An empty table gives
    an empty result; columns other than page_id and url are not looked at.
    """
    rows = with_cell(judged(pages, rules))
    shares, total, blocked = suffix_shares(rows)
    pick = F.xxhash64("url")
    known = [rows.where(F.col("ruled") == v).select("url", "host", "path", "ruled", "cell").distinct().orderBy(pick, "url").limit(MOST_LABELLED) for v in ("block", "allow")]
    sample = shares.join(F.broadcast(known[0].unionByName(known[1])), "cell").select("url", "host", "path", "shares", "ruled")  # bounded: 2 x MOST_LABELLED
    trees = fit(sorted(map(tuple, sample.collect()), key=lambda r: r[0]), total, blocked)
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            x = features(*(batch.column(c).to_pylist() for c in ("url", "host", "path", "shares")))
            p = shared.value.probability(x) if len(x) else np.zeros(0)
            said = ["block" if v >= 0.5 else "allow" for v in p]
            verdict = [r if r is not None else s for r, s in zip(batch.column("ruled").to_pylist(), said)]
            keep = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(verdict, pa.string()), pa.array(p, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = dict(pages.dtypes)["page_id"]
    return salted_join(rows, "cell", shares).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
