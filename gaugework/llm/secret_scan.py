"""Secret scanning through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query. The index lists, for every trigram that some
query asks for, the documents that hold it; a rule's candidates are what its query selects from these
postings, and only candidates are searched with the expression. A rule without mandatory trigrams is
searched in every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize
from .trigram_query import Query, derive, trigrams


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share. A match counts if its group has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


#: The base rules in the order in which ties of start are listed, then further formats of keys.
#: The run patterns carry their least length: for a maximal run that gives the same matches.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)
#: Up to so many candidates are sent to all executors, some 40 bytes each; more of them meet their texts in a shuffle.
SENT = 500_000


def _matches(text, rule: Rule, order: int):
    """A rule's matches in a text: (ord, pos, gap before it, size, size of the group), in code points."""
    rx = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), lambda x: F.length(x)).alias("value"),
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
    )
    found = F.filter(found, lambda x: x["size"].isNotNull())  # a gap more than matches
    found = F.transform(found, lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("pos"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.when(F.rlike(text, rx), found).otherwise(F.array().cast(MATCH))


MATCH = "array<struct<ord:int,pos:int,gap:int,size:int,value:int>>"
SPAN = "array<struct<start:bigint,ord:int,stop:bigint,kind:string>>"


def _admits(query: Query, present):
    """The query over a document's set of indexed trigrams."""
    clauses = [
        [F.size(F.array_intersect(present, F.array(*[F.lit(t) for t in sorted(way)]))) == len(way) for way in clause]
        for clause in query
    ]
    found = F.lit(True)
    for clause in clauses:
        ways = clause[0]
        for way in clause[1:]:
            ways = ways | way
        found = found & ways
    return found


def postings(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """The index: (trigram, doc_id, mark) for every wanted trigram of every document. docs: doc_id, mark, text."""
    lower = docs.select("doc_id", "mark", ascii_lower(F.col("text")).alias("lower"))
    held = F.filter(F.array(*[F.lit(t) for t in sorted(wanted)]), lambda t: F.contains(F.col("lower"), t))
    return lower.select(F.explode(held).alias("trigram"), "doc_id", "mark")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (n_found: all spans).

    Spans are kind:start:end by start, then in the order of rules, comma-joined; positions are code points,
    the end is exclusive. Matches are leftmost and do not overlap within a kind. Null text counts as empty.
    Rows that repeat a doc_id are each answered from their own text. An empty table gives an empty result;
    columns other than doc_id and text are not looked at.
    """
    queries = {r.kind: derive(r.pattern) for r in rules}
    wanted = set().union(*map(trigrams, queries.values()))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    indexed = [r for r in rules if queries[r.kind]]
    full = [r for r in rules if not queries[r.kind]]

    lists = postings(texts, wanted).groupBy("doc_id", "mark").agg(F.collect_set("trigram").alias("present"))
    flags = lists.select("doc_id", "mark", *[_admits(queries[r.kind], F.col("present")).alias(f"may_{r.kind}") for r in indexed])
    flags = materialize(flags.where(" OR ".join(f"may_{r.kind}" for r in indexed)), "secret-candidates")
    flags = flags.hint("broadcast" if flags.count() <= SENT else "shuffle_hash")
    left, right = texts.alias("a"), flags.alias("b")
    same = (F.col("a.mark") == F.col("b.mark")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    none = F.array().cast(MATCH)
    verified = left.join(right, same).select(
        "a.doc_id", "a.mark", F.flatten(F.array(*[F.when(F.col(f"b.may_{r.kind}"), _matches(F.col("a.text"), r, rules.index(r))).otherwise(none) for r in indexed])).alias("found")
    )
    scanned = texts.select("doc_id", "mark", F.flatten(F.array(none, *[_matches(F.col("text"), r, rules.index(r)) for r in full])).alias("found"))
    # a match starts behind the gaps and matches before it: sums along the matches of a text and rule
    rows = verified.unionByName(scanned).where(F.size("found") > 0).select("doc_id", "mark", F.explode("found").alias("m")).select("doc_id", "mark", "m.*")
    rows = rows.dropDuplicates(["doc_id", "mark", "ord", "pos"])  # rows that repeat a text
    start = F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(Window.partitionBy("doc_id", "mark", "ord").orderBy("pos")) - F.col("size")
    rows = rows.withColumn("start", start)
    least, kind = (F.array(*[F.lit(v) for v in values])[F.col("ord")] for values in ([r.least for r in rules], [r.kind for r in rules]))
    rows = rows.where(F.col("value") >= least).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "ord", (F.col("start") + F.col("size")).alias("stop"), kind.alias("kind"))).alias("spans"))
    left, right = texts.select("doc_id", "mark").alias("a"), rows.alias("b")
    both = left.join(right, same, "left").select("a.doc_id", F.array_sort(F.coalesce("b.spans", F.array().cast(SPAN))).alias("spans"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return both.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found"),
    )
