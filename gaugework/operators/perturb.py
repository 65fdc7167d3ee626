"""Perturbations of prompts and conversations, drawn by hashes of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng

# The choices of each formatting axis.
SEPARATORS = (": ", "\n", "-> ")
CASINGS = ("original", "upper", "lower")
PUNCTUATION = ("?", ".", "")
PADDING = ("", " ", "  ", "\n", "\t")
TIERS = ("small", "medium", "large")
STRENGTHS = ("light", "moderate", "heavy")


def _choice(options, *key) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (rng.pick(len(options), *key) + 1).cast("int"))


def atoms(seed: int, key: Column) -> Column:
    """The formatting drawn for a key: separator, casing, punctuation, padding."""
    names = {"separator": SEPARATORS, "casing": CASINGS, "punctuation": PUNCTUATION, "padding": PADDING}
    return F.struct(*[_choice(o, seed, F.lit(n), key).alias(n) for n, o in names.items()])


def paraphrase(seed: int, key: Column) -> Column:
    """Which rewriting model and how strong; rewriting changes content, so it is flagged as a confound."""
    return F.struct(_choice(TIERS, seed, F.lit("tier"), key).alias("tier"), _choice(STRENGTHS, seed, F.lit("strength"), key).alias("strength"), F.lit(True).alias("confound"))


_QUOTED = r'"(?:[^"\\]|\\.)*"'


def region(text: Column) -> Column:
    """The longest double-quoted region of a text, quotes left off; backslash escapes count as inside. The first of equals."""
    found = F.regexp_extract_all(text, F.lit(f"({_QUOTED})"), F.lit(1))
    best = F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.length(best) >= 2, F.substring(best, F.lit(2), F.length(best) - 2))


def _ascii(column: Column, up: bool) -> Column:
    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, low, high) if up else F.translate(column, high, low)


def apply(text: Column, a: Column) -> Column:
    """The text with its longest quoted region rewritten: label separator, casing, end punctuation and padding."""
    inner = region(text)
    plain = F.coalesce(F.from_json(F.concat(F.lit('["'), inner, F.lit('"]')), "array<string>")[0], inner)
    label = F.regexp_replace(plain, r"^(\w+): ", F.concat(F.lit("$1"), a["separator"]))
    cased = F.when(a["casing"] == "upper", _ascii(label, True)).when(a["casing"] == "lower", _ascii(label, False)).otherwise(label)
    ended = F.concat(F.regexp_replace(cased, r"[?.!]+$", ""), a["punctuation"], a["padding"])
    json = F.to_json(F.array(ended))
    escaped = F.substring(json, F.lit(3), F.length(json) - 4)
    old = F.concat(F.lit('"'), inner, F.lit('"'))
    at = F.instr(text, old)
    spliced = F.concat(F.substring(text, F.lit(1), at - 1), F.lit('"'), escaped, F.lit('"'), F.substring(text, at + F.length(old), F.length(text)))
    return F.when(inner.isNull() | (at == 0), text).otherwise(spliced)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): messages (role, content) in order of turn; blank ones are left out."""
    rows = turns.where("text IS NOT NULL AND trim(text) != ''").select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    g = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return g.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def truncate(messages: Column, n: Column) -> Column:
    """The first n messages; the whole unless 0 < n < size."""
    return F.when((n > 0) & (n < F.size(messages)), F.slice(messages, 1, n)).otherwise(messages)


def reorder(messages: Column, seed: int, key: Column) -> Column:
    """Messages shuffled by hash; rotated by one if the shuffle changes nothing. Needs two messages."""
    tagged = F.transform(messages, lambda m, i: F.struct(rng.shuffle_key(seed, key, i).alias("k"), m.alias("m")))
    mixed = F.transform(F.array_sort(tagged), lambda x: x["m"])
    rotated = F.concat(F.slice(messages, 2, F.greatest(F.lit(1), F.size(messages) - 1)), F.slice(messages, 1, 1))
    return F.when(F.size(messages) < 2, messages).when(mixed == messages, rotated).otherwise(mixed)


def inject(messages: Column, message: Column, position: Column) -> Column:
    """A message put in at a position (from 0, at most the size)."""
    at = F.greatest(F.lit(0), F.least(position, F.size(messages)))
    return F.array_insert(messages, at + 1, message)
