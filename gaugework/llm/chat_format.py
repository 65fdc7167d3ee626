"""Chat formatting: collapses cumulative snapshots of conversations, then renders what is left.

A log often holds a conversation again and again, each time some turns longer. Every turn gets the hash of
the turns up to it: two 64-bit hashes of (position, role, text), xor-ed along the conversation, so that
the prefix hashes roll forward in one window, over hashes alone. A conversation whose last hash is a proper prefix's hash
elsewhere is a snapshot and goes by anti-join; of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _keyed(turns: DataFrame) -> DataFrame:
    """turns with key, the conversation: that of conv_id, or, without one, one of the row's own."""
    own = F.sha2(F.to_json(F.struct("turn", "role", "text")), 256)
    return turns.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("r"), own)).alias("key"), "conv_id", "turn", "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """key, conv_id, pos (from 1), p1, p2 (hash of the turns up to pos), last. turns: as _keyed gives them.

    Only hashes of the turns are shuffled. Where a conversation has several lines of one turn number, these are
    fetched to be ordered by role and text.
    """
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = turns.select("key", "conv_id", "turn", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7919), *parts).alias("h2"), "role", "text")
    rows = hashed.drop("role", "text").distinct()
    tied = materialize(rows.groupBy("key", "turn").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("key", "turn"), "tied-turns")
    if tied.isEmpty():
        rows = rows.withColumn("nth", F.lit(0))
    else:
        left, right = hashed.alias("a"), tied.alias("b")
        lines = left.join(right, (F.col("a.key") == F.col("b.key")) & F.col("a.turn").eqNullSafe(F.col("b.turn")), "left_semi").distinct()
        lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy("key", "turn").orderBy("role", "text")))
        left, right = rows.alias("a"), lines.select("key", "turn", "h1", "h2", "nth").alias("b")
        same = (F.col("a.key") == F.col("b.key")) & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
        rows = left.join(right, same, "left").select("a.*", F.coalesce("b.nth", F.lit(0)).alias("nth"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("turn", "nth")))
    rows = rows.select("key", "conv_id", "pos", F.xxhash64("pos", "h1", "h2").alias("h1"), F.xxhash64(F.lit(7919), "pos", "h1", "h2").alias("h2"))
    order = Window.partitionBy("key").orderBy("pos")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "key", "conv_id", "pos", F.bit_xor("h1").over(run).alias("p1"), F.bit_xor("h2").over(run).alias("p2"),
        F.lead("pos").over(order).isNull().alias("last"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered.

    Turns are ordered by (turn, role, text), nulls first; rows that repeat exactly count once. A row without
    a conv_id is a conversation of its own. Null role or text renders as empty. n_copies counts the logged
    conversations equal to this one, itself included; conv_id is the smallest of theirs. An empty table gives
    an empty result; other columns are not looked at.
    """
    turns = _keyed(turns)
    hashes = materialize(prefix_hashes(turns), "turn-prefixes")
    whole = hashes.where("last").groupBy("pos", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    proper = hashes.where("NOT last").select("pos", "p1", "p2").distinct()
    maximal = whole.join(proper, ["pos", "p1", "p2"], "left_anti").select("first.key", F.col("pos").cast("long").alias("n_turns"), "n_copies")
    # the join and the grouping share one shuffle, the only one that moves texts, of those that stay
    lines = turns.join(maximal, "key").groupBy("key", "n_turns", "n_copies").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("lines"))
    text = F.transform(
        "lines",
        lambda x: F.concat(F.lit(START), F.coalesce(x["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(x["text"], F.lit("")), F.lit(END)),
    )
    return lines.select("conv_id", "n_turns", "n_copies", F.array_join(text, "").alias("rendered"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN row(turn, role, text) END AS own, turn, role, text FROM conversations),
 c AS (SELECT conv_id, count(*) AS n,
   string_agg(md5(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS sig,
   string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
   FROM t GROUP BY conv_id, own),
 u AS (SELECT sig, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies, any_value(rendered) AS rendered FROM c GROUP BY sig)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.n_turns > u.n_turns AND starts_with(v.sig, u.sig))
"""
