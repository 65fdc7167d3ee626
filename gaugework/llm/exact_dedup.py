"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so, so that equal stretches give equal chunks.
A chunk's identifier is its 64-bit hash, verified: the distinct chunks of the corpus are grouped by
hash and compared in full, and where one hash stands for several chunks a rank among them is added.
A text is then its ordered list of identifiers, its recipe, and texts are equal when recipes are.
Each distinct chunk is shuffled once, and whole texts never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, salted_lookup

#: A chunk has at least LEAST characters and ends behind a line feed or behind the first letter of a word
#: in i-t that follows a word ending in a, e, o or s; without such a place it ends after MOST characters.
LEAST, MOST = 1024, 8192


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    return rf"(?s).{{{least},{most}}}?(?:\n|[aeos] [i-t])|.{{1,{most}}}"


def exact_groups(docs: DataFrame, least: int = LEAST, most: int = MOST, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest doc_id stays; a null doc_id is smaller than any other. Rows that repeat a doc_id are
    one document: all of them get the same answer and count in group_size. An empty table gives an empty
    result; columns other than doc_id and text are not looked at.
    hash_bits below 64 shortens the identifiers, so that tests meet collisions.
    """

    def ident(c):
        h = F.xxhash64(c)
        return h if hash_bits >= 64 else F.pmod(h, F.lit(1 << hash_bits))

    texts = docs.select(F.col("doc_id"), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    cut = texts.select("doc_id", "t", F.regexp_extract_all("t", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks"))
    recipes = materialize(
        cut.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").alias("n"), F.transform("chunks", ident).alias("recipe")),
        "recipes",
    )
    chunks = cut.select(F.explode("chunks").alias("chunk")).select(ident(F.col("chunk")).alias("h"), "chunk")
    distinct = chunks.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    shared = materialize(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "shared-hashes")
    if shared.isEmpty():  # every hash stands for one chunk: the hashes are verified identifiers
        recipes = recipes.withColumn("ranks", F.array().cast("array<int>"))
    else:
        recipes = _with_ranks(cut, recipes, distinct, shared, ident)
    keyed = salted_lookup(
        recipes,
        ["n", "recipe", "ranks"],
        [("keep_id", F.max("doc_id"), F.max), ("group_size", F.count(F.lit(1)), F.sum)],
    )
    return keyed.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"),
    )


def _with_ranks(cut, recipes, distinct, shared, ident):
    """Adds to each recipe the rank of each chunk among those of the same hash (0 for most)."""
    from pyspark.sql import Window

    ranked = distinct.join(shared.select("h"), "h", "left_semi")
    ranked = ranked.select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("rank"))
    places = cut.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk"))
    places = places.withColumn("h", ident(F.col("chunk"))).join(shared.select("h"), "h", "left_semi").join(ranked, ["h", "chunk"])
    lists = places.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", "rank"))).alias("marks"))
    left, right = recipes.alias("a"), lists.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.text_sha256"))
    marks = F.coalesce(F.transform("b.marks", lambda m: m["rank"]), F.array().cast("array<int>"))
    return left.join(right, same, "left").select("a.*", marks.alias("ranks"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    A row is told by doc_id and text together: rows without a doc_id, or that repeat one, stay if their texts differ.
    """
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).distinct()
    told = docs.withColumn("_text", F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    same = told["doc_id"].eqNullSafe(kept["_kept_id"]) & (told["_text"] == kept["_kept_text"])
    return told.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text"]).drop("_text")
