"""The queries of the text operators over the test tables, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

import os

from . import chat_format, decontaminate, exact_dedup, jaccard_join, language_id, secret_scan, sentencepiece_codec, suffix_dedup, toxicity, url_filter
from .shared import table

#: A public vocabulary; operators take any path.
TOKENIZER = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_chat_format(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.join_sets(table(spark, sf_dir, "documents"), k=3, num=90)


def op4_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op8_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), TOKENIZER)


OP7 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ') || chr(1)] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o WHERE 100 * c >= 90 * (na + nb - c)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) m ON m.d = s.doc_id
"""


def _op4() -> str:
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        rx = rule.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.least} AS least, {str(rule.base).lower()} AS base, string_split_regex(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}') AS ms, regexp_extract_all(t, '{rx}', {rule.group}) AS vs FROM d WHERE regexp_matches(t, '{rx}')")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}), e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
 p AS (SELECT doc_id, kind, ord, base, least, vs[i] AS v, length(ms[i]) AS size, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM e),
 g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, ord) FILTER (base) AS b, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, ord) AS spans, count(*) AS n_found FROM p WHERE length(v) >= least GROUP BY 1)
 SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.RULES if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_found, 0) AS n_found FROM d LEFT JOIN g USING (doc_id)"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat_format.ORACLE, "op3_jaccard_join": OP3, "op4_secret_scan": _op4(), "op7_exact_dedup": OP7}
