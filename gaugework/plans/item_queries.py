"""Item response, audit logs, perturbations, log readers and the stream monitor over the test tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.rng import duck_uniform
from ..operators import adaptive, audit, items, perturb
from ..sources import trial_logs as T
from ..streaming import monitor as M
from . import bindings as B


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def irt_prob(spark, sf):
    p = B.pool(spark, sf)
    return _r(p.select("id", items.probability(F.lit(0.5), F.col("discrimination"), F.col("difficulty")).alias("p"), items.information(F.lit(0.5), F.col("discrimination"), F.col("difficulty")).alias("info")))


def irt_info(spark, sf):
    return _r(items.test_information(B.pool(spark, sf)), 5)


def irt_min_info(spark, sf):
    return _r(items.least_information(B.pool(spark, sf)), 5)


def _answers(spark, sf):
    """Responses with item parameters by rule: easier the more often an item is answered right."""
    r = B.responses(spark, sf)
    p = r.groupBy("item").agg(F.avg("y").alias("p")).select("item", (2 - 4 * F.col("p")).alias("difficulty"), (0.6 + F.col("p")).alias("discrimination"))
    return r.join(p, "item")


def irt_eap(spark, sf):
    return _r(items.eap(_answers(spark, sf)), 4)


def irt_mle(spark, sf):
    return _r(items.mle(_answers(spark, sf)), 4)


def irt_estimate(spark, sf):
    return _r(items.estimate(_answers(spark, sf)), 4)


def sel_uniform(spark, sf):
    return items.select_uniform(B.pool(spark, sf), 20, 42).select("id")


def sel_stratified(spark, sf):
    return items.select_stratified(B.pool(spark, sf), 3, 20, 42).select("id", "content_domain")


def sel_max_info(spark, sf):
    return items.select_max_info(B.pool(spark, sf), 0.25, 5, 20, 42).select("id")


def sel_minimax(spark, sf):
    ids = adaptive.select_minimax(B.pool(spark, sf), 5)
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "step int, id long")


def sel_exposure(spark, sf):
    p = B.pool(spark, sf)
    a = items.eligible(p, "max", 3).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("max"))
    b = items.eligible(p, "conditional", 3, 0.25, 42).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("conditional"))
    return a.unionByName(b)


def cat_simulate(spark, sf):
    people = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("person"), ((F.col("c_acctbal") / 5000) - 1).alias("theta"))
    return _r(adaptive.adaptive_tests(B.pool(spark, sf), people, 12, seed=42), 4)


def sched_generate(spark, sf):
    d = items.schedule(B.table(spark, sf, "benchmark").select(F.col("item_id").alias("item")), 10, 0.3, 4, 42)
    return d.withColumn("family", F.coalesce("family", F.lit(-1).cast("long")))


def sched_coverage(spark, sf):
    return _r(items.coverage(sched_generate(spark, sf)))


def pool_ops(spark, sf):
    p = B.pool(spark, sf)
    return items.pool_findings(p.unionByName(p.where("id % 2 = 0")))


def record_exposure(spark, sf):
    given = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return items.record_exposure(B.pool(spark, sf), given).select("id", F.col("exposure_count").cast("long").alias("exposure_count"))


def cal_irt(spark, sf):
    return _r(items.calibrate_2pl(B.responses(spark, sf)), 3)


def cal_schema(spark, sf):
    return items.pool_findings(B.pool(spark, sf).withColumn("discrimination", F.col("discrimination") - 0.6))


def cal_factors(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    d = B.table(spark, sf, "lineitem").select(*cols)
    load, values = items.principal_factors(d, cols, 2)
    return _r(spark.createDataFrame([(c, abs(float(a)), abs(float(b))) for c, (a, b) in zip(cols, load)], "column string, f1 double, f2 double"), 2)


MODEL = "ab" * 32


def _chain(spark, sf):
    e = B.table(spark, sf, "events")
    base = F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("actor")))
    return audit.seal_frame(e.select(F.col("event_id").alias("idx"), base.alias("base")), MODEL)


def aud_seal(spark, sf):
    c = _chain(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("n"), F.max_by("entry_hash", "idx").alias("head"), F.count_if(F.col("type") == "genesis").alias("genesis"))


def aud_verify(spark, sf):
    """A chain with three planted faults."""
    c = _chain(spark, sf)
    bad = c.withColumn("base", F.when(F.col("idx") == 17, F.lit('{"x":1}')).otherwise(F.col("base"))).withColumn("seq", F.when(F.col("idx") == 40, F.lit(99).cast("long")).otherwise(F.col("seq")))
    return audit.verify(bad.where("idx != 60"), MODEL)


def aud_replay(spark, sf):
    c = _chain(spark, sf)
    line = F.to_json(F.struct("seq", "entry_hash"))
    d = c.select("idx", line.alias("line")).crossJoin(c.agg(F.max("idx").alias("n")))  # one row on the right
    return audit.replay(d.select("idx", F.when(F.col("idx") == F.col("n"), F.substring("line", 1, 9)).otherwise(F.col("line")).alias("line"))).select("idx", "status")


def aud_emit(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("detail"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("last"), F.substring_index("text", "\n", -1)).alias("tags"))
    return audit.check_events(d).select("doc_id", "status", F.coalesce("blob", F.lit("")).alias("blob"))


def blob_store(spark, sf):
    return audit.blobs(B.table(spark, sf, "documents").select(F.col("text").alias("content")))


def blob_gc(spark, sf):
    d = B.table(spark, sf, "documents")
    stored = audit.blobs(d.select(F.col("text").alias("content")))
    refs = d.where("lang = 'en'").select(F.sha2("text", 256).alias("sha")).distinct()
    return audit.unreferenced(stored, refs)


def aud_canonical(spark, sf):
    rows = [({"b": 1, "a": [True, None, "é\n"]}, "ok"), ({"é": {"z": 1, "a": "\x01"}}, "ok")]
    return spark.createDataFrame([(audit.canonical(v), s) for v, s in rows], "json string, status string")


def pert_atoms(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", perturb.atoms(42, F.col("doc_id").cast("string")).alias("a"))
    return d.select("doc_id", "a.separator", "a.casing", "a.punctuation", "a.padding")


def pert_paraphrase(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", perturb.paraphrase(42, F.col("doc_id").cast("string")).alias("a"))
    return d.select("doc_id", "a.tier", "a.strength", "a.confound")


def _prompts(spark, sf):
    b = B.table(spark, sf, "benchmark")
    return b.select("item_id", F.concat(F.lit('ask "Question: '), F.regexp_replace("text", "\n", " "), F.lit('?" or "no"')).alias("text"))


def pert_region(spark, sf):
    return _prompts(spark, sf).select("item_id", perturb.region(F.col("text")).alias("region"))


def pert_apply(spark, sf):
    return _prompts(spark, sf).select("item_id", perturb.apply(F.col("text"), perturb.atoms(42, F.col("item_id").cast("string"))).alias("text"))


def pert_multiturn(spark, sf):
    c = perturb.conversations(B.table(spark, sf, "conversations"))
    key, m = F.col("conv_id").cast("string"), F.col("messages")
    extra = F.struct(F.lit("user").alias("role"), F.lit("Are you sure?").alias("content"))
    show = lambda x: F.array_join(F.transform(x, lambda y: F.concat(y["role"], F.length(y["content"]).cast("string"))), ">")
    return c.select("conv_id", show(perturb.truncate(m, F.lit(2))).alias("cut"), show(perturb.reorder(m, 42, key)).alias("mixed"), show(perturb.inject(m, extra, F.lit(1))).alias("more"))


def _lines(spark, sf):
    """Events written as JSON lines, a few of them broken or odd."""
    e = B.table(spark, sf, "events")
    ok = F.to_json(F.struct(F.col("event_type").alias("task_id"), F.col("user_id").alias("agent_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.unix_timestamp("ts").alias("timestamp"), F.when(F.col("value") > 100, F.lit(1.5)).otherwise(F.floor("value") / 100.0).alias("score")))
    line = F.when(F.col("event_id") % 100 == 7, F.lit("{broken")).when(F.col("event_id") % 100 == 8, F.lit('{"task_id": "t"}')).when(F.col("event_id") % 100 == 9, F.lit('{"task_id": "t", "agent_id": "a", "score": [1], "timestamp": 1700000000}')).otherwise(ok)
    return e.select(F.col("event_id").alias("ord"), line.alias("line"))


NOW = 1800000000


def src_jsonl(spark, sf):
    d = T.from_jsonl(_lines(spark, sf), T.Mapping(), NOW)
    g = d.groupBy(F.coalesce("warning", F.lit("none")).alias("warning"), F.coalesce(F.when(F.col("warning").isNull(), F.col("task_id")), F.lit("")).alias("task_id"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("warning").isNull(), T.outcome_value(F.col("outcome")))), F.lit(0.0)), 4).alias("total"))


def outcome_map(spark, sf):
    values = ["true", "false", '"PASS"', '"i"', "0", "2.5", "300", '"maybe"', "[1]", "null"]
    d = spark.createDataFrame([(i, f'{{"task_id":"t","agent_id":"a","score":{v}}}') for i, v in enumerate(values)], "ord long, line string")
    show = lambda o: F.coalesce(F.concat_ws(":", o["type"], o["b"].cast("string"), o["score"].cast("string"), o["graded"].cast("string")), F.lit(""))
    return d.select("ord", *[show(T.map_outcome(F.col("line"), T.Mapping(mode=m))).alias(m) for m in ("auto", "binary", "score", "graded")])


def outcome_numbers(spark, sf):
    d = T.from_jsonl(_lines(spark, sf), T.Mapping(), NOW).where("warning IS NULL")
    return d.groupBy("task_id").agg(F.round(F.sum(T.outcome_value(F.col("outcome"))), 4).alias("value"), F.sum(T.outcome_ordinal(F.col("outcome"))).alias("ordinal"))


def _logs(spark, sf):
    """Evaluation logs made of conversations: one document a group of conversations."""
    c = B.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("conv_id") % 4 == 0, F.lit('"C"')).when(F.col("conv_id") % 4 == 1, F.lit('"I"')).when(F.col("conv_id") % 4 == 2, F.lit("0.25")).otherwise(F.lit("[1]"))
    messages = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    sample = F.concat(F.lit('{"id":'), F.col("conv_id").cast("string"), F.lit(',"epoch":1,"completed_at":"2024-01-05T00:00:00Z","messages":'), messages, F.lit(',"scores":{"match":{"value":'), value, F.lit('},"size":{"value":'), F.col("n").cast("string"), F.lit("}}}"))
    g = c.groupBy((F.col("conv_id") % 5).alias("k")).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    return g.select(F.concat(F.lit("log-"), F.col("k").cast("string")).alias("path"), F.concat(F.lit('{"version":"1","eval":{"run_id":"r'), F.col("k").cast("string"), F.lit('","task":"chat","model":"lab/m"},"samples":['), F.array_join("samples", ","), F.lit("]}")).alias("content"))


def src_evallog(spark, sf):
    d = T.from_eval_logs(_logs(spark, sf))
    return d.groupBy("scorer", F.coalesce("outcome.type", F.lit("none")).alias("type"), F.coalesce("warning", F.lit("none")).alias("warning")).agg(F.count(F.lit(1)).alias("n"))


def to_irt(spark, sf):
    t = B.trials(spark, sf)
    t = t.select("run_id", F.concat_ws("-", "task_id", "agent_id").alias("sample_id"), F.col("ord").cast("string").alias("trial_id"), "ord", T._outcome("Binary", b=F.col("passed")).alias("outcome"))
    d = T.to_irt(t)
    return d.select("subject_id", F.size("responses").cast("long").alias("items"), F.aggregate(F.map_values("responses"), F.lit(0), lambda a, x: a + x).cast("long").alias("right"))


def extract_cells(spark, sf):
    m = spark.range(30).select(F.format_string("c%05d", F.col("id")).alias("cell_id"))
    t = B.table(spark, sf, "events").select(F.format_string("c%05d", F.col("user_id") % 25).alias("cell_id"), T._outcome("Binary", b=F.col("value") > 35).alias("outcome"))
    return T.extract_cells(m, t).select("cell_id", F.round(F.coalesce("accuracy", F.lit(-1.0)), 6).alias("accuracy"), "n_samples")


def _stream_rows(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), (F.unix_timestamp("ts") * 1000000 + F.col("event_id")).alias("ord"), F.col("value").alias("x"))


PARAMS = {"theta0": 45.0, "tau2": 0.001}


def str_batch(spark, sf):
    return _r(M.monitor_batch(_stream_rows(spark, sf), **PARAMS), 4)


def str_monitor(spark, sf):
    """The stream over the events, run to its end by availableNow, with its results in a table."""
    from ..functions.storage import scratch

    out, check = scratch(spark, "monitor-out"), scratch(spark, "monitor-check")
    src = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(src.schema).parquet(f"{sf}/event[s].parquet")
    rows = stream.select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), (F.unix_timestamp("ts") * 1000000 + F.col("event_id")).alias("ord"), F.col("value").alias("x"))
    q = M.monitor(rows, **PARAMS).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return _r(spark.read.schema(M.OUTPUT).parquet(out), 4)


def str_summary(spark, sf):
    return M.summary(str_batch(spark, sf))


def str_state(spark, sf):
    return M.state_summary(_stream_rows(spark, sf), str_batch(spark, sf))


QUERIES = {
    "str_state": str_state, "irt_prob": irt_prob, "irt_info": irt_info, "irt_min_info": irt_min_info, "irt_eap": irt_eap, "irt_mle": irt_mle, "irt_estimate": irt_estimate,
    "sel_uniform": sel_uniform, "sel_stratified": sel_stratified, "sel_max_info": sel_max_info, "sel_minimax": sel_minimax, "sel_exposure": sel_exposure,
    "cat_simulate": cat_simulate, "sched_generate": sched_generate, "sched_coverage": sched_coverage, "pool_ops": pool_ops, "pool_record_exposure": record_exposure,
    "cal_irt": cal_irt, "cal_schema": cal_schema, "cal_factors": cal_factors,
    "aud_seal": aud_seal, "aud_verify": aud_verify, "aud_replay": aud_replay, "aud_emit": aud_emit, "aud_canonical": aud_canonical, "blob_store": blob_store, "blob_gc": blob_gc,
    "pert_atoms": pert_atoms, "pert_paraphrase": pert_paraphrase, "pert_region": pert_region, "pert_apply": pert_apply, "pert_multiturn": pert_multiturn,
    "src_jsonl": src_jsonl, "outcome_map": outcome_map, "outcome_to_f64": outcome_numbers, "src_inspect": src_evallog, "to_irt": to_irt, "extract_cells": extract_cells,
    "str_batch": str_batch, "str_monitor": str_monitor, "str_summary": str_summary,
}

_P = "1 / (1 + exp(-discrimination * ({t} - difficulty)))"
_G = "g AS (SELECT -4 + i * (8.0::DOUBLE / 60) AS theta FROM range(61) t(i))"
_ANS = f"WITH {B.RESPONSES}, ip AS (SELECT item, 2 - 4 * avg(y) AS difficulty, 0.6::DOUBLE + avg(y) AS discrimination FROM responses GROUP BY 1), ans AS (SELECT * FROM responses JOIN ip USING (item))"
_SCHED = f"WITH c AS (SELECT DISTINCT item_id AS item, run FROM benchmark, range(10) t(run)), s AS (SELECT run, item, {duck_uniform(chr(39) + '42:hit:' + chr(39) + ' || run || ' + chr(39) + ':' + chr(39) + ' || item')} < 0.3 AS perturbed, CAST(floor({duck_uniform(chr(39) + '42:family:' + chr(39) + ' || run || ' + chr(39) + ':' + chr(39) + ' || item')} * 4) AS BIGINT) AS f FROM c)"


def _pick(options, name, key="doc_id"):
    inner = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    draw = duck_uniform(f"'42:{name}:' || {key}")
    return f"([{inner}])[CAST(floor({draw} * {len(options)}) AS INT) + 1]"


ORACLES = {
    "irt_prob": f"WITH {B.POOL}, p AS (SELECT id, discrimination AS a, {_P.format(t='0.5')} AS p FROM pool) SELECT id, round(p, 6) AS p, round(a * a * p * (1 - p), 6) AS info FROM p",
    "irt_info": f"WITH {B.POOL}, {_G}, p AS (SELECT theta, discrimination AS a, {_P.format(t='theta')} AS p FROM pool, g) SELECT round(theta, 5) AS theta, round(sum(a * a * p * (1 - p)), 5) AS information, round(1 / sqrt(sum(a * a * p * (1 - p))), 5) AS se FROM p GROUP BY theta",
    "irt_min_info": f"WITH {B.POOL}, {_G}, p AS (SELECT theta, discrimination AS a, {_P.format(t='theta')} AS p FROM pool, g), s AS (SELECT sum(a * a * p * (1 - p)) AS i FROM p GROUP BY theta) SELECT round(min(i), 5) AS least FROM s",
    "irt_eap": f"{_ANS}, {_G}, l AS (SELECT person, theta, sum(CASE WHEN y = 1 THEN ln({_P.format(t='theta')}) ELSE ln(1 - {_P.format(t='theta')}) END) - theta * theta / 2 AS l FROM ans, g GROUP BY 1, 2), w AS (SELECT person, theta, exp(l - max(l) OVER (PARTITION BY person)) AS w FROM l)"
    " SELECT person, round(sum(w * theta) / sum(w), 4) AS theta, round(sqrt(greatest(0, sum(w * theta * theta) / sum(w) - (sum(w * theta) / sum(w)) ** 2)), 4) AS se FROM w GROUP BY 1",
    "sel_uniform": f"WITH {B.POOL} SELECT id FROM pool ORDER BY md5('42:' || id), id LIMIT 20",
    "sel_stratified": f"WITH {B.POOL}, k AS (SELECT id, content_domain, md5('42:' || id) AS k, row_number() OVER (PARTITION BY content_domain ORDER BY md5('42:' || id), id) AS n FROM pool) SELECT id, content_domain FROM k ORDER BY CAST(n > 3 AS INT), k, id LIMIT 20",
    "sel_max_info": f"WITH {B.POOL}, p AS (SELECT id, discrimination AS a, {_P.format(t='0.25::DOUBLE')} AS p FROM pool), b AS (SELECT id FROM p ORDER BY a * a * p * (1 - p) DESC, id LIMIT 20) SELECT id FROM b ORDER BY md5('42:' || id), id LIMIT 5",
    "sel_exposure": f"WITH {B.POOL} SELECT 'max' AS rule, count(*) AS n FROM pool WHERE exposure_count < 3 UNION ALL SELECT 'conditional', count(*) FROM pool WHERE exposure_count < 3 OR {duck_uniform(chr(39) + '42:exposure:' + chr(39) + ' || id')} < 0.25",
    "sched_generate": f"{_SCHED} SELECT run, item, perturbed, CASE WHEN perturbed THEN f ELSE -1 END AS family FROM s",
    "sched_coverage": f"{_SCHED} SELECT item, round(avg(CAST(perturbed AS DOUBLE)), 6) AS coverage FROM s GROUP BY 1",
    "pool_ops": f"WITH {B.POOL} SELECT 'repeated_ids' AS finding, count(*) AS n FROM pool WHERE id % 2 = 0",
    "pool_record_exposure": f"WITH {B.POOL} SELECT id, exposure_count + (SELECT count(*) FROM lineitem WHERE l_partkey = id) AS exposure_count FROM pool",
    "cal_schema": f"WITH {B.POOL} SELECT 'discrimination' AS finding, count(*) AS n FROM pool WHERE discrimination - 0.6::DOUBLE <= 0",
    "aud_emit": "SELECT doc_id, CASE WHEN octet_length(encode(string_split(text, chr(10))[-1])) > 256 THEN 'tag_too_long' ELSE 'ok' END AS status, CASE WHEN octet_length(encode(text)) > 4096 THEN sha256(text) ELSE '' END AS blob FROM documents",
    "aud_verify": "SELECT * FROM (VALUES (17, 'entry_hash'), (40, 'seq_gap'), (41, 'seq_gap'), (61, 'parent_mismatch'), (61, 'seq_gap')) v(idx, finding)",
    "aud_replay": "SELECT max(event_id) - 1 AS idx, 'truncated' AS status FROM events",
    "blob_store": "SELECT DISTINCT sha256(text) AS sha, octet_length(encode(text)) AS bytes FROM documents",
    "blob_gc": "SELECT DISTINCT sha256(text) AS sha, octet_length(encode(text)) AS bytes FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')",
    "pert_atoms": f"SELECT doc_id, {_pick(perturb.SEPARATORS, 'separator')} AS separator, {_pick(perturb.CASINGS, 'casing')} AS casing, {_pick(perturb.PUNCTUATION, 'punctuation')} AS punctuation, {_pick(perturb.PADDING, 'padding')} AS padding FROM documents",
    "pert_paraphrase": f"SELECT doc_id, {_pick(perturb.TIERS, 'tier')} AS tier, {_pick(perturb.STRENGTHS, 'strength')} AS strength, true AS confound FROM documents",
    "pert_region": "SELECT item_id, 'Question: ' || replace(text, chr(10), ' ') || '?' AS region FROM benchmark",
    "src_jsonl": """WITH e AS (SELECT event_type, event_id % 100 AS k, CASE WHEN value > 100 THEN 1.5::DOUBLE ELSE floor(value) / 100 END AS s FROM events)
 SELECT CASE k WHEN 7 THEN 'bad_json' WHEN 8 THEN 'missing_agent' WHEN 9 THEN 'bad_outcome' ELSE 'none' END AS warning, CASE WHEN k IN (7, 8, 9) THEN '' ELSE event_type END AS task_id, count(*) AS n, round(sum(CASE WHEN k IN (7, 8, 9) THEN 0 ELSE s END), 4) AS total FROM e GROUP BY 1, 2""",
    "outcome_to_f64": """WITH e AS (SELECT event_type, CASE WHEN value > 100 THEN 1.5::DOUBLE ELSE floor(value) / 100 END AS s FROM events WHERE event_id % 100 NOT IN (7, 8, 9))
 SELECT event_type AS task_id, round(sum(s), 4) AS value, CAST(sum(CAST(trunc(s * 1000) AS BIGINT)) AS BIGINT) AS ordinal FROM e GROUP BY 1""",
    "src_inspect": """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT 'match' AS scorer, CASE conv_id % 4 WHEN 0 THEN 'Binary' WHEN 1 THEN 'Binary' WHEN 2 THEN 'Score' ELSE 'none' END AS type FROM c UNION ALL SELECT 'size', CASE WHEN n <= 1 THEN 'Binary' ELSE 'Graded' END FROM c)
 SELECT scorer, type, CASE WHEN type = 'none' THEN 'bad_score' ELSE 'none' END AS warning, count(*) AS n FROM s GROUP BY 1, 2, 3""",
    "to_irt": f"WITH {B.TRIALS}, l AS (SELECT run_id, task_id, agent_id, arg_max(CAST(passed AS INT), ord) AS y FROM trials GROUP BY 1, 2, 3) SELECT run_id AS subject_id, count(*) AS items, CAST(sum(y) AS BIGINT) AS right FROM l GROUP BY 1",
    "extract_cells": "WITH g AS (SELECT user_id % 25 AS k, avg(CAST(value > 35 AS DOUBLE)) AS a, count(*) AS n FROM events GROUP BY 1) SELECT 'c' || lpad(CAST(i AS VARCHAR), 5, '0') AS cell_id, round(coalesce(a, -1), 6) AS accuracy, coalesce(n, 0) AS n_samples FROM range(30) t(i) LEFT JOIN g ON g.k = i",
}
