"""Readers of evaluation logs into trial rows, with warnings beside them, and writers.

Both readers work on a frame of texts, so any Spark source can feed them. A row that cannot be mapped becomes a
warning, never a failure of the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words that mean pass and fail, and the earliest time accepted (2020-01-01) and the slack for clocks.
PASS, FAIL = ("true", "pass", "correct", "1", "c"), ("false", "fail", "incorrect", "0", "i")
EARLIEST, SLACK = 1577836800, 86400

OUTCOME = "struct<type:string,b:boolean,score:double,graded:smallint,criteria:map<string,double>>"


def _outcome(kind, b=None, score=None, graded=None, criteria=None) -> Column:
    null = lambda c, t: (c if c is not None else F.lit(None)).cast(t)
    return F.struct(
        F.lit(kind).alias("type"), null(b, "boolean").alias("b"), null(score, "double").alias("score"), null(graded, "smallint").alias("graded"),
        null(criteria, "map<string,double>").alias("criteria"),
    )


@dataclass(frozen=True)
class Mapping:
    """Dotted paths of the fields. mode: auto, binary, score, graded or multi (criteria: name to path)."""

    task: str = "task_id"
    agent: str = "agent_id"
    run: str = "run_id"
    ts: str = "timestamp"
    outcome: str = "score"
    mode: str = "auto"
    criteria: tuple[tuple[str, str], ...] = ()
    wrap_grades: bool = False


def ulid(*parts: Column) -> Column:
    """32 hex digits of a hash of the parts."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32)


def _json_kind(raw: Column) -> Column:
    """The JSON type of a value's text as get_json_object cannot tell it: string, bool, number, object, array."""
    return F.schema_of_variant(F.try_parse_json(raw))


def _at(path: str) -> str:
    return "$." + path


def _typed(line: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(line), _at(path), kind)


def _raw_kind(line: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), _at(path), "variant"))


def map_outcome(line: Column, m: Mapping) -> Column:
    """The outcome of a JSON line, or null if it cannot be mapped."""
    kind, text, number, boolean = _raw_kind(line, m.outcome), F.get_json_object(line, _at(m.outcome)), _typed(line, m.outcome, "double"), _typed(line, m.outcome, "boolean")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    word = F.lower(text)
    binary = F.when(kind == "BOOLEAN", boolean).when(numeric, number != 0).when((kind == "STRING") & word.isin(*PASS), True).when((kind == "STRING") & word.isin(*FAIL), False)
    as_binary = F.when(binary.isNotNull(), _outcome("Binary", b=binary))
    as_score = F.when(numeric & finite, _outcome("Score", score=number))
    if m.mode == "binary":
        return as_binary
    if m.mode == "score":
        return as_score
    if m.mode == "graded":
        whole = _typed(line, m.outcome, "bigint")
        grade = whole % 256 if m.wrap_grades else F.when(whole <= 255, whole)
        return F.when((kind == "BIGINT") & (whole >= 0) & grade.isNotNull(), _outcome("Graded", graded=grade))
    if m.mode == "multi":
        values = [_typed(line, p, "double") for _, p in m.criteria]
        criteria = F.create_map(*[x for (n, _), v in zip(m.criteria, values) for x in (F.lit(n), v)])
        fine = F.lit(True)
        for v in values:
            fine = fine & v.isNotNull()
        return F.when(fine, _outcome("MultiCriterion", criteria=criteria))
    return F.when(kind == "BOOLEAN", as_binary).when(numeric, as_score).when(kind == "STRING", as_binary)


def from_jsonl(lines: DataFrame, m: Mapping = Mapping(), now: int | None = None, run_default: str = "run") -> DataFrame:
    """Trials and warnings from (ord, line); blank lines are left out. Rows with a warning have it in ``warning``.

    ord is the line number; it goes into the trial's id.
    """
    line = F.col("line")
    rows = lines.where("line IS NOT NULL AND trim(line) != ''").withColumn("_ok", F.try_parse_json(line).isNotNull())
    task, agent, run = (F.get_json_object(line, _at(p)) for p in (m.task, m.agent, m.run))
    ts = F.coalesce(_typed(line, m.ts, "bigint"), F.lit(now).cast("bigint") if now is not None else F.unix_timestamp())
    run_id = ulid(F.coalesce(run, F.lit(run_default)))
    rows = rows.withColumn("task_id", task).withColumn("agent_id", agent).withColumn("run_id", run_id).withColumn("ts", ts).withColumn("outcome", map_outcome(line, m))
    rows = rows.withColumn("trial_id", ulid("run_id", "task_id", "agent_id", F.col("ord").cast("string")))
    warning = F.when(~F.col("_ok"), "bad_json").when(F.col("task_id").isNull(), "missing_task").when(F.col("agent_id").isNull(), "missing_agent").when(F.col("outcome").isNull(), "bad_outcome")
    rows = rows.withColumn("warning", F.coalesce(warning, validation(now)))
    return rows.select("ord", "trial_id", "run_id", "task_id", "agent_id", "ts", "outcome", F.col("line").alias("metadata"), "warning")


def validation(now: int | None) -> Column:
    """Why a row (task_id, agent_id, ts, outcome) is refused; the first that holds, or null."""
    clock = F.lit(now).cast("bigint") if now is not None else F.unix_timestamp()
    score, odd = F.col("outcome.score"), lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        F.when(F.col("task_id") == "", "empty_task").when(F.col("agent_id") == "", "empty_agent").when(F.col("ts") < EARLIEST, "too_old").when(F.col("ts") > clock + SLACK, "in_future")
        .when(odd(score), "not_finite").when(F.exists(F.map_values("outcome.criteria"), odd), "criterion_not_finite")
    )


def score_value(raw: Column) -> Column:
    """The outcome of a score's JSON text in an evaluation log: letters are case-sensitive, and other strings are errors (null)."""
    kind, text = _json_kind(raw), F.try_variant_get(F.try_parse_json(raw), "$", "string")
    whole, real = F.try_variant_get(F.try_parse_json(raw), "$", "bigint"), F.try_variant_get(F.try_parse_json(raw), "$", "double")
    return (
        F.when(kind == "BOOLEAN", _outcome("Binary", b=F.try_variant_get(F.try_parse_json(raw), "$", "boolean")))
        .when((kind == "STRING") & (text == "C"), _outcome("Binary", b=F.lit(True))).when((kind == "STRING") & text.isin("I", "N"), _outcome("Binary", b=F.lit(False)))
        .when((kind == "STRING") & (text == "P"), _outcome("Score", score=F.lit(0.5))).when((kind == "BIGINT") & whole.isin(0, 1), _outcome("Binary", b=whole == 1))
        .when((kind == "BIGINT") & whole.between(2, 255), _outcome("Graded", graded=whole)).when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), _outcome("Score", score=real))
        .when(kind.startswith("OBJECT"), _outcome("MultiCriterion", criteria=F.from_json(raw, "map<string,double>")))
    )


def from_eval_logs(docs: DataFrame, now: int | None = None) -> DataFrame:
    """Trials and warnings from evaluation logs, one JSON document a row (path, content): one row a sample and scorer.

    Samples without scores are left out; a score that cannot be read is a warning, and so is what validation refuses, such as
    a missing time. metadata: that of the log, over it the evaluation's, the sample's, and scorer_name, epoch, sample_id; JSON texts.
    """
    over = lambda low, high: F.map_zip_with(low, high, lambda _, a, b: F.coalesce(b, a))
    held = lambda text, path: F.coalesce(F.from_json(F.get_json_object(text, path), "map<string,string>"), F.create_map().cast("map<string,string>"))
    c = F.col("content")
    sample = F.from_json(F.get_json_object(c, "$.samples"), "array<string>")
    scores = F.from_json(F.get_json_object("sample", "$.scores"), "map<string,string>")
    d = docs.select(
        "path", F.coalesce(F.get_json_object(c, "$.eval.run_id"), F.sha2("content", 256)).alias("run"), F.coalesce(F.get_json_object(c, "$.eval.task_id"), F.get_json_object(c, "$.eval.task"), F.lit("")).alias("task_id"),
        F.get_json_object(c, "$.eval.model").alias("agent_id"), over(held(c, "$.metadata"), held(c, "$.eval.metadata")).alias("meta"), sample.alias("samples"),
    )
    # what a document says is read before its samples are laid out: behind that it would be read again for each of them
    d = d.select("path", "run", "task_id", "agent_id", "meta", F.posexplode("samples").alias("n", "sample"))
    entries = F.array_sort(F.map_entries(scores))
    d = d.select("*", F.posexplode(entries).alias("k", "e")).withColumn("scorer", F.col("e.key")).withColumn("score", F.col("e.value"))
    uuid, sid, epoch = F.get_json_object("sample", "$.uuid"), F.get_json_object("sample", "$.id"), F.coalesce(F.get_json_object("sample", "$.epoch"), F.lit("1"))
    raw = F.to_json(F.try_variant_get(F.try_parse_json("score"), "$.value", "variant"))
    first_user = F.get_json_object(F.filter(F.from_json(F.get_json_object("sample", "$.messages"), "array<string>"), lambda m: F.get_json_object(m, "$.role") == "user")[0], "$.content")
    assistant = F.filter(F.from_json(F.get_json_object("sample", "$.messages"), "array<string>"), lambda m: F.get_json_object(m, "$.role") == "assistant")
    graded_by = F.get_json_object("score", "$.metadata.grading.model")
    model = F.coalesce(graded_by, F.get_json_object(F.try_element_at(assistant, F.lit(-1)), "$.content"))
    ts = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.get_json_object("sample", "$.completed_at"))), F.lit(0).cast("bigint"))
    out = d.withColumn("run_id", ulid("run")).withColumn("outcome", score_value(raw)).withColumn("ts", ts)
    given = F.create_map(F.lit("scorer_name"), F.col("scorer"), F.lit("epoch"), epoch, F.lit("sample_id"), sid)
    return out.select(
        ulid(F.coalesce(uuid, F.concat_ws("\u0000", "run", sid, epoch)), F.col("scorer")).alias("trial_id"), "run_id", "task_id", "agent_id", "ts", "scorer", sid.alias("sample_id"), epoch.cast("int").alias("epoch"), "outcome",
        F.struct(model.alias("model"), F.split_part(model, F.lit("/"), F.lit(1)).alias("family"), F.sha2(first_user, 256).alias("prompt_template_hash"), F.when(graded_by.isNotNull(), "grading").otherwise("message").alias("source")).alias("judge"),
        (F.col("n") * 1000 + F.col("k")).cast("long").alias("ord"), over(over(F.col("meta"), held("sample", "$.metadata")), given).alias("metadata"),
        F.when(F.col("outcome").isNull(), "bad_score").otherwise(validation(now)).alias("warning"),
    )


def detect_format(path: str, head: str = "") -> str:
    """jsonl or evallog, by the name's ending, else by the first characters of the content."""
    if path.lower().endswith((".jsonl", ".ndjson")):
        return "jsonl"
    import json

    try:
        doc = json.loads(head)
    except ValueError:
        doc = None
    if isinstance(doc, dict) and ("eval" in doc or "results" in doc):
        return "evallog"
    if all(line.lstrip().startswith("{") for line in head.splitlines() if line.strip()) and head.strip():
        return "jsonl"
    raise ValueError(f"{path}: the format is not known")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a text source; ord is the line's number in its file, from 1.

    A first pass counts the lines of each split, so that large files are still read in parts; one short row a split is ordered.
    """
    at = F.col("_metadata")
    d = spark.read.text(path).select(at["file_path"].alias("_file"), at["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = d.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_file", "_start", (F.coalesce(before, F.lit(0).cast("long")) - F.col("_first") + 1).alias("_shift"))
    return d.join(splits, ["_file", "_start"]).select((F.col("_id") + F.col("_shift")).alias("ord"), "line")


def read(spark: SparkSession, paths: list[str], fmt: str = "auto", mapping: Mapping = Mapping(), now: int | None = None) -> DataFrame:
    """All files as trials with warnings, whatever their format."""
    out = None
    for path in paths:
        kind = fmt
        if kind == "auto":
            first = spark.read.text(path, wholetext=path.lower().endswith(".json")).limit(1).collect()  # a log document may be indented
            kind = detect_format(path, first[0][0] if first else "")
        if kind == "jsonl":
            one = from_jsonl(numbered_lines(spark, path), mapping, now, run_default=path).select("trial_id", "run_id", "task_id", "agent_id", "ts", "outcome", "ord", "warning")
        else:
            docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
            one = from_eval_logs(docs, now).select("trial_id", "run_id", "task_id", "agent_id", "ts", "outcome", "ord", "warning")
        out = one if out is None else out.unionByName(one)
    return out


def outcome_value(outcome: Column) -> Column:
    """An outcome as a number: 1/0, the score, grade / 255, or the mean of criteria (0 without any)."""
    values = F.map_values(outcome["criteria"])
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)
    return F.when(outcome["type"] == "Binary", outcome["b"].cast("double")).when(outcome["type"] == "Score", outcome["score"]).when(outcome["type"] == "Graded", outcome["graded"] / 255.0).when(outcome["type"] == "MultiCriterion", mean)


def outcome_ordinal(outcome: Column) -> Column:
    """An outcome as a label: 0/1, thousandths cut towards zero (not below 0), the grade."""
    value = outcome_value(outcome)
    return F.when(outcome["type"] == "Binary", outcome["b"].cast("bigint")).when(outcome["type"] == "Graded", outcome["graded"].cast("bigint")).otherwise(F.greatest(F.lit(0), (value * 1000).cast("bigint")))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file a partition."""
    df.write.json(path)


def to_irt(trials: DataFrame) -> DataFrame:
    """(subject_id, responses: map of item to 0/1) from binary trials; the last of repeated answers counts."""
    b = trials.where("outcome.type = 'Binary'").select(F.col("run_id").alias("subject_id"), F.coalesce("sample_id", "trial_id").alias("item") if "sample_id" in trials.columns else F.col("trial_id").alias("item"), F.struct("ord", F.col("outcome.b").cast("int").alias("y")).alias("s"))
    last = b.groupBy("subject_id", "item").agg(F.max("s")["y"].alias("y"))
    return last.groupBy("subject_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "y")))).alias("responses"))


def extract_cells(manifest: DataFrame, trials: DataFrame) -> DataFrame:
    """(cell_id, accuracy, n_samples): results joined to every cell of a manifest; cells without results have 0 samples."""
    g = trials.groupBy("cell_id").agg(F.avg(outcome_value(F.col("outcome"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return manifest.join(g, "cell_id", "left").select("cell_id", "accuracy", F.coalesce("n", F.lit(0).cast("long")).alias("n_samples"))


def merge_config(*layers: dict) -> dict:
    """Deep merge of nested settings; later layers win."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
