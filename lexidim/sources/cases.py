"""Evaluation cases: read, validate and compile to JSON lines with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexidim.plans.engine import PROMPTS, Engine, activation_prompt

CASE = """
id STRING, title STRING, discipline STRING, language STRING, source_id STRING, tags ARRAY<STRING>, prompt STRING,
norms ARRAY<STRING>, assets ARRAY<STRUCT<path: STRING, inline: BOOLEAN, type: STRING>>,
answers ARRAY<STRUCT<name: STRING, value: DOUBLE, unit: STRING, tolerance: DOUBLE>>, n_answers INT, review_status STRING,
has_figure BOOLEAN
"""
LEAST_ANSWERS = 4
FIGURES = ("svg", "png")
NOT_VALIDATED = "not validated"


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed cases, and the lines that aren't, with the file they stand in."""
    rows = spark.read.schema(CASE + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path).select("*", F.col("_metadata.file_path").alias("file"))
    bad = F.col("_corrupt").isNotNull() | F.col("id").isNull()
    return rows.where(~bad).drop("_corrupt"), rows.where(bad).select("file", "_corrupt")


def problems(references: list[str], high_risk: list[str], contextual: list[str]) -> Column:
    """ARRAY of what is wrong with a case."""
    known = F.array(*map(F.lit, [*high_risk, *contextual]))
    tags, empty = F.coalesce("tags", F.array().cast("array<string>")), F.array().cast("array<string>")
    unknown = F.array_sort(F.array_except(tags, known))
    lost = F.array_sort(F.array_except(F.coalesce("norms", empty), F.array(*map(F.lit, references))))
    found = [
        F.when(F.coalesce(F.size("answers"), F.lit(0)) < LEAST_ANSWERS, F.lit(f"fewer than {LEAST_ANSWERS} answers")),
        F.when(~F.arrays_overlap(tags, F.array(*map(F.lit, high_risk))), F.lit("no high-risk tag")),
        F.when(~F.coalesce(F.col("source_id").isin(*references), F.lit(False)), F.concat(F.lit("unknown reference "), F.coalesce("source_id", F.lit("none")))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown tags "), F.array_join(unknown, ","))),
        F.when(F.size(lost) > 0, F.concat(F.lit("unknown norms "), F.array_join(lost, ","))),
        F.when(~F.startswith("id", F.concat("discipline", F.lit("-"))), F.lit("id without its discipline")),
        F.when(F.size(F.array_distinct(tags)) < F.size(tags), F.lit("tag twice")),
        F.when(F.col("n_answers") != F.size("answers"), F.lit("wrong number of answers")),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def validated(cases: DataFrame, references: list[str], high_risk: list[str], contextual: list[str]) -> DataFrame:
    """cases with errors and warnings; the second and later cases of an id are errors, in the order
    of their files if they have any, then of title and prompt."""
    again = F.row_number().over(Window.partitionBy("id").orderBy(*(["file"] if "file" in cases.columns else []), "title", "prompt")) > 1
    errors = F.concat(problems(references, high_risk, contextual), F.when(again, F.array(F.lit("id twice"))).otherwise(F.array().cast("array<string>")))
    drawn = F.coalesce(F.exists("assets", lambda a: F.coalesce(a["type"].isin(*FIGURES), F.lit(False))), F.lit(False))
    warnings = [
        F.when(F.coalesce("review_status", F.lit("")) != "validated", F.lit(NOT_VALIDATED)),
        F.when(F.coalesce("has_figure", F.lit(False)) & ~drawn, F.lit("figure without svg or png asset")),
    ]
    return cases.withColumns({"errors": errors, "warnings": F.filter(F.array(*warnings), lambda x: x.isNotNull())})


def strict(checked: DataFrame) -> DataFrame:
    """checked, but a case with errors fails the query."""
    failed = F.raise_error(F.concat(F.lit("case "), F.coalesce("id", F.lit("?")), F.lit(" is invalid: "), F.array_join("errors", "; "))).cast("string")
    return checked.withColumn("id", F.when(F.size("errors") > 0, failed).otherwise(F.col("id")))


def report_lines(checked: DataFrame) -> DataFrame:
    """(id, nth, line) of the report: counts first (id null), then of each invalid case its id, errors
    and warnings."""
    counts = report(checked).select(F.lit(None).cast("string").alias("id"), F.posexplode(F.array(
        F.concat(F.lit("Total: "), "n_cases", F.lit(" casos")), F.concat(F.lit("  Válidos: "), "n_valid"), F.concat(F.lit("  Inválidos: "), "n_invalid")
    )).alias("nth", "line"))
    marked = lambda kind: F.transform(F.col(f"{kind}s"), lambda x: F.concat(F.lit(f"    {'ERR' if kind == 'error' else 'WARN'}: "), x))
    of_case = F.concat(F.array(F.concat(F.lit("  ["), "id", F.lit("]"))), marked("error"), marked("warning"))
    return counts.unionByName(checked.where(F.size("errors") > 0).select("id", F.posexplode(of_case).alias("nth", "line")))


def report_text(checked: DataFrame) -> str:
    """The report as one text, for a person to read."""
    lines = report_lines(checked).orderBy(F.col("id").asc_nulls_first(), "nth").collect()
    head, rest = [r.line for r in lines if r.id is None], [r.line for r in lines if r.id is not None]
    return "\n".join(head + (["", "Casos com erro:", *rest] if rest else []))


def report(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("n_cases"), F.count_if(F.size("errors") == 0).alias("n_valid"), F.count_if(F.size("errors") > 0).alias("n_invalid"))


def tag_histogram(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def embedded(cases: DataFrame, assets: DataFrame) -> DataFrame:
    """cases whose prompt is followed by the bodies of their inline assets (path, body), without
    XML headers, in the order of the paths."""
    wanted = cases.select("id", F.explode("assets").alias("a")).where("a.inline").select("id", F.col("a.path").alias("path"))
    bodies = wanted.join(assets, "path").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", F.regexp_replace("body", r"^\s*<\?xml[^>]*\?>\s*", "").alias("body")))).alias("_bodies"))
    joined = F.array_join(F.transform("_bodies", lambda b: b["body"]), "\n\n")
    return cases.join(bodies, "id", "left").withColumn("prompt", F.when(F.col("_bodies").isNull(), F.col("prompt")).otherwise(F.concat("prompt", F.lit("\n\n"), joined))).drop("_bodies")


def compiled(checked: DataFrame, engine: Engine, language: str = "pt-br", require_validated: bool = True) -> DataFrame:
    """id and line: valid cases as JSON with their metadata and four arms: the plain prompt, the marked
    one, and instructions before the marked (prompted) and before the plain one (control); the last two
    also as messages. Instructions are in the case's language if there are any, else in `language`."""
    ready = F.size("errors") == 0
    if require_validated:
        ready &= ~F.array_contains("warnings", NOT_VALIDATED)  # the other warning holds no case back
    plain = F.col("prompt_text" if "prompt_text" in checked.columns else "prompt")
    told = F.lit(activation_prompt(language, engine.prompts).rstrip())
    for known in {**PROMPTS, **(engine.prompts or {})}:
        told = F.when(F.col("language") == known, F.lit(activation_prompt(known, engine.prompts).rstrip())).otherwise(told)
    made = engine.preprocess(checked.where(ready).withColumns({"_plain": plain, "_told": told}), "_plain")
    usable = F.col("preprocessed") != ""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))
    prompted = lambda content: F.when(usable, F.concat("_told", F.lit("\n\n"), content))
    messages = lambda content: F.when(usable, F.array(message("system", "_told"), message("user", content)))
    arms = F.struct(
        F.col("_plain").alias("plain"), F.col("preprocessed").alias("marked"), prompted("preprocessed").alias("prompted"), prompted("_plain").alias("control"),
        messages("preprocessed").alias("messages"), messages("_plain").alias("control_messages"),
    )
    line = F.struct("id", "title", "discipline", "language", "source_id", "tags", "norms", "answers", "n_answers", "review_status", "has_figure", arms.alias("arms"))
    return made.select("id", F.to_json(line, {"ignoreNullFields": "false"}).alias("line"))


def manifest(lines: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: counts, the checksum of the lines' own checksums in the order of their ids, so that
    no line is gathered whole, and the number of compiled cases by tag."""
    marks = F.array_sort(F.collect_list(F.struct("id", F.sha2("line", 256).alias("mark"))))
    total = lines.agg(F.count("*").alias("n_compiled"), F.sha2(F.array_join(F.transform(marks, lambda m: m["mark"]), "\n"), 256).alias("checksum"))
    tags = lines.select(F.from_json(F.get_json_object("line", "$.tags"), "ARRAY<STRING>").alias("tags"))
    by_tag = tag_histogram(tags).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tags"))
    return total.crossJoin(report(checked)).crossJoin(by_tag)  # one row by one row


def write_lines(lines: DataFrame, path: str) -> None:
    lines.sort("id").select("line").write.mode("overwrite").text(path)
