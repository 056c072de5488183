"""A folder of evaluation cases: read, check, and compile to one JSONL file with a manifest.

The folder holds references.yaml, tags_vocabulary.yaml, manifest.yaml and <discipline>/cases/*.yaml.
Cases are read, checked and rewritten by the executors; only the three configuration files and what
is wrong with the cases' structure come to the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.folders import one_file, write_text
from lexidim.plans.engine import PROMPTS, Engine, activation_prompt
from lexidim.sources import cases as cs
from lexidim.sources.config import read_yaml

# The fields of a case file and what some of them may be.
CASE_FILE = """
schema_version STRING, id STRING, title STRING,
metadata STRUCT<discipline_folder: STRING, language: STRING, has_figure: BOOLEAN, has_table: BOOLEAN, n_subgrandezas: INT>,
reference STRUCT<source_id: STRING, chapter: STRING, section: STRING, page_range: STRING, notes: STRING>,
tags ARRAY<STRING>, assets ARRAY<STRUCT<id: STRING, type: STRING, path: STRING, description: STRING, embed_inline: BOOLEAN>>,
prompt_baseline STRING, expected_signals ARRAY<STRING>, expected_norms ARRAY<STRUCT<source_id: STRING, clauses: ARRAY<STRING>>>,
gabarito ARRAY<STRUCT<name: STRING, value: DOUBLE, unit: STRING, tolerance_relative: DOUBLE, formula: STRING, inputs: MAP<STRING, STRING>, notes: STRING, symbolic_form: STRING>>,
memoria_calculo MAP<STRING, STRING>, review_status STRING, review_notes STRING, created STRING, author STRING
"""
FIELDS = ("schema_version", "id", "title", "metadata", "reference", "tags", "assets", "prompt_baseline", "expected_signals", "expected_norms", "gabarito", "memoria_calculo", "review_status", "review_notes", "created", "author")
ASSET_TYPES, STATUSES, LANGUAGES = ("svg", "pdf", "png", "table_csv", "table_md"), ("draft", "reviewed", "validated"), ("pt-br", "en")
REFERENCE_TYPES = ("book", "article", "standard", "thesis", "report", "notes")
LEAST_PROMPT, MOST_TOLERANCE = 20, 0.5


def _one_yaml(spark: SparkSession, path: str, required: tuple[str, ...]) -> dict:
    import yaml

    (row,) = spark.read.text(path, wholetext=True).collect()  # one configuration file
    data = yaml.safe_load(row.value)
    if not isinstance(data, dict) or any(not data.get(f) for f in required):
        raise ValueError(f"{path}: {', '.join(required)} are needed")
    return data


def load_references(spark: SparkSession, folder: str) -> list[str]:
    """The ids of the references, each once."""
    sources = _one_yaml(spark, f"{folder}/references.yaml", ("schema_version", "sources"))["sources"]
    ids = [s["id"] for s in sources]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"references twice: {twice}")
    if bad := sorted(s["id"] for s in sources if s.get("type") not in REFERENCE_TYPES or len(s.get("full_citation") or "") < 10 or not s.get("short_citation")):
        raise ValueError(f"references without a known type or citations: {bad}")
    return ids


def load_vocabulary(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """High-risk tags of all categories, and contextual tags."""
    data = _one_yaml(spark, f"{folder}/tags_vocabulary.yaml", ("schema_version", "high_risk_tags"))
    return sorted({t for tags in data["high_risk_tags"].values() for t in tags}), sorted(set(data.get("contextual_tags") or ()))


def load_manifest(spark: SparkSession, folder: str) -> dict:
    data = _one_yaml(spark, f"{folder}/manifest.yaml", ("schema_version", "benchmark_version", "name", "description", "created"))
    data.setdefault("primary_language", "pt-br")
    if data["primary_language"] not in LANGUAGES:
        raise ValueError(f"unknown language {data['primary_language']!r}")
    return data


def structural_errors() -> Column:
    """ARRAY of what keeps a file from being a case."""
    none = F.array().cast("array<string>")
    missing = [F.when(F.col(f).isNull() | (F.length(f) == 0), F.lit(f"{f} is missing")) for f in ("schema_version", "id", "title", "prompt_baseline", "metadata.discipline_folder", "reference.source_id")]
    is_in = lambda c, known: F.coalesce(c.isin(*known), F.lit(True))
    wrong_answer = lambda g: g["name"].isNull() | g["value"].isNull() | g["unit"].isNull() | g["tolerance_relative"].isNull() | ~F.coalesce(g["tolerance_relative"].between(0, MOST_TOLERANCE), F.lit(False))
    wrong_asset = lambda a: a["id"].isNull() | a["path"].isNull() | a["description"].isNull() | ~F.coalesce(a["type"].isin(*ASSET_TYPES), F.lit(False))
    unknown = F.array_except(F.json_object_keys("_json"), F.array(*map(F.lit, FIELDS)))
    found = [
        *missing,
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields "), F.array_join(F.array_sort(unknown), ","))),
        F.when(~F.col("id").rlike(r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), F.lit("malformed id")),
        F.when(~F.col("metadata.discipline_folder").rlike("^[a-z][a-z0-9_]*$"), F.lit("malformed discipline")),
        F.when(~F.startswith("id", F.concat("metadata.discipline_folder", F.lit("-"))), F.lit("id without its discipline")),
        F.when(F.length("prompt_baseline") < LEAST_PROMPT, F.lit("prompt too short")),
        F.when(F.coalesce(F.size("tags"), F.lit(0)) < 1, F.lit("no tags")),
        F.when(F.size(F.array_distinct("tags")) < F.size("tags"), F.lit("tag twice")),
        F.when(F.coalesce(F.size("gabarito"), F.lit(0)) < 1, F.lit("no answers")),
        F.when(F.exists("gabarito", wrong_answer), F.lit("malformed answer")),
        F.when(F.exists("assets", wrong_asset), F.lit("malformed asset")),
        F.when(F.col("metadata.n_subgrandezas") != F.size("gabarito"), F.lit("wrong number of answers")),
        F.when(~is_in(F.col("metadata.language"), LANGUAGES), F.lit("unknown language")),
        F.when(~is_in(F.col("review_status"), STATUSES), F.lit("unknown review status")),
    ]
    return F.filter(F.coalesce(F.array(*found), none), lambda x: x.isNotNull())


def load_cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The cases of <discipline>/cases/*.yaml with `file`, and (file, error) of files that are none."""
    rows, unread = read_yaml(spark, f"{folder}/*/cases/*.yaml", CASE_FILE, with_json=True)
    judged = rows.withColumn("_wrong", structural_errors())
    wrong = judged.where(F.size("_wrong") > 0).select("file", F.array_join("_wrong", "; ").alias("error"))
    defaults = {
        "review_status": F.coalesce("review_status", F.lit("draft")),
        "metadata": F.col("metadata").withField("language", F.coalesce("metadata.language", F.lit("pt-br"))).withField("has_figure", F.coalesce("metadata.has_figure", F.lit(False))).withField("has_table", F.coalesce("metadata.has_table", F.lit(False))),
    }
    return judged.where(F.size("_wrong") == 0).drop("_wrong", "_json").withColumns(defaults), wrong.unionByName(unread)


def flat(cases: DataFrame) -> DataFrame:
    """cases with the columns that cases.validated() reads beside their own."""
    return cases.withColumns({
        "discipline": F.col("metadata.discipline_folder"), "language": F.col("metadata.language"), "source_id": F.col("reference.source_id"), "prompt": F.col("prompt_baseline"),
        "norms": F.transform("expected_norms", lambda n: n["source_id"]), "answers": F.col("gabarito"), "n_answers": F.col("metadata.n_subgrandezas"), "has_figure": F.col("metadata.has_figure"),
    })


def embedded(spark: SparkSession, cases: DataFrame, folder: str) -> DataFrame:
    """cases with `prompt` followed by the bodies of their inline assets, in the order they are
    listed, without XML headers. Paths start at the case's own folder. A missing asset fails."""
    asset = F.posexplode(F.filter("assets", lambda a: F.coalesce(a["embed_inline"], F.lit(False)))).alias("nth", "a")
    place = F.concat("metadata.discipline_folder", F.lit("/cases/"), "a.path")
    wanted = cases.select("file", "metadata", asset).select("file", "nth", place.alias("path"))
    for _ in range(4):  # a folder and .. after it cancel
        wanted = wanted.withColumn("path", F.regexp_replace("path", r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./|(?:^|(?<=/))\./", ""))
    if wanted.isEmpty():
        return cases
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    own = F.substring_index(F.col("_metadata.file_path"), f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    bodies = files.select(own.alias("path"), F.ltrim(F.regexp_replace("value", r"^\s*<\?xml[^>]*\?>", ""), F.lit(" \t\r\n")).alias("body"))
    found = wanted.join(bodies, "path", "left")
    lost = [r.path for r in found.where("body IS NULL").select("path").limit(20).collect()]
    if lost:
        raise FileNotFoundError(f"assets not found: {lost}")
    joined = found.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "body"))), lambda b: F.concat(F.lit("\n\n"), b["body"])), "").alias("_more"))
    return cases.join(joined, "file", "left").withColumn("prompt", F.concat("prompt", F.coalesce("_more", F.lit("")))).drop("_more")


def case_lines(checked: DataFrame, engine: Engine, require_validated: bool = True) -> DataFrame:
    """file, tags and line: the cases without errors, and if so required validated, as JSON with four
    arms (baseline, modo_b, modo_b_activated, modo_d_activated) and the messages of the last two."""
    ready = (F.size("errors") == 0) & ((F.col("review_status") == "validated") | F.lit(not require_validated))
    known = {**PROMPTS, **(engine.prompts or {})}
    told = reduce(lambda rest, k: F.when(F.col("language") == k, F.lit(activation_prompt(k, engine.prompts).rstrip())).otherwise(rest), known, F.lit(activation_prompt("pt-br", engine.prompts).rstrip()))
    made = engine.preprocess(checked.where(ready).withColumn("_told", told), "prompt", into="_marked")
    after = lambda content: F.concat("_told", F.lit("\n\n"), content)
    said = lambda content: F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")) for role, c in (("system", "_told"), ("user", content))))
    empty = F.array().cast("array<string>")
    line = F.struct(
        "id", "title", "metadata", "reference", "tags", F.coalesce("expected_signals", empty).alias("expected_signals"), F.coalesce("memoria_calculo", F.create_map().cast("map<string,string>")).alias("memoria_calculo"),
        F.coalesce("expected_norms", F.array().cast("array<struct<source_id: string, clauses: array<string>>>")).alias("expected_norms"), "gabarito",
        F.struct(F.col("prompt").alias("baseline"), F.col("_marked").alias("modo_b"), after("_marked").alias("modo_b_activated"), after("prompt").alias("modo_d_activated")).alias("prompts"),
        F.struct(said("_marked").alias("modo_b_activated"), said("prompt").alias("modo_d_activated")).alias("messages_for_api"),
    )
    return made.select("file", "tags", F.to_json(line, {"ignoreNullFields": "false"}).alias("line"))


@dataclass(frozen=True)
class Compiled:
    """Where the lines and the manifest are, what the manifest says, and the checked cases."""

    lines_path: str
    manifest_path: str
    manifest: dict
    checked: DataFrame


def compile_all(spark: SparkSession, folder: str, output: str | None = None, require_validated: bool = True, engine: Engine | None = None) -> Compiled:
    """Compile a folder: cases_v<version>.jsonl, a case a line in the order of the files, each line
    ended, and its manifest with counts, cases by tag and the SHA-256 of the file's bytes. A file
    that is no case fails all. One benchmark's cases make one file, so one task writes it."""
    output = output or f"{folder}/generated"
    about, references, (risky, contextual) = load_manifest(spark, folder), load_references(spark, folder), load_vocabulary(spark, folder)
    cases, wrong = load_cases(spark, folder)
    if bad := wrong.orderBy("file").limit(100).collect():
        raise ValueError("files that are no cases:\n" + "\n".join(f"  {r.file}: {r.error}" for r in bad))
    checked = cs.validated(flat(cases), references, risky, contextual)
    lines = case_lines(embedded(spark, checked, folder), engine or Engine(), require_validated)
    path = f"{output}/cases_v{about['benchmark_version']}.jsonl"
    lines.orderBy("file").coalesce(1).select("line").write.mode("overwrite").text(f"{output}/.lines")
    one_file(spark, f"{output}/.lines", path)
    mark = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()  # none of an empty file
    tags = {r.tag: r.n for r in cs.tag_histogram(lines).collect()}  # of one benchmark's vocabulary
    total, n = checked.count(), lines.count()
    manifest = {
        "benchmark_version": about["benchmark_version"], "name": about["name"], "description": about["description"], "primary_language": about["primary_language"],
        "n_cases_total": total, "n_cases_compiled": n, "n_cases_rejected": total - n, "tags_stratification": dict(sorted(tags.items())),
        "jsonl_file": path.rsplit("/", 1)[-1], "jsonl_sha256": mark[0][0] if mark else hashlib.sha256(b"").hexdigest(), "schema_version": about["schema_version"],
    }
    manifest_path = path.removesuffix(".jsonl") + "_manifest.json"
    write_text(spark, manifest_path, json.dumps(manifest, ensure_ascii=False, indent=2) + "\n")
    return Compiled(path, manifest_path, manifest, checked)
