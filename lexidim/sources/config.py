"""Configuration: the ontology that orders the types, and YAML files of evaluation cases."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.lexicons import TYPES, Lexicons

#: Types of each version; later versions add to earlier ones.
VERSIONS = {"1.0": frozenset(TYPES) - {"NUM", "REF"}, "1.1": frozenset(TYPES) - {"REF"}, "1.2": frozenset(TYPES)}


@dataclass(frozen=True)
class Ontology:
    """Types with the types they are composed of, and their order of precedence."""

    version: str = "1.2"
    compositions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {t: ("QTY",) if t == "CONST" else () for t in TYPES})
    order: tuple[str, ...] = TYPES

    def __post_init__(self):
        known = next((VERSIONS[v] for v in (self.version[:3], "1.2") if v in VERSIONS and self.version.startswith("1.")), None)
        if known is None:
            raise ValueError(f"unknown version {self.version!r}")
        for what, given in (("types", set(self.compositions)), ("order", set(self.order))):
            if given != known:
                raise ValueError(f"{what}: missing {sorted(known - given)}, unknown {sorted(given - known)}")
        if len(set(self.order)) < len(self.order):
            raise ValueError("order names a type twice")
        for name, parts in self.compositions.items():
            if lost := set(parts) - known:
                raise ValueError(f"{name} is composed of unknown types {sorted(lost)}")
        if "QTY" not in self.compositions["CONST"]:
            raise ValueError("a constant must be composed of a quantity")

    @property
    def priority(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.order)}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, k, list(self.compositions[t])) for k, t in enumerate(self.order)], "type STRING, priority INT, composed_of ARRAY<STRING>")


def load_ontology(text: str) -> Ontology:
    """From YAML with version, types (name: {composed_of: [...]}) and order."""
    import yaml

    data = yaml.safe_load(text)
    extra = set(data) - {"version", "types", "order"}
    if extra:
        raise ValueError(f"unknown fields {sorted(extra)}")
    return Ontology(str(data["version"]), {t: tuple((v or {}).get("composed_of", ())) for t, v in data["types"].items()}, tuple(data["order"]))


def _json_file(spark: SparkSession, path: str) -> dict:
    import json

    (row,) = spark.read.text(path, wholetext=True).collect()  # one configuration file
    return json.loads(row.value)


def load_lexicons(spark: SparkSession, constants: str | None = None, operators: str | None = None, connectives: str | None = None, identifiers: str | None = None, expressions: str | None = None, without: tuple[str, ...] = ()) -> Lexicons:
    """Lexicons from JSON files, where a path is given; the own tables else. A pattern that can't be
    read, or an entry without its name, is an error."""
    import regex

    given: dict = {}
    if constants:
        given["constants"] = tuple((e["simbolo"], e["nome"], e["grandeza_associada"], float(e["valor_si"]), bool(e.get("requer_contexto"))) for e in _json_file(spark, constants)["constantes"])
    if operators:
        given["operators"] = tuple((e["simbolo"], int(e["aridade"]), e["categoria"]) for e in _json_file(spark, operators)["operadores"])
    if connectives:
        groups = _json_file(spark, connectives)
        given["connectives"] = tuple((e["forma"].lower(), e["funcao"], lang) for lang in ("pt-br", "en") for e in groups.get(lang, ()) if e.get("forma"))
    if identifiers:
        given["identifiers"] = tuple((e["classe"], e["regex"], None, e.get("canonical_slug")) for e in _json_file(spark, identifiers)["padroes"] if "classe" in e)
    if expressions:
        given["expressions"] = tuple((e["classe"], bool(e.get("atomic_over_protected")), e["regex"]) for e in _json_file(spark, expressions)["classes"])
    for what, at in (("identifiers", 1), ("expressions", 2)):
        for row in given.get(what, ()):
            try:
                regex.compile(row[at], regex.V1)
            except regex.error as e:
                raise ValueError(f"{what}: {row[0]}: {e}") from e
    return Lexicons(**given, without=tuple(without))


def read_yaml(spark: SparkSession, path: str, schema: str, with_json: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of YAML files, one document each, and (file, error) of those that don't parse. Files are
    read and parsed by the executors, sorted by name. with_json keeps each as JSON in `_json`."""
    import json

    def to_json(text):
        import yaml

        try:
            made = yaml.safe_load(text)
            return {"json": json.dumps(made, ensure_ascii=False, default=str), "error": None if isinstance(made, dict) else "no mapping"}
        except yaml.YAMLError as e:
            return {"json": None, "error": str(e)}

    parsed = F.udf(to_json, "STRUCT<json: STRING, error: STRING>", useArrow=True)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), parsed("value").alias("p"))
    rows = files.select("file", "p.error", F.col("p.json").alias("_json"), F.from_json("p.json", schema, {"mode": "PERMISSIVE"}).alias("row"))
    return rows.where("error IS NULL").select("file", "row.*", *(["_json"] if with_json else [])).orderBy("file"), rows.where("error IS NOT NULL").select("file", "error")
