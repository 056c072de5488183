"""The engine: regions, rewritten texts and prompts of a text column, as DataFrame transforms.

A text is scanned in one narrow pass, each distinct text of an Arrow batch once; only the columns
named reach Python, all others pass by. Rows of few files are dealt over the cores before. The same
transforms work on batch and streaming DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidim import lexicons as lx
from lexidim.functions.numbers import NumberError
from lexidim.operators.render import Quantity, quantities, rendered, tag
from lexidim.operators.scan import Patterns, regions, slug_of
from lexidim.operators.stem import stem
from lexidim.sources.config import Ontology
from lexidim.units import UnitError

#: Fields of a region; callers may ask for some only.
REGION = {"type": "STRING", "start": "INT", "end": "INT", "content": "STRING", "slug": "STRING", "ambig_kind": "STRING", "ambig_alternatives": "ARRAY<STRING>", "tag": "STRING", "error": "STRING"}
FIELDS = tuple(REGION)

PROMPTS = {
    "en": (
        "The text below holds marks in square brackets that state what a passage is.\n"
        "- [QTY value=N unit=U dim=[...]] is a physical quantity; dim gives the exponents of kg, m, s, A, K, mol, cd; unc is its uncertainty.\n"
        "- [NUM value=N ...] is a number without a unit, [CONST:s] a universal constant, [IDX:slug] one standard or material, [REF:n] a place in a text, [SYM:e] a symbolic expression.\n"
        "Take marked values, units and names as they are; don't round, split or replace them. Add quantities only if their dim is the same. Where a mark says ambig, ask which alternative is meant.\n"
    ),
    "pt-br": (
        "O texto abaixo contém marcas entre colchetes que dizem o que é cada trecho.\n"
        "- [QTY value=N unit=U dim=[...]] é uma grandeza física; dim traz os expoentes de kg, m, s, A, K, mol, cd; unc é a incerteza.\n"
        "- [NUM value=N ...] é um número sem unidade, [CONST:s] uma constante universal, [IDX:slug] uma norma ou um material, [REF:n] um lugar de um texto, [SYM:e] uma expressão simbólica.\n"
        "Use valores, unidades e nomes marcados como estão; não arredonde, divida nem troque. Só some grandezas de mesmo dim. Onde a marca disser ambig, pergunte qual alternativa vale.\n"
    ),
}


def activation_prompt(language: str = "pt-br", overrides: dict[str, str] | None = None) -> str:
    if language not in PROMPTS and language not in (overrides or {}):
        raise ValueError(f"unknown language {language!r}; there are {sorted(PROMPTS)}")
    return (overrides or {}).get(language, PROMPTS.get(language, "")).rstrip() + "\n"


#: Patterns that a worker has compiled, by their unit symbols and lexicons.
_COMPILED: dict[tuple, Patterns] = {}


def patterns_of(symbols: tuple[str, ...] = (), lexicons: lx.Lexicons = lx.Lexicons()) -> Patterns:
    """Patterns are compiled once a worker, on first use."""
    key = (symbols, lexicons)
    return _COMPILED.get(key) or _COMPILED.setdefault(key, Patterns(symbols or None, lexicons))


#: Where rows are dealt: tasks for each core at least, and bytes of the files read for each task.
_TASKS, _BYTES = 4, 16_000_000


def dealt(df: DataFrame) -> DataFrame:
    """df in a few even partitions for each core and more for large tables, if it is read from fewer
    files than that or is a stream: a row group goes to one task whole, and scanning a row takes far
    longer than moving it."""
    n = _TASKS * _cores(df.sparkSession.sparkContext)
    if df.isStreaming:
        return df.repartition(n)
    return df.repartition(max(n, _bytes_read(df) // _BYTES)) if 0 < len(df._jdf.inputFiles()) < n else df


def _cores(sc: SparkContext) -> int:
    """The cores that are there, or that the settings ask for if these are more: until executors have
    come, Spark counts those of none or a few."""
    conf = sc.getConf()
    said = lambda key, none: int(conf.get(key, none))
    cluster = re.match(r"local-cluster\[\s*(\d+)\s*,\s*(\d+)\s*,", sc.master)
    asked = int(cluster[1]) * int(cluster[2]) if cluster else said("spark.executor.instances", "0") * said("spark.executor.cores", "1")
    return max(sc.defaultParallelism, asked, said("spark.cores.max", "0"))


def _bytes_read(df: DataFrame) -> int:
    """The size of the tables that df is made from, as far as Spark knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def each_distinct(batch: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    """of each text of a batch, called and turned to Arrow once for each distinct one; null for null."""
    places: dict = {}
    at = [places.setdefault(t, len(places)) for t in batch.to_pylist()]
    made = pa.array([None if t is None else of(t) for t in places], kind)
    return made if len(places) == len(at) else made.take(pa.array(at))


class Engine:
    """symbols: unit symbols to know instead of the whole table; atoms: a unit table instead of the
    own one, as units.load_atoms() gives it; encode and decode: ids of prose for mode A, and back;
    ontology: the types and their order of precedence; lexicons: other tables for the scan, as
    config.load_lexicons() gives them."""

    def __init__(self, symbols: list[str] | None = None, encode: Callable[[str], list[int]] | None = None, prompts: dict[str, str] | None = None, ontology: Ontology | None = None, atoms: dict | None = None, decode: Callable[[list[int]], str] | None = None, lexicons: lx.Lexicons = lx.Lexicons()):
        if symbols is not None and not symbols:
            raise ValueError("at least one unit symbol is needed")
        if atoms is not None and not atoms:
            raise ValueError("at least one unit atom is needed")
        self.priority = (ontology or Ontology()).priority
        self.symbols, self.encode, self.decode, self.prompts, self.atoms, self.lexicons = tuple(symbols or atoms or ()), encode, decode, prompts, atoms, lexicons

    def regions_of(self, text: Column | str, fields: tuple[str, ...] = FIELDS) -> Column:
        """ARRAY of STRUCT of each text, with the fields of REGION asked for; null for a null text.
        Fields not asked for aren't made."""
        return self.scanner(fields)(text)

    def scanner(self, fields: tuple[str, ...] = FIELDS):
        """regions_of() as a function that can be registered."""
        symbols, priority, atoms, lexicons = self.symbols, self.priority, self.atoms, self.lexicons
        kind, constants = _arrow_type(fields), lexicons.values_of_constants()

        def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            found = patterns_of(symbols, lexicons)
            for batch in batches:
                yield each_distinct(batch, lambda t: [_row(r, t, fields, atoms, constants) for r in regions(t, found, priority)], kind)

        return F.arrow_udf(scan, f"ARRAY<STRUCT<{', '.join(f'`{f}`: {REGION[f]}' for f in fields)}>>")

    def regions(self, df: DataFrame, text_col: str = "text", into: str = "regions", fields: tuple[str, ...] = FIELDS) -> DataFrame:
        return dealt(df).withColumn(into, self.regions_of(F.col(text_col), fields))

    def exploded(self, df: DataFrame, text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """One row per region, with fields of REGION beside the other columns."""
        rest = [c for c in df.columns if c != text_col]
        return dealt(df).select(*rest, F.inline(self.regions_of(F.col(text_col), fields)))

    def decoded(self, ids: Column) -> Column:
        """The prose of arrays of ids that encode gave."""
        if self.decode is None:
            raise NotImplementedError("there is no decoder")
        decode = self.decode
        return F.arrow_udf(lambda batch: pa.array([None if x is None else decode(x) for x in batch.to_pylist()], pa.string()), "STRING")(ids)

    def preprocess(self, df: DataFrame, text_col: str = "text", into: str = "preprocessed", mode: str = "B", strict: bool = False) -> DataFrame:
        """df with the rewritten text and `<into>_errors`; in strict mode an error fails the query."""
        if mode == "A" and self.encode is None:
            raise NotImplementedError("mode A needs an encoder for prose")
        symbols, encode, priority, atoms, lexicons = self.symbols, self.encode, self.priority, self.atoms, self.lexicons
        constants, kind = lexicons.values_of_constants(), pa.struct([("text", pa.string()), ("errors", pa.list_(pa.string()))])

        def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            found = patterns_of(symbols, lexicons)
            for batch in batches:
                yield each_distinct(batch, lambda t: dict(zip(("text", "errors"), rendered(t, regions(t, found, priority), mode, encode, atoms, constants))), kind)

        out = F.arrow_udf(rewrite, "STRUCT<text: STRING, errors: ARRAY<STRING>>")(F.col(text_col))
        made = dealt(df).withColumn("_made", out).withColumns({into: F.col("_made.text"), f"{into}_errors": F.col("_made.errors")}).drop("_made")
        if strict:
            failed = F.raise_error(F.concat(F.lit("unreadable region: "), F.array_join(f"{into}_errors", "; "))).cast("string")
            made = made.withColumn(into, F.when(F.size(f"{into}_errors") > 0, failed).otherwise(F.col(into)))
        return made

    def for_llm(self, df: DataFrame, text_col: str = "text", language: str = "pt-br") -> DataFrame:
        """preprocessed, prompt and messages ARRAY<STRUCT<role, content>>; null for empty texts."""
        prompt = activation_prompt(language, self.prompts).rstrip()
        made = self.preprocess(df, text_col)
        usable = F.col("preprocessed") != ""
        message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        return made.withColumns(
            {
                "prompt": F.when(usable, F.concat(F.lit(prompt + "\n\n"), F.col("preprocessed"))),
                "messages": F.when(usable, F.array(message("system", F.lit(prompt)), message("user", F.col("preprocessed")))),
            }
        )


_ARROW = {"STRING": pa.string(), "INT": pa.int32(), "ARRAY<STRING>": pa.list_(pa.string())}


def _arrow_type(fields: tuple[str, ...]) -> pa.DataType:
    return pa.list_(pa.struct([(f, _ARROW[REGION[f]]) for f in fields]))


def _row(r, text: str, fields: tuple[str, ...], atoms: dict | None, constants: dict) -> dict:
    out = {"type": r.type, "start": r.start, "end": r.end}
    if len(fields) > 3 or not out.keys() >= set(fields):
        out |= {"content": text[r.start : r.end], "ambig_kind": r.ambig, "ambig_alternatives": list(r.alternatives)}
        if "slug" in fields:
            out["slug"] = slug_of(r, text)
        if "tag" in fields or "error" in fields:
            out["tag"], out["error"] = tag(r, text, atoms=atoms, constants=constants)
    return {f: out[f] for f in fields}


QUANTITY = "STRUCT<raw: STRING, value: DOUBLE, uncertainty: DOUBLE, unit: STRING, terms: ARRAY<STRUCT<symbol: STRING, power: INT>>, dim: ARRAY<INT>, factor: DOUBLE, si_unit: STRING, si_value: DOUBLE, si_uncertainty: DOUBLE>"


def quantity_of(text: Column, atoms: dict | None = None) -> Column:
    """STRUCT<quantities, error>: what a text states as a quantity, a unit alone or a range, with its
    terms, dimension and SI form; null and the error where it can't be read."""

    def as_dict(q: Quantity) -> dict:
        return q._asdict() | {"terms": [{"symbol": s, "power": p} for s, p in q.terms]}

    def of(text):
        try:
            if not text.strip():
                raise UnitError("empty quantity")
            return {"quantities": [as_dict(q) for q in quantities(text, atoms)], "error": None}
        except (UnitError, NumberError, OverflowError, ZeroDivisionError) as e:
            return {"quantities": None, "error": str(e)}

    return each_once(of, f"STRUCT<quantities: ARRAY<{QUANTITY}>, error: STRING>")(text)


def each_once(f: Callable, kind: str, **register):
    """An Arrow-batched function of one or more columns that calls f once for each distinct
    combination of a batch; null where an argument is null."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow = to_arrow_type(DataType.fromDDL(kind))

    def one(a: pa.Array) -> pa.Array:
        return over(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return over(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return over(a, b, c)

    def over(*columns: pa.Array) -> pa.Array:
        seen: dict = {}
        out = []
        for row in zip(*(c.to_pylist() for c in columns)):
            if row not in seen:
                seen[row] = None if None in row else f(*row)
            out.append(seen[row])
        return pa.array(out, arrow)

    n = f.__code__.co_argcount
    return F.arrow_udf((one, two, three)[n - 1], kind)


def stems(word: Column) -> Column:
    """The stem of each word, in Arrow batches."""
    return each_once(lambda w: stem(w), "STRING")(word)


def by_type(exploded: DataFrame) -> DataFrame:
    """Regions and code points by type; of regions with their type, start and end."""
    return exploded.groupBy("type").agg(F.count("*").alias("n_regions"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_chars"))


def constants(df: DataFrame, symbol_col: str) -> DataFrame:
    """df with the name, unit and value of a constant's symbol."""
    table = df.sparkSession.createDataFrame(list(lx.CONSTANTS), "_symbol STRING, const_name STRING, const_unit STRING, const_value DOUBLE")
    return df.join(F.broadcast(table), df[symbol_col] == F.col("_symbol"), "left").drop("_symbol")


def operators(df: DataFrame, symbol_col: str) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(lx.OPERATOR_ROWS), "_symbol STRING, arity INT, category STRING")
    return df.join(F.broadcast(table), df[symbol_col] == F.col("_symbol"), "left").drop("_symbol")


def connectives(df: DataFrame, form_col: str) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(lx.CONNECTIVE_ROWS), "_form STRING, function STRING, language STRING")
    return df.join(F.broadcast(table), F.lower(df[form_col]) == F.col("_form"), "left").drop("_form")
