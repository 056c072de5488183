"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim import lexicons as lx
from lexidim import units
from lexidim.functions import numbers as nb
from lexidim.functions import text as tx
from lexidim.operators import compose, resolve
from lexidim.plans import engine as en
from lexidim.plans import sql as lexi_sql
from lexidim.sources import benchmark
from lexidim.sources import cases as cs
from lexidim.sources.config import Ontology
from lexidim.folders import shared_folder, write_text
from lexidim.streaming import regions as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ENGINE = en.Engine()


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST('{v!r}' AS DOUBLE)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def pick(col, items):
    """The item that a number picks, by its remainder."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(col, F.lit(len(items))) + 1).cast("int"))


def picked_sql(table: str, key: str, rows, names: str) -> str:
    """Each row of a table with the values that its key picks by remainder, in SQL."""
    rows = list(rows)
    return f"(SELECT {key}, {names} FROM {table} JOIN (VALUES {values((k, *r) for k, r in enumerate(rows))}) v(k, {names}) ON {key} % {len(rows)} = k)"


def grouped_sql(n: str) -> str:
    """An integer's digits in threes, in SQL."""
    return f"trim(regexp_replace(lpad(CAST({n} AS VARCHAR), 15, ' '), '(...)', '\\1 ', 'g'))"


# ---- quantities

def part_text():
    return F.concat(F.lit("tensão de "), F.col("p_size").cast("string"), F.lit(" MPa na peça "), F.lower("p_brand")).alias("text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", part_text())


@query("SELECT p_partkey, 10 AS q_start, CAST(length(CAST(p_size AS VARCHAR)) + 14 AS INTEGER) AS q_end, p_size || ' MPa' AS content FROM part")
def qty_scan_part(spark, sf_dir):
    found = ENGINE.exploded(parts(spark, sf_dir), fields=("type", "start", "end", "content")).where("type = 'QTY'")
    return found.select("p_partkey", F.col("start").alias("q_start"), F.col("end").alias("q_end"), "content")


@query("SELECT p_partkey, '[QTY value=' || p_size || ' unit=MPa dim=[1,-1,-2,0,0,0,0]]' AS tag FROM part")
def qty_render_b(spark, sf_dir):
    return ENGINE.exploded(parts(spark, sf_dir), fields=("type", "tag")).where("type = 'QTY'").select("p_partkey", "tag")


@query("SELECT p_partkey, 'a <QTY><VAL>' || p_size || '000000</VAL><DIM>Pa</DIM><UNC/></QTY>' AS text FROM part")
def qty_render_a(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a "), F.col("p_size").cast("string"), F.lit(" MPa")).alias("text"))
    plain = en.Engine(encode=lambda prose: [prose.strip()])
    return plain.preprocess(texts, mode="A").select("p_partkey", F.regexp_replace("preprocessed", "^a ?", "a ").alias("text"))


@query("SELECT p_partkey, '[QTY value=' || p_size || ' unit=mA dim=[0,0,0,1,0,0,0]]-[QTY value=' || (p_size + 5) || ' unit=mA dim=[0,0,0,1,0,0,0]]' AS tag FROM part")
def qty_range(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + 5, F.lit(" mA")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "tag")).where("type = 'QTY'").select("p_partkey", "tag")


@query("SELECT p_partkey, '[QTY value=' || p_size || ' unit=mm dim=[0,1,0,0,0,0,0] unc=2]' AS tag FROM part")
def qty_uncertainty(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("cota "), F.col("p_size"), F.lit(" ± 2 mm")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "tag")).where("type = 'QTY'").select("p_partkey", "tag")


# ---- units

UNIT_ROWS = [
    ("MPa", "[1,-1,-2,0,0,0,0]", 1e6, "Pa"), ("kN·m", "[1,2,-2,0,0,0,0]", 1e3, "J"), ("kgf/cm²", "[1,-1,-2,0,0,0,0]", 98066.5, "Pa"), ("J/(kg·K)", "[0,2,-2,0,-1,0,0]", 1.0, "m^2·s^-2·K^-1"),
    ("W/(m·K)", "[1,1,-3,0,-1,0,0]", 1.0, "kg·m·s^-3·K^-1"), ("m s⁻²", "[0,1,-2,0,0,0,0]", 1.0, "m/s²"), ("kg/m3", "[1,-3,0,0,0,0,0]", 1.0, "kg·m^-3"), ("cv", "[1,2,-3,0,0,0,0]", 735.49875, "W"),
    ("m/s/s", "[0,1,-2,0,0,0,0]", 1.0, "m/s²"), ("1/foo", None, None, None), ("km^2", "[0,2,0,0,0,0,0]", 1e6, "m²"), ("Pa·s", "[1,-1,-1,0,0,0,0]", 1.0, "Pa·s"), ("foobar", None, None, None),
]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', ((u, d, None if f is None else round(f, 6), s) for u, d, f, s in UNIT_ROWS), 'unit, dim, factor, si_unit')}")
def unit_dim_vector(spark, sf_dir):
    units_of = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [u for u, *_ in UNIT_ROWS]).alias("unit"))
    return units.with_unit(units_of, "unit").select("p_partkey", "unit", units.dim_text(F.col("dim")).alias("dim"), F.round("factor", 6).alias("factor"), "si_unit")


@query("SELECT p_partkey, round(p_size / 25.4, 6) AS inches, round(p_size * 1e6 / 98066.5, 6) AS kgf_cm2 FROM part")
def unit_convert(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.lit("mm").alias("a"), F.lit("in").alias("b"), F.lit("MPa").alias("c"), F.lit("kgf/cm²").alias("d"))
    made = units.conversions(df, [("v", "a", "b", "x"), ("v", "c", "d", "y")])
    return made.select("p_partkey", F.round("x.value", 6).alias("inches"), F.round("y.value", 6).alias("kgf_cm2"))


PAIRS = [("Pa", "N/m²", True), ("kgf", "N", True), ("t", "tf", False), ("m", "kg", False), ("J", "kW·h", True), ("psi", "kPa", True), ("rad", "%", True), ("W", "cv", True), ("N·m", "J", True), ("foobar", "m", None)]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', ((a, b, 'true' if s else 'false' if s is False else None) for a, b, s in PAIRS), 'a, b, same')}")
def unit_homogeneity(spark, sf_dir):
    key = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select("p_partkey", pick(key, [a for a, *_ in PAIRS]).alias("a"), pick(key, [b for _, b, _ in PAIRS]).alias("b"))
    return units.with_units(df, {"a_": "a", "b_": "b"}).select("p_partkey", "a", "b", (F.col("a_dim") == F.col("b_dim")).cast("string").alias("same"))


@query("SELECT 'incompatible dimensions' AS error, count(*) AS n FROM part")
def unit_convert_errors(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("v"), F.lit("mm").alias("a"), F.lit("kg").alias("b"))
    return units.converted(df, "v", "a", "b").where("converted IS NULL").groupBy("error").agg(F.count("*").alias("n"))


LINE_UNITS = {"A": ("kN", 1000.0), "N": ("tf", 9806.65), "R": ("MPa", 1e6)}


@query("""SELECT si_unit, round(sum(l_quantity * f) / 1e6, 3) AS total, count(*) AS n FROM lineitem
JOIN (VALUES ('A', 1000.0, 'N'), ('N', 9806.65, 'N'), ('R', 1000000.0, 'Pa')) u(flag, f, si_unit) ON l_returnflag = flag GROUP BY si_unit""")
def si_sum_by_unit(spark, sf_dir):
    flags = F.create_map(*[F.lit(x) for k, (u, _) in LINE_UNITS.items() for x in (k, u)])
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", flags[F.col("l_returnflag")].alias("unit"))
    return units.si_sums(lines, "l_quantity", "unit").select("si_unit", F.round(F.col("total") / 1e6, 3).alias("total"), "n")


PREFIXED = [("km", 3.0), ("mm", -3.0), ("µs", -6.0), ("MPa", 6.0), ("kN", 3.0), ("GHz", 9.0), ("daN", 1.0), ("hPa", 2.0), ("mg", -6.0), ("kg", 0.0), ("pF", -12.0), ("TW", 12.0), ("cL", -5.0), ("as", None), ("das", None), ("min", None), ("dpi", None), ("xyz", None)]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', PREFIXED, 'symbol, magnitude')}")
def prefix_expand(spark, sf_dir):
    """Powers of ten of symbols that prefixes make; null where the symbol is another's or none."""
    wanted = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [x for x, _ in PREFIXED]).alias("symbol"))
    made = units.prefixed_atoms(spark).select(F.col("symbol").alias("_symbol"), F.round(F.log10("factor"), 6).alias("magnitude"))
    return wanted.join(F.broadcast(made), F.col("symbol") == F.col("_symbol"), "left").drop("_symbol")


ALIASED = [("mt", "tf·m"), ("t/m²", "tf/m²"), ("kgf/cm2", "kgf/cm²"), ("N/m2", "N/m²"), ("g/cm3", "g/cm³"), ("mm3", "mm³"), ("Torr", "torr"), ("mmH₂O", "mmH2O"), ("in Hg", "inHg"), ("KB", "kB"), ("Gbyte", "gigabyte"), ("MPa", "MPa"), ("t", "t"), ("", "")]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', ALIASED, 'alias, canonical')}")
def alias_normalize(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [x for x, _ in ALIASED]).alias("alias"))
    return df.select("p_partkey", "alias", units.normalized(F.col("alias")).alias("canonical"))


ATOM_ROWS = [("N", "[1,1,-2,0,0,0,0]", 1.0, "si"), ("kgf", "[1,1,-2,0,0,0,0]", 9.80665, "si"), ("µm", "[0,1,0,0,0,0,0]", 1e-6, "prefixed"), ("%", "[0,0,0,0,0,0,0]", 0.01, "ratio"), ("rad", "[0,0,0,0,0,0,0]", 1.0, "angle"), ("kB", "[0,0,0,0,0,0,0]", 8000.0, "information"), ("KiB", "[0,0,0,0,0,0,0]", 8192.0, "information"), ("°C", "[0,0,0,0,1,0,0]", 1.0, "si"), ("L", "[0,3,0,0,0,0,0]", 0.001, "si"), ("eV", "[1,2,-2,0,0,0,0]", 1.602176634e-19, "si"), ("foo", None, None, None)]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', ATOM_ROWS, 'symbol, dim, factor, category')}")
def unit_atoms(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [r[0] for r in ATOM_ROWS]).alias("symbol"))
    return wanted.join(F.broadcast(units.atom_table(spark)), "symbol", "left").select("p_partkey", "symbol", units.dim_text(F.col("dim")).alias("dim"), "factor", "category")


QUANTITIES = [("350 MPa", 350.0, None, "MPa", 3.5e8, None, "Pa"), ("20 ± 2 mm", 20.0, 2.0, "mm", 0.02, 0.002, "m"), ("kgf/cm²", None, None, "kgf/cm²", None, None, "Pa"), ("1,5 kN·m", 1.5, None, "kN·m", 1500.0, None, "J"), ("7 foobar", 7.0, None, "foobar", None, None, None), ("−40 °C", -40.0, None, "°C", -40.0, None, "K"), ("", None, None, None, None, None, None)]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', QUANTITIES, 'raw, value, uncertainty, unit, si_value, si_uncertainty, si_unit')}")
def quantity_parse(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [q[0] for q in QUANTITIES]).alias("raw"))
    q = F.get(en.quantity_of(F.col("raw"))["quantities"], 0)
    return df.select("p_partkey", "raw", q["value"].alias("value"), q["uncertainty"].alias("uncertainty"), q["unit"].alias("unit"), F.round(q["si_value"], 9).alias("si_value"), F.round(q["si_uncertainty"], 9).alias("si_uncertainty"), q["si_unit"].alias("si_unit"))


# ---- numbers

PRICE = "CAST(floor(o_totalprice) AS BIGINT)"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("n"))


def in_threes(n, mark):
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", mark)


@query(f"SELECT o_orderkey, CAST({PRICE} AS DOUBLE) + 0.25 AS pt, CAST({PRICE} AS DOUBLE) + 0.25 AS en, CAST({PRICE} AS DOUBLE) AS us FROM orders")
def number_canonical(spark, sf_dir):
    n = F.col("n")
    return orders(spark, sf_dir).select(
        "o_orderkey", nb.canonical_number(F.concat(in_threes(n, "."), F.lit(",25"))).alias("pt"), nb.canonical_number(F.concat(in_threes(n, ","), F.lit(".25"))).alias("en"),
        nb.canonical_number(F.when(n >= 1_000_000, in_threes(n, ",")).otherwise(n.cast("string"))).alias("us"),
    )


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'pt-br' WHEN o_orderkey % 4 = 1 THEN 'en' WHEN o_orderkey % 4 = 2 THEN 'none' WHEN {PRICE} >= 1000 THEN 'pt-br' ELSE 'none' END AS locale FROM orders")
def number_locale(spark, sf_dir):
    n, key = F.col("n"), F.col("o_orderkey") % 4
    raw = F.when(key == 0, F.concat(in_threes(n, "."), F.lit(",25"))).when(key == 1, F.concat(in_threes(n, ","), F.lit(".25"))).when(key == 2, n.cast("string")).otherwise(in_threes(n, "."))
    return orders(spark, sf_dir).select("o_orderkey", nb.number_locale(raw).alias("locale"))


KINDS = [("5", "inteira", 5.0), ("3,5", "decimal", 3.5), ("3,5%", "percentual", 0.035), ("3/4", "fracionaria", 0.75), ("1ª", "ordinal", 1.0), ("6.022e23", "cientifica", 6.022e23), ("5,9722×10²⁴", "cientifica", 5.9722e24), ("10⁶", "cientifica", 1e6), ("5/0", "fracionaria", None), ("−273,15", "decimal", -273.15), ("2×10^(-3)", "cientifica", 0.002)]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', KINDS, 'raw, kind, value')}")
def number_repr(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [r for r, *_ in KINDS]).alias("raw"))
    return df.select("p_partkey", "raw", nb.number_kind(F.col("raw")).alias("kind"), nb.number_parsed(F.col("raw"))["value"].alias("value"))


@query("SELECT p_partkey, round(p_size / 100.0, 6) AS percent, round(p_size / 7.0, 6) AS fraction, CAST(p_size AS DOUBLE) AS ordinal, CAST(p_size AS DOUBLE) * 1000 AS scientific FROM part")
def number_variants(spark, sf_dir):
    s = F.col("p_size").cast("string")
    made = {"percent": F.concat(s, F.lit("%")), "fraction": F.concat(s, F.lit("/7")), "ordinal": F.concat(s, F.lit("º")), "scientific": F.concat(s, F.lit(" × 10³"))}
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(nb.number_parsed(x)["value"], 6).alias(k) for k, x in made.items()))


@query(f"SELECT o_orderkey, CAST({PRICE} AS VARCHAR) AS whole, CAST({PRICE} AS VARCHAR) || '.5' AS half, format('{{:.6g}}', CAST({PRICE} AS DOUBLE) * 1e12 + 0.0) AS large, format('{{:.6g}}', CAST({PRICE} AS DOUBLE) * 1e-12) AS small FROM orders")
def format_value(spark, sf_dir):
    n = F.col("n").cast("double")
    made = {"whole": n, "half": n + 0.5, "large": n * 1e12, "small": n * 1e-12}
    return orders(spark, sf_dir).select("o_orderkey", *(nb.col_format_value(v).alias(k) for k, v in made.items()))


@query(f"SELECT o_orderkey, CASE WHEN {PRICE} >= 1000 THEN {grouped_sql(PRICE)} END AS r2l FROM orders")
def r2l_group(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", nb.r2l_group(F.col("n").cast("double")).alias("r2l"))


@query(f"""SELECT o_orderkey, '[NUM value=' || n || CASE WHEN n >= 1000 THEN ' r2l="' || {grouped_sql('n')} || '"' ELSE '' END || ' locale=none repr=inteira original="' || n || '"]' AS tag FROM (SELECT o_orderkey, {PRICE} AS n FROM orders)""")
def num_render(spark, sf_dir):
    texts = orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("houve "), F.col("n").cast("string"), F.lit(" casos")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "tag")).where("type = 'NUM'").select("o_orderkey", "tag")


# ---- references, identifiers, lookups


@query("""SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN '[REF:' || p_size || '.2.1]' END AS tag FROM part WHERE p_size % 3 < 2""")
def ref_scan(spark, sf_dir):
    before = F.element_at(F.array(F.lit("conforme § "), F.lit("item "), F.lit("versão ")), (F.col("p_size") % 3 + 1).cast("int"))
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(before, F.col("p_size"), F.lit(".2.1 vale")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "tag")).where("type = 'REF'").select("p_partkey", "tag")


@query("SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS slug, 'acao-' || p_size AS accented FROM part")
def idx_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.col_slug(F.col("p_brand")).alias("slug"), tx.col_slug(F.concat(F.lit(" Ação "), F.col("p_size"))).alias("accented"))


@query("SELECT p_partkey, 'nbr-' || (6000 + p_size) AS slug FROM part UNION ALL SELECT p_partkey, 'aisi-' || (1000 + p_size) FROM part UNION ALL SELECT p_partkey, 'iso-' || (9000 + p_size) || '-2015' FROM part")
def idx_norm_scan(spark, sf_dir):
    text = F.concat(F.lit("NBR "), F.col("p_size") + 6000, F.lit(" e AISI "), F.col("p_size") + 1000, F.lit(" com ISO "), F.col("p_size") + 9000, F.lit(":2015."))
    return ENGINE.exploded(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), fields=("type", "slug")).where("type = 'IDX'").select("p_partkey", "slug")


CONSTANT_ROWS = [
    ("π", "pi", "adimensional", 3.141592653589793), ("ℏ", "constante de Planck reduzida", "J·s", 1.054571817e-34), ("k_B", "constante de Boltzmann", "J/K", 1.380649e-23), ("N_A", "número de Avogadro", "1/mol", 6.02214076e23),
    ("σ_SB", "constante de Stefan-Boltzmann", "W/(m²·K⁴)", 5.670374419e-08), ("R_g", "constante universal dos gases", "J/(mol·K)", 8.314462618), ("x", None, None, None),
]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', CONSTANT_ROWS, 'symbol, const_name, const_unit, const_value')}")
def const_lookup(spark, sf_dir):
    return en.constants(table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [c[0] for c in CONSTANT_ROWS]).alias("symbol")), "symbol")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '[CONST:k_B]' WHEN 1 THEN '[CONST:π]' ELSE '[CONST:N_A]' END AS tag FROM part")
def const_scan(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("peça "), F.col("p_size"), F.lit(" usa "), pick(F.col("p_partkey"), ["k_B", "π", "N_A"]), F.lit(" e ak_B, πr")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "tag")).where("type = 'CONST'").select("p_partkey", "tag")


OPERATOR_SIGNS = [("⇔", 2, "logico"), ("¬", 1, "logico"), ("≤", 2, "relacional"), ("=", 2, "relacional"), ("∈", 2, "relacional"), ("∑", 1, "calculo"), ("∇", 1, "calculo"), ("×", 2, "aritmetico")]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', OPERATOR_SIGNS, 'symbol, arity, category')}")
def op_lookup(spark, sf_dir):
    return en.operators(table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [x for x, *_ in OPERATOR_SIGNS]).alias("symbol")), "symbol")


@query("SELECT p_partkey, CAST(length(p_partkey::VARCHAR) + 7 AS INTEGER) AS start, CASE p_partkey % 3 WHEN 0 THEN '≥' WHEN 1 THEN '⇒' ELSE '=' END AS content FROM part")
def op_scan(spark, sf_dir):
    """Operators among names; an equals sign inside a word is none."""
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("caso "), F.col("p_partkey"), F.lit(". "), pick(F.col("p_partkey"), ["≥", "⇒", "="]), F.lit(" outro a=b")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "start", "content")).where("type = 'OP'").select("p_partkey", "start", "content")


@query("SELECT n_nationkey, 9 + length(n_name) AS start, 'conclusiva' AS function, 'pt-br' AS language FROM nation")
def rel_scan(spark, sf_dir):
    texts = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("then "), F.lower("n_name"), F.lit(" is "), F.lit("Portanto azul")).alias("text"))
    found = ENGINE.exploded(texts, fields=("type", "start", "content")).where("type = 'REL'").select("n_nationkey", "start", "content")
    return en.connectives(found, "content").select("n_nationkey", F.col("start").cast("long").alias("start"), "function", "language")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'kgf/cm²' WHEN 1 THEN 'kN·m' ELSE 'J/(kg·K)' END AS content, CASE p_partkey % 3 WHEN 0 THEN '[QTY unit=kgf/cm² dim=[1,-1,-2,0,0,0,0]]' WHEN 1 THEN '[QTY unit=kN·m dim=[1,2,-2,0,0,0,0]]' ELSE '[QTY unit=J/(kg·K) dim=[0,2,-2,0,-1,0,0]]' END AS tag FROM part")
def unit_only_scan(spark, sf_dir):
    """Units without a number, far from what stands before them too."""
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a " * 100), F.lit("medida em "), pick(F.col("p_partkey"), ["kgf/cm²", "kN·m", "J/(kg·K)"]), F.lit(" é clássica e/ou usual")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "content", "tag")).where("type = 'QTY'").select("p_partkey", "content", "tag")


@query("SELECT p_partkey, '[QTY value=' || p_size || ' unit=' || CASE p_partkey % 3 WHEN 0 THEN 'kN·m/m dim=[1,1,-2,0,0,0,0]' WHEN 1 THEN 'W/(m²·K) dim=[1,0,-3,0,-1,0,0]' ELSE 'm s⁻² dim=[0,1,-2,0,0,0,0]' END || ']' AS tag FROM part")
def unit_composition_scan(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("vale "), F.col("p_size"), F.lit(" "), pick(F.col("p_partkey"), ["kN·m/m", "W/(m²·K)", "m s⁻²"]), F.lit(" em média")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "tag")).where("type = 'QTY'").select("p_partkey", "tag")


MATERIALS = [("AISI 1045", "aisi-1045"), ("ASTM A36", "astm-a36"), ("SAE 4140 H", "sae-4140-h"), ("ER70S-6", "er70s-6"), ("CP II-E", "cp-ii-e"), ("CA-50", "ca-50"), ("USI SAC 300", "usi-sac-300"), ("Gerdau GG 50", "gerdau-gg-50"), ("Re", "re"), ("TIG", "tig"), ("γ_c", "γc"), ("EN 1992", "en-1992"), ("ASME B31.3", "asme-b31-3"), ("DIN 931", "din-931")]


@query(f"SELECT p_partkey, slug FROM {picked_sql('part', 'p_partkey', MATERIALS, 'name, slug')}")
def idx_material(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("peça de "), pick(F.col("p_partkey"), [m for m, _ in MATERIALS]), F.lit(" na obra")).alias("text"))
    return ENGINE.exploded(texts, fields=("type", "slug")).where("type = 'IDX'").select("p_partkey", "slug")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '%' WHEN 1 THEN p_size || '/7' WHEN 2 THEN p_size || 'ª' ELSE p_size || ',5' END AS content, CASE p_partkey % 4 WHEN 0 THEN 'percentual' WHEN 1 THEN 'fracionaria' WHEN 2 THEN 'ordinal' ELSE 'decimal' END AS kind FROM part")
def num_kinds_scan(spark, sf_dir):
    n = F.col("p_size").cast("string")
    ends = pick(F.col("p_partkey"), ["%", "/7", "ª", ",5"])
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("foi "), n, ends, F.lit(" vez")).alias("text"))
    found = ENGINE.exploded(texts, fields=("type", "content")).where("type IN ('NUM', 'QTY')")
    return found.select("p_partkey", "content", nb.number_kind(F.col("content")).alias("kind"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'clear' WHEN 2 THEN 'clear' ELSE 'unit-letter' END AS decision FROM part")
def unit_letter_ambiguity(spark, sf_dir):
    before = F.element_at(F.array(F.lit("tópico "), F.lit("P = "), F.lit("potência de "), F.lit("motor de ")), (F.col("p_size") % 4 + 1).cast("int"))
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(before, F.col("p_size"), F.lit(" W liga")).alias("text"))
    found = ENGINE.regions(texts, fields=("type", "ambig_kind"))
    kinds = F.transform(F.filter("regions", lambda r: r["type"] == "QTY"), lambda r: F.coalesce(r["ambig_kind"], F.lit("clear")))
    return found.select("p_partkey", F.coalesce(F.get(kinds, 0), F.lit("rejected")).alias("decision"))


STEMMED = [("frias", "fri", "K"), ("geladas", "gel", "K"), ("térmicas", "térm", "K"), ("quentes", "quent", "K"), ("potências", "pot", "W"), ("forças", "forç", "N"), ("dissipação", "dissip", "W"), ("voltagem", "volt", "V"), ("frita", "frit", None)]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', STEMMED, 'word, stem, unit')}")
def anchor_stem(spark, sf_dir):
    """Words stemmed in Arrow batches, and the unit that their stem confirms."""
    words = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [w for w, *_ in STEMMED]).alias("word")).withColumn("stem", en.stems(F.col("word")))
    stems = spark.createDataFrame([(u, x) for u, all_of in lx.ANCHOR_STEMS.items() for x in all_of.split()], "unit STRING, stem STRING")
    return words.join(F.broadcast(stems), "stem", "left").select("p_partkey", "word", "stem", "unit")


# ---- resolution

SPANS_SQL = "SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'QTY' WHEN 1 THEN 'NUM' ELSE 'IDX' END AS type, CAST(l_partkey % 60 AS INTEGER) AS s, CAST(l_partkey % 60 + l_quantity AS INTEGER) AS e FROM lineitem"


def line_spans(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("QTY"), F.lit("NUM"), F.lit("IDX")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    start = (F.col("l_partkey") % 60).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("type"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"))


@query(f"WITH x AS ({SPANS_SQL}) SELECT doc_id, type, s AS start, e AS \"end\" FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE a.doc_id = b.doc_id AND a.type <> b.type AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e))")
def containment_antijoin(spark, sf_dir):
    return resolve.without_contained(line_spans(spark, sf_dir))


@query(f"""WITH x AS ({SPANS_SQL}), f AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE a.doc_id = b.doc_id AND a.type <> b.type AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e))),
o AS (SELECT doc_id, list([{{'type': type, 's': s, 'e': e}}] ORDER BY CASE type WHEN 'QTY' THEN 0 WHEN 'NUM' THEN 1 ELSE 2 END, s - e, s) AS items FROM f GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(items, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS r FROM o)
SELECT doc_id, r.type AS type, r.s AS start, r.e AS "end" FROM k""")
def overlap_greedy(spark, sf_dir):
    return resolve.resolved(line_spans(spark, sf_dir), lx.PRIORITY)


@query(f"""WITH x AS ({SPANS_SQL}), y AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
z AS (SELECT doc_id, s, e, sum(CASE WHEN m IS NULL OR m < s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM y),
i AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM z GROUP BY doc_id, g UNION ALL SELECT DISTINCT doc_id, 200, 200 FROM x),
r AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS start, s AS "end" FROM i) SELECT * FROM r WHERE start < "end" """)
def residual_prose(spark, sf_dir):
    spans = line_spans(spark, sf_dir)
    return resolve.gaps(spans, spans.select("doc_id").distinct().withColumn("length", F.lit(200)))


@query("SELECT o_custkey, string_agg(o_orderpriority || ';', '' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def reassemble(spark, sf_dir):
    pieces = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("start"), F.concat("o_orderpriority", F.lit(";")).alias("piece"))
    return resolve.reassembled(pieces, "o_custkey")


# ---- symbols

SYMBOL_TEXTS = [
    ("a tensão σ_y domina", "σ_y"), ("largura = 5 m", "largura"), ("o fluxo é M(x) aqui", "M(x)"), ("nada aqui", ""), ("use \\frac{a}{b} sempre", "\\frac{a}{b}"), ("derivada dM/dx nula", "dM/dx"),
    ("x² + y² vale", "x²,y²"), ("lista [a, b, c] fim", "a,b,c"), ("calcule √(a²+b²) agora", "√(a²+b²)"), ("onde T ≈ 3", "T"),
]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', SYMBOL_TEXTS, 'text, symbols')}")
def sym_scan(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [t for t, _ in SYMBOL_TEXTS]).alias("text"))
    found = F.transform(F.filter("regions", lambda r: r["type"] == "SYM"), lambda r: r["content"])
    return ENGINE.regions(df, fields=("type", "content")).select("p_partkey", "text", F.array_join(found, ",").alias("symbols"))


@query("SELECT p_partkey, '[SYM:carga] = [QTY value=' || p_size || ' unit=kN dim=[1,1,-2,0,0,0,0]]' AS text FROM part")
def sym_definition(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("carga = "), F.col("p_size"), F.lit(" kN")).alias("text"))
    return ENGINE.preprocess(texts).select("p_partkey", F.col("preprocessed").alias("text"))


GAPS = [("", "empty"), (" ", "prose"), ("\n  ", "prose"), (", ", "prose"), (" (", "prose"), (" + ", "operator"), (" = ", "operator"), (" × ", "operator"), (" e ", "mixed"), (" de ", "mixed"), (" + x ", "mixed"), ("\n- ", "mixed")]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', GAPS, 'gap, class')}")
def gap_classes(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [g for g, _ in GAPS]).alias("gap"))
    return df.select("p_partkey", "gap", tx.gap_class(F.col("gap")).alias("class"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'l,p' WHEN 1 THEN 'E,I' || p_size || ',M_max' ELSE '' END AS vars,
CASE p_partkey % 3 WHEN 0 THEN 'pl/' || p_size WHEN 1 THEN 'M_max/EI' || p_size ELSE 'x+x' END AS compact FROM part""")
def sym_variables(spark, sf_dir):
    key, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    expr = F.when(key == 0, F.concat(F.lit("p l / "), n)).when(key == 1, F.concat(F.lit("M_max / E I"), n, F.lit(" ."))).otherwise(F.lit("x + x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.coalesce(compose.free_names(expr), F.array().cast("array<string>")), ",").alias("vars"), tx.compact_expression(expr).alias("compact"))


COMPOSED = [
    ("pl/12", "pl"), ("(pl²/32)·∛2", "pl"), ("3l/4", "l"), ("0,03937pl²", "pl"), ("α_p·E", "E,α_p"), ("M_max", "M_max"), ("M(x)", "M,x"), ("V_c(t)", "V_c,t"), ("dM/dx", "dM,dx"), ("ΔT/R_total", "R_total,ΔT"), ("2x²", "x"), ("M_max/EI", "EI,M_max"),
    ("kg/m²", ""), ("tf·m", ""), ("kgf/cm²", ""), ("3/4", ""), ("0,75", ""), ("metros", ""), ("metros²", ""), ("apoios/12", ""), ("x", ""), ("", ""), ("(a)", ""), ("(ii)", ""), ("(xx)", ""), ("e/ou", ""), ("if/else", ""), ("palavra", ""),
]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', COMPOSED, 'expr, vars')}")
def sym_compose(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [t for t, _ in COMPOSED]).alias("expr"))
    return df.select("p_partkey", "expr", F.array_join(F.coalesce(compose.free_names(F.col("expr")), F.array().cast("array<string>")), ",").alias("vars"))


CLUSTERED = [("a · b", "0-5"), ("a = b", ""), ("x y", ""), ("a + b = c · d", "0-5,8-13"), ("a+b-c", "0-5"), ("a, b", ""), ("", "")]


@query(f"SELECT p_partkey, text, coalesce(spans, '') AS spans FROM {picked_sql('part', 'p_partkey', CLUSTERED, 'text, spans')}")
def sym_clusters(spark, sf_dir):
    """Every letter is a symbol here, and every spaced sign an operator."""
    texts = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [t for t, _ in CLUSTERED]).alias("text"))
    at = texts.select("p_partkey", "text", F.posexplode(F.split("text", "")).alias("start", "c")).where("c RLIKE '[a-z=·+]'")
    spaced = F.col("c").rlike("[a-z]") | (F.substring("text", F.col("start"), F.lit(1)) == " ")
    atoms = at.where(spaced).select("p_partkey", "text", "start", (F.col("start") + 1).alias("end"), F.when(F.col("c").rlike("[a-z]"), "SYM").otherwise("OP").alias("type"))
    spans = compose.clusters(atoms, ["p_partkey"]).groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))
    return texts.join(spans, "p_partkey", "left").select("p_partkey", "text", F.coalesce("spans", F.lit("")).alias("spans"))


@query("SELECT type, priority FROM (VALUES ('QTY', 0), ('CONST', 1), ('REF', 2), ('NUM', 3), ('IDX', 4), ('OP', 5), ('SYM', 6), ('REL', 7), ('PROSE', 8)) t(type, priority)")
def ontology_order(spark, sf_dir):
    return Ontology().table(spark).select("type", "priority")


@query("SELECT status, count(*) AS n FROM (VALUES ('OK'), ('OK'), ('OK'), ('DIFF'), ('SKIP')) t(status) GROUP BY status")
def unit_audit(spark, sf_dir):
    rows = [("kgf", "kg m s-2", 9.80665), ("psi", "kg m-1 s-2", 6894.757), ("kN", "kg m s-2", 1000.0), ("N", "kg m s-2", 2.0), ("foo", "m", 1.0)]
    expected = spark.createDataFrame([(s, list(units.dimension(d)), f) for s, d, f in rows], "symbol STRING, dim ARRAY<INT>, factor DOUBLE")
    return units.audited(spark, expected).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'QTY' AS type, p_size || ' MPa' AS content, round(p_size * 1e6 / 98066.5, 6) AS kgf_cm2 FROM part")
def sql_functions(spark, sf_dir):
    """The scan as a lateral table function, and a conversion, in SQL."""
    lexi_sql.register(spark)
    en.dealt(parts(spark, sf_dir)).createOrReplaceTempView("lexi_parts")
    return spark.sql("SELECT p_partkey, r.type, r.content, round(lexi_convert(lexi_number(split(r.content, ' ')[0]), 'MPa', 'kgf/cm²'), 6) AS kgf_cm2 FROM lexi_parts, LATERAL lexi_regions(text) r WHERE r.type = 'QTY'")


# ---- whole texts


def beam_texts(spark, sf_dir):
    """Technical sentences with regions of seven types."""
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("viga com "), n, F.lit(" kN, portanto σ_y ≤ "), n + 30, F.lit(" MPa na NBR 6118")).alias("text"))


@query("""WITH p AS (SELECT length(p_size::VARCHAR) AS a, length((p_size + 30)::VARCHAR) AS b FROM part)
SELECT 'PROSE' AS type, 3 * count(*) AS n_regions, 15 * count(*) AS n_chars FROM p UNION ALL SELECT 'QTY', 2 * count(*), CAST(sum(a + b + 7) AS BIGINT) FROM p UNION ALL SELECT 'REL', count(*), 8 * count(*) FROM p
UNION ALL SELECT 'SYM', count(*), 3 * count(*) FROM p UNION ALL SELECT 'OP', count(*), count(*) FROM p UNION ALL SELECT 'IDX', count(*), 8 * count(*) FROM p""")
def regions_by_type_parts(spark, sf_dir):
    return en.by_type(ENGINE.exploded(beam_texts(spark, sf_dir), fields=("type", "start", "end")))


@query("""SELECT p_partkey, 'viga com [QTY value=' || p_size || ' unit=kN dim=[1,1,-2,0,0,0,0]], portanto [SYM:σ_y] ≤ [QTY value=' || (p_size + 30) || ' unit=MPa dim=[1,-1,-2,0,0,0,0]] na [IDX:nbr-6118]' AS text FROM part""")
def preprocess_parts(spark, sf_dir):
    return ENGINE.preprocess(beam_texts(spark, sf_dir)).select("p_partkey", F.col("preprocessed").alias("text"))


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query()
def regions_by_type(spark, sf_dir):
    return en.by_type(ENGINE.exploded(documents(spark, sf_dir), fields=("type", "start", "end")))


@query()
def preprocess_docs(spark, sf_dir):
    return ENGINE.preprocess(documents(spark, sf_dir)).select("doc_id", F.sha2("preprocessed", 256).alias("sha256"), F.length("preprocessed").alias("n_chars"), F.size("preprocessed_errors").alias("n_errors"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def regions_cover_text(spark, sf_dir):
    """Regions and the blanks between them make up the text again."""
    texts = ENGINE.regions(documents(spark, sf_dir).where("text IS NOT NULL"), fields=("start", "end", "content"))
    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("regions", i - 1)["end"])
    pieces = F.transform("regions", lambda r, i: F.concat(F.substring("text", last(i) + 1, r["start"] - last(i)), r["content"]))
    tail = F.substring(F.col("text"), F.coalesce(F.get("regions", F.size("regions") - 1)["end"], F.lit(0)) + 1, F.length("text"))
    return texts.select("doc_id", F.sha2(F.concat(F.array_join(pieces, ""), tail), 256).alias("sha256"))


@query("SELECT c_custkey, 'cidade de ' || lower(c_mktsegment) AS text FROM customer")
def prose_identity(spark, sf_dir):
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("cidade de "), F.lower("c_mktsegment")).alias("text"))
    return ENGINE.preprocess(texts).select("c_custkey", F.col("preprocessed").alias("text"))


@query("SELECT p_partkey, 'system' AS first_role, 'user' AS second_role, 'cota [QTY value=' || p_size || ' unit=mm dim=[0,1,0,0,0,0,0]]' AS content FROM part")
def llm_messages(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("cota "), F.col("p_size"), F.lit(" mm")).alias("text"))
    m = F.col("messages")
    return ENGINE.for_llm(texts).select("p_partkey", m[0]["role"].alias("first_role"), m[1]["role"].alias("second_role"), m[1]["content"].alias("content"))


# ---- cases

REFERENCES, RISKY, OTHER = ["src0", "src1", "src2"], ["toxic", "de"], ["en", "fr", "es"]


def doc_cases(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    answers = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 6 + 1).cast("int")), lambda k: F.struct(k.cast("string").alias("name"), k.cast("double").alias("value"), F.lit("m").alias("unit"), F.lit(0.01).alias("tolerance")))
    return docs.join(labels, "doc_id").select(
        F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") % 500).cast("string")).alias("id"), F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("discipline"), F.col("lang").alias("language"),
        F.col("source").alias("source_id"), F.array_compact(F.array("lang", F.when(F.col("toxic") == 1, "toxic"))).alias("tags"), F.lit("cota de 5 mm").alias("prompt"),
        F.array("source").alias("norms"), answers.alias("answers"), F.size(answers).alias("n_answers"), F.when(F.col("quality") == 1, "validated").alias("review_status"),
        F.lit(None).cast("array<struct<path: string, inline: boolean, type: string>>").alias("assets"), F.lit(False).alias("has_figure"),
    )


CASES_SQL = """c AS (SELECT lang || '-' || (doc_id % 500) AS id, CAST(doc_id AS VARCHAR) AS title, lang, source, toxic, quality, doc_id % 6 + 1 AS n FROM documents JOIN labels USING (doc_id)),
v AS (SELECT *, (n < 4)::INT + (NOT (toxic = 1 OR lang = 'de'))::INT + 2 * (source NOT IN ('src0', 'src1', 'src2'))::INT
  + (row_number() OVER (PARTITION BY id ORDER BY title) > 1)::INT AS errors FROM c)"""


@query(f"WITH {CASES_SQL} SELECT id, title, errors AS n_errors, (quality <> 1)::INT AS n_warnings FROM v")
def case_validate(spark, sf_dir):
    return cs.validated(doc_cases(spark, sf_dir), REFERENCES, RISKY, OTHER).select("id", "title", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query(f"""WITH {CASES_SQL} SELECT id, title, concat_ws(';', CASE WHEN quality <> 1 THEN 'not validated' END,
  CASE WHEN CAST(title AS BIGINT) % 2 = 0 AND CAST(title AS BIGINT) % 5 < 3 THEN 'figure without svg or png asset' END) AS warnings FROM v""")
def case_figures(spark, sf_dir):
    """case_validate's warnings, with a figure in every other case and assets of each kind."""
    n = F.col("title").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "table_csv", "", "svg", "png"))), (n % 5 + 1).cast("int"))
    asset = F.struct(F.lit("a").alias("path"), F.lit(False).alias("inline"), F.nullif(kind, F.lit("")).alias("type"))
    cases = doc_cases(spark, sf_dir).withColumns({"has_figure": n % 2 == 0, "assets": F.array(asset)})
    return cs.validated(cases, REFERENCES, RISKY, OTHER).select("id", "title", F.array_join("warnings", ";").alias("warnings"))


@query(f"""WITH {CASES_SQL}, n AS (SELECT count(*) AS a, count(*) FILTER (WHERE errors = 0) AS b FROM v)
SELECT 0 AS nth, 'Total: ' || a || ' casos' AS line FROM n UNION ALL SELECT 1, '  Válidos: ' || b FROM n UNION ALL SELECT 2, '  Inválidos: ' || (a - b) FROM n UNION ALL SELECT 0, '  [' || id || ']' FROM v WHERE errors > 0""")
def report_text(spark, sf_dir):
    """The report's counts and the cases it names."""
    lines = cs.report_lines(cs.validated(doc_cases(spark, sf_dir), REFERENCES, RISKY, OTHER))
    return lines.where("id IS NULL OR nth = 0").select("nth", "line")


@query(f"WITH {CASES_SQL} SELECT count(*) AS n_cases, count(*) FILTER (WHERE errors = 0) AS n_valid, count(*) FILTER (WHERE errors > 0) AS n_invalid FROM v")
def case_report(spark, sf_dir):
    return cs.report(cs.validated(doc_cases(spark, sf_dir), REFERENCES, RISKY, OTHER))


@query("SELECT tag, count(*) AS n FROM (SELECT lang AS tag FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'toxic' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY tag")
def tag_histogram(spark, sf_dir):
    return cs.tag_histogram(doc_cases(spark, sf_dir))


@query(f"WITH {CASES_SQL} SELECT id, count(*) AS n FROM c GROUP BY id HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return doc_cases(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {CASES_SQL} SELECT id, 'cota de [QTY value=5 unit=mm dim=[0,1,0,0,0,0,0]]' AS marked, CAST(n AS INTEGER) AS n_answers FROM v WHERE errors = 0 AND quality = 1")
def case_compile(spark, sf_dir):
    lines = cs.compiled(cs.validated(doc_cases(spark, sf_dir), REFERENCES, RISKY, OTHER), ENGINE)
    return lines.select("id", F.get_json_object("line", "$.arms.marked").alias("marked"), F.size(F.from_json(F.get_json_object("line", "$.answers"), "ARRAY<STRUCT<name: STRING>>")).alias("n_answers"))


TOLD = {k: en.activation_prompt(k).rstrip().replace("'", "''") for k in ("en", "pt-br")}
MARKED = "cota de [QTY value=5 unit=mm dim=[0,1,0,0,0,0,0]]"


@query(f"""WITH {CASES_SQL}, w AS (SELECT *, CASE lang WHEN 'en' THEN '{TOLD['en']}' ELSE '{TOLD['pt-br']}' END AS told FROM v WHERE errors = 0 AND quality = 1)
SELECT id, title, lang AS discipline, lang AS language, source AS source_id, CASE WHEN toxic = 1 THEN lang || ',toxic' ELSE lang END AS tags, source AS norms, CAST(n AS VARCHAR) AS n_answers, 'validated' AS review_status,
  'cota de 5 mm' AS plain, told || chr(10) || chr(10) || '{MARKED}' AS prompted, told || chr(10) || chr(10) || 'cota de 5 mm' AS control,
  'system:' || told || ';user:{MARKED}' AS messages, 'system:' || told || ';user:cota de 5 mm' AS control_messages FROM w""")
def case_arms(spark, sf_dir):
    """The metadata and the other arms of case_compile's lines."""
    lines = cs.compiled(cs.validated(doc_cases(spark, sf_dir), REFERENCES, RISKY, OTHER), ENGINE)
    at = lambda path: F.get_json_object("line", f"$.{path}")
    listed = lambda path: F.array_join(F.from_json(at(path), "ARRAY<STRING>"), ",").alias(path)
    said = lambda path: F.array_join(F.transform(F.from_json(at(f"arms.{path}"), "ARRAY<STRUCT<role: STRING, content: STRING>>"), lambda m: F.concat_ws(":", m["role"], m["content"])), ";").alias(path)
    fields = [at(f).alias(f) for f in ("title", "discipline", "language", "source_id", "n_answers", "review_status")]
    return lines.select("id", *fields, listed("tags"), listed("norms"), *(at(f"arms.{a}").alias(a) for a in ("plain", "prompted", "control")), said("messages"), said("control_messages"))


@query("SELECT count(*) AS n_compiled, sha256(string_agg(sha256(n_name), chr(10) ORDER BY lpad(CAST(n_nationkey AS VARCHAR), 3, '0'))) AS checksum FROM nation")
def checksum(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("id"), F.col("n_name").alias("line"))
    return cs.manifest(lines, cs.validated(doc_cases(spark, sf_dir), REFERENCES, RISKY, OTHER)).select("n_compiled", "checksum")


NATION_FILES = {
    "references.yaml": "schema_version: '1'\nsources:\n- {id: atlas, type: book, full_citation: an atlas of nations, short_citation: atlas}\n",
    "tags_vocabulary.yaml": "schema_version: '1'\nhigh_risk_tags: {place: [nation]}\ncontextual_tags: [even]\n",
    "manifest.yaml": "schema_version: '1'\nbenchmark_version: '1.0'\nname: nations\ndescription: a case each\ncreated: '2020-01-01'\n",
}


def nation_folder(spark, sf_dir) -> str:
    """A folder of case files, one for each nation (25 rows, whatever the scale)."""
    folder = f"{shared_folder(spark)}/nations-{uuid.uuid4().hex}"
    for name, text in NATION_FILES.items():
        write_text(spark, f"{folder}/{name}", text)
    for n in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator():
        answers = [{"name": f"a{k}", "value": k, "unit": "m", "tolerance_relative": 0.1} for k in range(4 if n.n_nationkey % 5 else 3)]
        case = {
            "schema_version": "1", "id": f"geo-{n.n_nationkey}", "title": n.n_name, "metadata": {"discipline_folder": "geo", "language": "en"}, "reference": {"source_id": "atlas"},
            "tags": ["nation"] + ["even"] * (n.n_nationkey % 2 == 0), "prompt_baseline": f"the border here is {n.n_nationkey + 3} mm", "gabarito": answers, "review_status": "draft" if n.n_nationkey % 7 == 0 else "validated",
        }
        write_text(spark, f"{folder}/geo/cases/{n.n_nationkey:02d}.yaml", json.dumps(case))
    return folder


@query("""SELECT 'geo-' || n_nationkey AS id, n_name AS title, 'the border here is ' || (n_nationkey + 3) || ' mm' AS baseline, 'the border here is [QTY value=' || (n_nationkey + 3) || ' unit=mm dim=[0,1,0,0,0,0,0]]' AS modo_b,
4::BIGINT AS n_answers, 2::BIGINT AS n_messages FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0""")
def compile_all(spark, sf_dir):
    """The lines of a compiled folder of case files, read again."""
    made = benchmark.compile_all(spark, nation_folder(spark, sf_dir))
    at = lambda path: F.get_json_object("value", f"$.{path}")
    return spark.read.text(made.lines_path).select(
        at("id").alias("id"), at("title").alias("title"), at("prompts.baseline").alias("baseline"), at("prompts.modo_b").alias("modo_b"),
        F.json_array_length(at("gabarito")).cast("long").alias("n_answers"), F.json_array_length(at("messages_for_api.modo_d_activated")).cast("long").alias("n_messages"),
    )


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS compiled, count(*) FILTER (WHERE NOT ok) AS rejected, count(*) FILTER (WHERE ok) AS nation, count(*) FILTER (WHERE ok AND n_nationkey % 2 = 0) AS even, 64 AS hash_length
FROM (SELECT n_nationkey, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AS ok FROM nation)""")
def manifest(spark, sf_dir):
    """The manifest of a compiled folder, read again as JSON."""
    made = benchmark.compile_all(spark, nation_folder(spark, sf_dir))
    m = spark.read.json(made.manifest_path, multiLine=True)
    return m.select(
        F.col("n_cases_total").alias("total"), F.col("n_cases_compiled").alias("compiled"), F.col("n_cases_rejected").alias("rejected"),
        F.col("tags_stratification.nation").alias("nation"), F.col("tags_stratification.even").alias("even"), F.length("jsonl_sha256").alias("hash_length"),
    )


UNIT_FILES = {
    "main.json": '{"atoms": {"zorb": {"dim": [0, 1, 0, 0, 0, 0, 0], "factor": 2.0, "prefixes": true}, "%": {"dim": [0, 0, 0, 0, 0, 0, 0], "factor": 0.5}}}',
    "more.json": '{"atoms": {"%": {"factor": 0.01, "category": "ratio"}, "blip": {"factor": 3.0, "category": "information"}}}',
}
LOADED = [("zorb", "si", 2.0), ("kzorb", "prefixed", 2000.0), ("%", "si", 0.5), ("blip", "information", 3.0), ("mm", None, None)]


@query(f"SELECT * FROM {picked_sql('part', 'p_partkey', LOADED, 'symbol, category, factor')}")
def unit_table_load(spark, sf_dir):
    """A unit table from files: the main one wins, and one that isn't there adds nothing."""
    folder = f"{shared_folder(spark)}/units-{uuid.uuid4().hex}"
    for name, text in UNIT_FILES.items():
        write_text(spark, f"{folder}/{name}", text)
    atoms = units.load_atoms(spark, f"{folder}/main.json", (f"{folder}/none.json", f"{folder}/more.json"))
    wanted = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), [x for x, *_ in LOADED]).alias("symbol"))
    return wanted.join(F.broadcast(units.atom_table(spark, atoms)), "symbol", "left").select("p_partkey", "symbol", "category", "factor")


# ---- streams


@query("SELECT p_partkey, '[QTY value=' || p_size || ' unit=MPa dim=[1,-1,-2,0,0,0,0]]' AS tag FROM part")
def stream_regions(spark, sf_dir):
    """The parts as a file stream, to the end of what there is."""
    source = table(spark, sf_dir, "part")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/part.parquet*")
    texts = stream.select("p_partkey", part_text())
    found = st.region_stream(texts, ENGINE, fields=("type", "tag")).where("type = 'QTY'").select("p_partkey", "tag")
    return st.written(found, f"{shared_folder(spark)}/stream-regions-{uuid.uuid4().hex}")


@query("SELECT date_trunc('day', ts) AS window_start, 'QTY' AS type, count(*) AS n_regions FROM events GROUP BY 1")
def window_counts(spark, sf_dir):
    """Region counts by event-time window; on a batch the watermark has no effect."""
    texts = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.floor("value").cast("string"), F.lit(" kN")).alias("text"))
    return st.counts_by_window(texts, ENGINE, "ts", window="1 day").where("type = 'QTY'")
