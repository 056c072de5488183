"""Units: a table of atoms with SI dimension vectors, parsing, composition and conversion.

Dimensions are exponents of kg, m, s, A, K, mol, cd. Distinct unit strings are few in any corpus, so
they are parsed once and joined back; composition and conversion are plain expressions over that.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.lexicons import UNIT_ALIASES

BASE = ("kg", "m", "s", "A", "K", "mol", "cd")
PREFIXES = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "µ": -6, "μ": -6, "n": -9, "p": -12, "f": -15, "a": -18, "z": -21, "y": -24}

# Atoms that take SI prefixes (symbol, dimension, factor).
PREFIXABLE = (
    ("m", "m", 1.0), ("g", "kg", 1e-3), ("s", "s", 1.0), ("A", "A", 1.0), ("K", "K", 1.0), ("mol", "mol", 1.0), ("cd", "cd", 1.0),
    ("Hz", "s-1", 1.0), ("N", "kg m s-2", 1.0), ("Pa", "kg m-1 s-2", 1.0), ("J", "kg m2 s-2", 1.0), ("W", "kg m2 s-3", 1.0),
    ("C", "A s", 1.0), ("V", "kg m2 s-3 A-1", 1.0), ("F", "kg-1 m-2 s4 A2", 1.0), ("Ω", "kg m2 s-3 A-2", 1.0), ("S", "kg-1 m-2 s3 A2", 1.0),
    ("Wb", "kg m2 s-2 A-1", 1.0), ("T", "kg s-2 A-1", 1.0), ("H", "kg m2 s-2 A-2", 1.0), ("lm", "cd", 1.0), ("lx", "cd m-2", 1.0),
    ("Bq", "s-1", 1.0), ("Gy", "m2 s-2", 1.0), ("Sv", "m2 s-2", 1.0), ("L", "m3", 1e-3), ("l", "m3", 1e-3), ("bar", "kg m-1 s-2", 1e5),
    ("eV", "kg m2 s-2", 1.602176634e-19), ("cal", "kg m2 s-2", 4.184), ("VA", "kg m2 s-3", 1.0), ("VAR", "kg m2 s-3", 1.0), ("var", "kg m2 s-3", 1.0), ("Wh", "kg m2 s-2", 3600.0),
)

# Atoms without prefixes (symbol, dimension, factor).
PLAIN = (
    ("t", "kg", 1e3), ("tonelada", "kg", 1e3), ("lb", "kg", 0.45359237), ("oz", "kg", 0.028349523125), ("slug", "kg", 14.593902937206364),
    ("min", "s", 60.0), ("h", "s", 3600.0), ("dia", "s", 86400.0), ("ano", "s", 31557600.0), ("day", "s", 86400.0), ("year", "s", 31557600.0),
    ("in", "m", 0.0254), ("ft", "m", 0.3048), ("yd", "m", 0.9144), ("mi", "m", 1609.344), ("nmi", "m", 1852.0), ("Å", "m", 1e-10), ("ha", "m2", 1e4),
    ("gal", "m3", 0.003785411784), ("°C", "K", 1.0), ("ºC", "K", 1.0), ("°F", "K", 5 / 9), ("°R", "K", 5 / 9),
    ("gf", "kg m s-2", 9.80665e-3), ("kgf", "kg m s-2", 9.80665), ("tf", "kg m s-2", 9806.65), ("lbf", "kg m s-2", 4.4482216152605), ("kip", "kg m s-2", 4448.2216152605), ("dyn", "kg m s-2", 1e-5),
    ("psi", "kg m-1 s-2", 6894.757293168361), ("ksi", "kg m-1 s-2", 6894757.293168361), ("atm", "kg m-1 s-2", 101325.0), ("torr", "kg m-1 s-2", 133.32236842105263),
    ("mHg", "kg m-1 s-2", 133322.387415), ("cmHg", "kg m-1 s-2", 1333.22387415), ("mmHg", "kg m-1 s-2", 133.322387415), ("inHg", "kg m-1 s-2", 3386.388640341), ("ftHg", "kg m-1 s-2", 40636.663684092),
    ("mH2O", "kg m-1 s-2", 9806.65), ("cmH2O", "kg m-1 s-2", 98.0665), ("mmH2O", "kg m-1 s-2", 9.80665), ("inH2O", "kg m-1 s-2", 249.08891), ("ftH2O", "kg m-1 s-2", 2989.06692),
    ("BTU", "kg m2 s-2", 1055.05585262), ("Btu", "kg m2 s-2", 1055.05585262), ("cv", "kg m2 s-3", 735.49875), ("CV", "kg m2 s-3", 735.49875), ("HP", "kg m2 s-3", 745.6998715822702), ("hp", "kg m2 s-3", 745.6998715822702),
    ("rpm", "s-1", 0.10471975511965977), ("rps", "s-1", 6.283185307179586), ("P", "kg m-1 s-1", 0.1), ("cP", "kg m-1 s-1", 1e-3), ("St", "m2 s-1", 1e-4), ("cSt", "m2 s-1", 1e-6),
)

# Ratios, levels and angles (symbol, category, factor). ppt is 1e-12 here.
DIMENSIONLESS = (
    ("%", "ratio", 0.01), ("percent", "ratio", 0.01), ("‰", "ratio", 0.001), ("permille", "ratio", 0.001), ("ppm", "ratio", 1e-6), ("ppb", "ratio", 1e-9), ("ppt", "ratio", 1e-12),
    ("dB", "logarithmic_ratio", 1.2589254117941673), ("decibel", "logarithmic_ratio", 1.2589254117941673), ("Np", "logarithmic_ratio", 7.38905609893065), ("neper", "logarithmic_ratio", 7.38905609893065),
    ("rad", "angle", 1.0), ("radian", "angle", 1.0), ("°", "angle", 0.017453292519943295), ("deg", "angle", 0.017453292519943295), ("degree", "angle", 0.017453292519943295), ("angular_degree", "angle", 0.017453292519943295),
    ("gon", "angle", 0.015707963267948967), ("gradian", "angle", 0.015707963267948967), ("arcmin", "angle", 0.0002908882086657216), ("arcminute", "angle", 0.0002908882086657216), ("arc_minute", "angle", 0.0002908882086657216),
    ("angular_minute", "angle", 0.0002908882086657216), ("arcsec", "angle", 4.84813681109536e-06), ("arcsecond", "angle", 4.84813681109536e-06), ("arc_second", "angle", 4.84813681109536e-06), ("angular_second", "angle", 4.84813681109536e-06),
    ("sr", "solid_angle", 1.0), ("steradian", "solid_angle", 1.0), ("sq_deg", "solid_angle", 0.00030461741978670857), ("sqdeg", "solid_angle", 0.00030461741978670857), ("square_degree", "solid_angle", 0.00030461741978670857),
    ("pixel", "visualization", 1.0), ("dot", "visualization", 1.0), ("bpp", "color_depth", 1.0), ("bits_per_pixel", "color_depth", 1.0),
    ("DPI", "visual_density", 39.37007874015748), ("PPI", "visual_density", 39.37007874015748), ("ppi", "visual_density", 39.37007874015748), ("dots_per_inch", "visual_density", 39.37007874015748),
    ("pixels_per_inch", "visual_density", 39.37007874015748), ("printers_dpi", "visual_density", 39.37007874015748), ("PPCM", "visual_density", 100.0), ("pixels_per_centimeter", "visual_density", 100.0),
)

#: Symbols that prefixes would make and that are words or letters of another meaning.
NOT_UNITS = frozenset("a c d π pi e dpi as da das dos ah am pé na no nas nos em Em ha hm mas mil Pas Mas cal".split()) - {"ha", "cal", "hm"}

# Names of derived units by dimension.
DERIVED = {
    "kg": "kg", "m": "m", "s": "s", "A": "A", "K": "K", "mol": "mol", "cd": "cd", "kg m s-2": "N", "kg m-1 s-2": "Pa", "kg m2 s-2": "J", "kg m2 s-3": "W",
    "s-1": "Hz", "A s": "C", "kg m2 s-3 A-1": "V", "kg-1 m-2 s4 A2": "F", "kg m2 s-3 A-2": "Ω", "kg-1 m-2 s3 A2": "S", "kg m2 s-2 A-1": "Wb",
    "kg s-2 A-1": "T", "kg m2 s-2 A-2": "H", "kg m-1 s-1": "Pa·s", "m s-1": "m/s", "m s-2": "m/s²", "m2": "m²", "m3": "m³",
}

ZERO = (0,) * 7
SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−", "0123456789-+-")


def dimension(text: str) -> tuple[int, ...]:
    out = dict.fromkeys(BASE, 0)
    for part in text.split():
        name, power = re.fullmatch(r"([A-Za-z]+)(-?\d+)?", part).groups()
        out[name] += int(power or 1)
    return tuple(out.values())


def _atoms() -> dict[str, tuple[tuple[int, ...], float, str]]:
    """symbol -> (dimension, factor, category). Explicit symbols come before prefixed ones, and
    dimensioned ones before information units and ratios."""
    out: dict[str, tuple] = {s: (dimension(d), f, "si") for s, d, f in (*PREFIXABLE, *PLAIN)}
    for s, d, f in PREFIXABLE:
        for p, n in PREFIXES.items():
            if p + s not in out and p + s not in NOT_UNITS:
                out[p + s] = (dimension(d), float(f"{f!r}e{n}") if "e" not in repr(f) else f * 10.0**n, "prefixed")
    bits = {"bit": 1.0, "byte": 8.0, "octet": 8.0}
    for k, (p, name, binary) in enumerate((("k", "kilo", "kibi"), ("M", "mega", "mebi"), ("G", "giga", "gibi"), ("T", "tera", "tebi"), ("P", "peta", "pebi")), 1):
        for unit, n in (("bit", 1.0), ("byte", 8.0)):
            bits |= {name + unit: n * 1000.0**k, binary + unit: n * 1024.0**k}
        bits |= {p + "bit": 1000.0**k, p + "B": 8 * 1000.0**k, p.upper() + "ibit": 1024.0**k, p.upper() + "iB": 8 * 1024.0**k}
    for s, f in bits.items():
        out.setdefault(s, (ZERO, f, "information"))
    for s, c, f in DIMENSIONLESS:
        out.setdefault(s, (ZERO, f, c))
    return out


ATOMS = _atoms()
NAMES = {dimension(d): n for d, n in DERIVED.items()}


def trie(symbols) -> str:
    """A pattern that matches the longest symbol first, with shared beginnings written once."""
    root: dict = {}
    for s in symbols:
        node = root
        for c in s:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(c) + pattern(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in node else body

    return pattern(root)


class UnitError(ValueError):
    pass


POWER = re.compile(r"\^?([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+|[-−]?\d+)")


def parse(unit: str | None, atoms: dict | None = None, aliases: dict[str, str] = UNIT_ALIASES) -> list[tuple[str, int]]:
    """(symbol, power) terms. A division inverts the next factor only, a group as a whole; a blank
    before a symbol or a group multiplies."""
    text = (unit or "").strip()
    if not text:
        raise UnitError("empty unit")
    text = aliases.get(text, text)
    table = ATOMS if atoms is None else atoms
    if text in table:
        return [(text, 1)]
    at, n = 0, len(text)

    def symbol() -> str:
        nonlocal at
        for end in range(min(n, at + 24), at, -1):  # an atom that holds digits or marks
            if text[at:end] in table and not (end < n and text[end].isalpha() and text[end - 1].isalpha()):
                found, at = text[at:end], end
                return found
        end = at
        while end < n and (text[end].isalpha() and text[end] not in "ªº" or text[end] in "%‰°_"):
            end += 1
        if end == at:
            raise UnitError(f"symbol expected in {text!r} at {at}")
        found, at = text[at:end], end
        return found

    def factor(sign: int) -> list[tuple[str, int]]:
        nonlocal at
        while at < n and text[at] == " ":
            at += 1
        if at < n and text[at] == "(":
            at += 1
            inner = composition(sign)
            if at >= n or text[at] != ")":
                raise UnitError(f"')' expected in {text!r} at {at}")
            at += 1
            return inner
        name, power = symbol(), 1
        if m := POWER.match(text, at):
            power, at = int(m[1].translate(SUPERSCRIPT)), m.end()
        elif at < n and text[at] == "^":
            raise UnitError(f"exponent without digits in {text!r} at {at}")
        return [(name, power * sign)]

    def composition(sign: int) -> list[tuple[str, int]]:
        nonlocal at
        terms = factor(sign)
        while True:
            blank = at
            while at < n and text[at] == " ":
                at += 1
            c = text[at] if at < n else ""
            if c and c in "·*/":
                at += 1
                terms += factor(-sign if c == "/" else sign)
            elif at > blank and c and (c.isalpha() or c in "(°"):
                terms += factor(sign)
            else:
                return terms

    terms = composition(1)
    if at < n:
        raise UnitError(f"unexpected {text[at]!r} in {text!r} at {at}")
    return terms


def combined(terms, atoms: dict | None = None) -> tuple[tuple[int, ...], float] | None:
    """Dimension and factor, or None if an atom is unknown."""
    table = ATOMS if atoms is None else atoms
    dim, factor = list(ZERO), 1.0
    for symbol, power in terms:
        if symbol not in table:
            return None
        d, f, _ = table[symbol]
        dim = [a + b * power for a, b in zip(dim, d)]
        factor *= f**power
    return (tuple(dim), factor) if terms else None


def si_unit(dim: tuple[int, ...]) -> str:
    if dim in NAMES:
        return NAMES[dim]
    return "·".join(b if p == 1 else f"{b}^{p}" for b, p in zip(BASE, dim) if p)


def convert(value: float, source: str, target: str) -> float:
    """Multiplicative conversion (temperatures as differences)."""
    a, b = combined(parse(source)), combined(parse(target))
    if a is None or b is None:
        raise UnitError("unknown unit")
    if a[0] != b[0]:
        raise UnitError("incompatible dimensions")
    return value * a[1] / b[1]


# ---- tables from files

#: SI unit of each category of auxiliary atoms, all of dimension zero.
AUXILIARY_UNITS = {"ratio": "1", "logarithmic_ratio": "1", "angle": "rad", "solid_angle": "sr", "information": "bit", "visualization": "pixel", "visual_density": "pixel/m", "color_depth": "bit/pixel", "info_other": "1"}


def read_atoms(spark: SparkSession, path: str) -> dict:
    """The entries of a unit table's JSON file, at any place that Spark reads; none if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        (row,) = spark.read.text(path, wholetext=True).collect()  # one configuration file
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return json.loads(row.value).get("atoms", {})


def load_atoms(spark: SparkSession, main: str, auxiliaries: tuple[str, ...] = ()) -> dict[str, tuple[tuple[int, ...], float, str]]:
    """Atoms of a main file (dim, factor, optionally prefixes: true) and of auxiliary files (factor,
    category; dimension zero). The main file must be there and wins over auxiliaries, of which later
    ones win over earlier; SI prefixes make more of those that take them, where no symbol is given."""
    own = read_atoms(spark, main)
    if not own:
        raise FileNotFoundError(f"no unit table at {main}")
    out: dict[str, tuple] = {}
    for path in auxiliaries:
        out |= {s: (ZERO, float(e["factor"]), e.get("category", "other")) for s, e in read_atoms(spark, path).items()}
    out |= {s: (tuple(e["dim"]), float(e["factor"]), e.get("category", "si")) for s, e in own.items()}
    for s, e in own.items():
        for p, n in PREFIXES.items() if e.get("prefixes") else ():
            out.setdefault(p + s, (tuple(e["dim"]), float(e["factor"]) * 10.0**n, "prefixed"))
    return out


def load_aliases(spark: SparkSession, path: str) -> dict[str, str]:
    """Whole unit strings that stand for others, from a JSON file; the file must be there."""
    (row,) = spark.read.text(path, wholetext=True).collect()  # one configuration file
    found = json.loads(row.value)["string_aliases"]
    if bad := sorted(a for a, c in found.items() if not a or not c):
        raise ValueError(f"empty aliases {bad}")
    return found


# ---- as DataFrames


def atom_table(spark: SparkSession, atoms: dict | None = None) -> DataFrame:
    """symbol, dim, factor, category: a few thousand rows at most, whatever the corpus."""
    return spark.createDataFrame([(s, list(d), f, c) for s, (d, f, c) in (atoms or ATOMS).items()], "symbol STRING, dim ARRAY<INT>, factor DOUBLE, category STRING")


def prefixed_atoms(spark: SparkSession) -> DataFrame:
    """Prefixes times prefixable atoms, less the symbols that are atoms themselves."""
    bases = spark.createDataFrame([(s, f) for s, _, f in PREFIXABLE], "symbol STRING, factor DOUBLE")
    prefixes = spark.createDataFrame(list(PREFIXES.items()), "prefix STRING, power INT")
    explicit = spark.createDataFrame([(s,) for s, *_ in (*PREFIXABLE, *PLAIN)] + [(s,) for s in sorted(NOT_UNITS)], "symbol STRING")
    made = bases.crossJoin(F.broadcast(prefixes)).select(F.concat("prefix", "symbol").alias("symbol"), (F.col("factor") * F.pow(F.lit(10.0), "power")).alias("factor"))
    return made.join(F.broadcast(explicit), "symbol", "left_anti")


def normalized(unit: Column) -> Column:
    """The unit with whole-string aliases replaced."""
    aliases = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(aliases, unit), unit)


TERMS = "ARRAY<STRUCT<symbol: STRING, power: INT>>"


def parsed(unit: Column | str) -> Column:
    """STRUCT<terms, error> of a unit string, in Arrow batches."""

    def terms_of(text):
        try:
            return {"terms": [{"symbol": s, "power": p} for s, p in parse(text)], "error": None}
        except UnitError as e:
            return {"terms": None, "error": str(e)}

    return F.udf(terms_of, f"STRUCT<terms: {TERMS}, error: STRING>", useArrow=True)(unit)


def described_units(units: DataFrame, unit_col: str = "unit") -> DataFrame:
    """unit, terms, dim, factor, si_unit, error of each distinct unit string: parsed once each,
    composed by a join with the atoms and sums over the terms."""
    spark = units.sparkSession
    once = units.select(F.col(unit_col).alias("unit")).distinct().withColumn("p", parsed("unit"))
    terms = once.select("unit", F.posexplode("p.terms").alias("pos", "t")).select("unit", "pos", F.col("t.symbol").alias("symbol"), F.col("t.power").alias("power"))
    looked = terms.join(F.broadcast(atom_table(spark)), "symbol", "left")
    dims = [F.sum(F.col("dim")[k] * F.col("power")).cast("int").alias(f"d{k}") for k in range(7)]
    sums = looked.groupBy("unit").agg(F.max(F.col("dim").isNull()).alias("unknown"), F.product(F.pow("factor", F.col("power"))).alias("factor"), *dims)
    sums = sums.withColumnRenamed("unit", "_of")
    known = ~F.coalesce(F.col("unknown"), F.lit(True))
    dim = F.when(known, F.array(*(F.col(f"d{k}") for k in range(7))))
    return once.join(sums, F.col("unit").eqNullSafe(F.col("_of")), "left").select(
        "unit", F.col("p.terms").alias("terms"), dim.alias("dim"), F.when(known, F.col("factor")).alias("factor"),
        F.when(known, si_name(dim)).alias("si_unit"), F.coalesce("p.error", F.when(~known, F.lit("unknown unit"))).alias("error"),
    )


def si_name(dim: Column) -> Column:
    """The name of a dimension, or base units with powers joined by a dot."""
    names = F.create_map(*[F.lit(x) for d, n in NAMES.items() for x in (",".join(map(str, d)), n)])
    parts = F.filter(F.array(*(F.when(dim[k] != 0, F.when(dim[k] == 1, F.lit(b)).otherwise(F.concat(F.lit(b + "^"), dim[k].cast("string")))) for k, b in enumerate(BASE))), lambda x: x.isNotNull())
    return F.coalesce(F.element_at(names, F.array_join(dim, ",")), F.array_join(parts, "·"))


def dim_text(dim: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(dim.cast("array<string>"), ","), F.lit("]"))


#: Distinct unit strings that are looked up as a small table; beyond that they are joined as they come.
FEW_UNITS = 10_000
LOOKUP = "unit STRING, dim ARRAY<INT>, factor DOUBLE, si_unit STRING, error STRING"


def unit_lookup(df: DataFrame, unit_cols: list[str]) -> DataFrame:
    """LOOKUP of the distinct strings of some columns: as a local table if there are few, so that
    joins with it need no exchange."""
    strings = df.select(F.explode(F.array(*unit_cols)).alias("unit"))
    known = described_units(strings).select("unit", "dim", "factor", "si_unit", "error")
    some = known.limit(FEW_UNITS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(some, LOOKUP)) if len(some) <= FEW_UNITS else known


def with_units(df: DataFrame, unit_cols: dict[str, str]) -> DataFrame:
    """df with dim, factor, si_unit and error of unit columns, named by the key of each."""
    known = unit_lookup(df, list(unit_cols.values()))
    for prefix, unit_col in unit_cols.items():
        own = known.select(F.col("unit").alias("_unit"), *(F.col(c).alias(prefix + c) for c in ("dim", "factor", "si_unit", "error")))
        df = df.join(own, df[unit_col].eqNullSafe(own["_unit"]), "left").drop("_unit")
    return df


def with_unit(df: DataFrame, unit_col: str, prefix: str = "") -> DataFrame:
    """df with dim, factor, si_unit and error of its unit column."""
    return with_units(df, {prefix: unit_col})


def conversions(df: DataFrame, wanted: list[tuple[str, str, str, str]]) -> DataFrame:
    """df with a struct (value, error) for each (value column, from column, to column, name):
    incompatible or unknown units give null and the error. All units are looked up at once."""
    both = with_units(df, {f"_{side}{k}_": w[1 + side] for k, w in enumerate(wanted) for side in (0, 1)})
    made = {}
    for k, (value_col, _, _, name) in enumerate(wanted):
        a, b = f"_0{k}_", f"_1{k}_"
        same = F.col(a + "dim") == F.col(b + "dim")
        value = F.when(same, F.col(value_col) * F.col(a + "factor") / F.col(b + "factor"))
        made[name] = F.struct(value.alias("value"), F.coalesce(a + "error", b + "error", F.when(~same, F.lit("incompatible dimensions"))).alias("error"))
    return both.select(*df.columns, *(c.alias(n) for n, c in made.items()))


def converted(df: DataFrame, value_col: str, from_col: str, to_col: str) -> DataFrame:
    """df with `converted` and `error`; incompatible or unknown units give null and the error."""
    made = conversions(df, [(value_col, from_col, to_col, "_made")])
    return made.withColumns({"converted": F.col("_made.value"), "error": F.col("_made.error")}).drop("_made")


def si_sums(df: DataFrame, value_col: str, unit_col: str) -> DataFrame:
    """si_unit, total and n of the values of known units: summed by unit, then looked up."""
    by_unit = df.groupBy(F.col(unit_col).alias("unit")).agg(F.sum(value_col).alias("_sum"), F.count("*").alias("_n"))
    known = with_unit(by_unit, "unit").where("factor IS NOT NULL")
    return known.groupBy("si_unit").agg(F.sum(F.col("_sum") * F.col("factor")).alias("total"), F.sum("_n").alias("n"))


def audited(spark: SparkSession, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """expected (symbol, dim, factor) with status OK, DIFF or SKIP against our atoms."""
    ours = atom_table(spark).select("symbol", F.col("dim").alias("_dim"), F.col("factor").alias("_factor"))
    near = F.abs(F.col("factor") - F.col("_factor")) / F.greatest(F.abs("factor"), F.lit(1e-30)) <= tolerance
    status = F.when(F.col("_factor").isNull(), "SKIP").when(near & (F.col("dim") == F.col("_dim")), "OK").otherwise("DIFF")
    return expected.join(F.broadcast(ours), "symbol", "left").withColumn("status", status).drop("_dim", "_factor")
