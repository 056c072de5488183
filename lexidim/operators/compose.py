"""Symbolic expressions by themselves: what makes a text one, scanning for them, and clusters.

What makes an expression is a table of patterns that a text must or must not hold, the same for
columns and for plain strings; clusters are islands of atoms in a window.
"""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexidim import lexicons as lx
from lexidim.functions.text import COMPOSING_GAP, compact_expression, fills
from lexidim.units import ATOMS

# Signs that show in an expression, small raised and lowered digits, and markers of lists.
SIGNS = r"/·*\^()√∛∜×÷|⟨⟩{}\\"
RAISED = "²³⁰¹⁴⁵⁶⁷⁸⁹⁻⁺₀₁₂₃₄₅₆₇₈₉"
LIST_MARKERS = "ii iii iv vi vii viii ix"

_L = r"[\p{L}\p{M}]"
#: What a text must hold (True) or must not (False) to be an expression, in a form that both regular
#: expression engines read.
RULES = (
    # two parts: a sign, a subscript, or a digit beside a letter
    (rf"[{SIGNS}{RAISED}_]|\d\s?{_L}|{_L}\s?\d", True),
    # a sign of mathematics, a Greek letter, an argument, a compound in brackets or a differential quotient
    (rf"[_\\{RAISED}·×÷√∛∜∫∑∂∇∏∮≈≠≡≤≥⇒⇔→↔∝\dα-ωΑ-Ω]|{_L}\(|\([^()]*[+\-*/^][^()]*\)|\bd{_L}\w*\s*/\s*d{_L}", True),
    # a plain word of five letters or more that no backslash, subscript, Greek letter or argument makes a name
    (rf"(?<![\p{{L}}\p{{M}}_\\])(?:(?![α-ωΑ-Ω]){_L}){{5,}}+(?![\p{{L}}\p{{M}}_(])", False),
    # the marker of a list: one letter, or one letter again and again, or a small Roman number
    (rf"\A[() ]*(?:(\p{{L}})\1{{0,3}}|(?i:{LIST_MARKERS.replace(' ', '|')}))[() ]*\Z", False),
)
_COMPILED = [(regex.compile(p), must) for p, must in RULES]
_BETWEEN_NAMES = rf"[·*/\^(){RAISED}√∛∜∫∑∂∇∏∮×÷]+"
_NAME = r"\p{L}(?:[\p{L}\p{M}\d]|_[\p{L}\p{M}\d,]+)*"


def free_names(text: Column) -> Column:
    """The free variables of expressions: distinct, sorted; null for what is no expression."""
    t = F.btrim(text)
    holds = [t.rlike(p) if must else ~t.rlike(p) for p, must in RULES]
    parts = F.filter(F.split(t, _BETWEEN_NAMES), lambda p: p != "")
    is_unit = (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(*ATOMS))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(f"({_NAME})"), F.lit(1))))
    return F.when(reduce(Column.__and__, holds, F.length(t) >= 2) & ~is_unit & (F.size(names) > 0), names)


def tagged(text: Column) -> Column:
    """A text, with or without dollars around it, as an expression's tag if it is one or holds a
    sign of one; else as it is."""
    inner = F.btrim(F.regexp_replace(F.btrim(text), r"\A\$([\s\S]*)\$\z", "$1"))
    signed = inner.rlike(rf"[+\-*/·×÷\^=≈≤≥<>()_{RAISED}]")
    return F.when(free_names(inner).isNotNull(), F.concat(F.lit("[SYM:"), compact_expression(inner), F.lit("]"))).when(signed, F.concat(F.lit("[SYM:"), inner, F.lit("]"))).otherwise(text)


def _names(text: str) -> list[str]:
    """free_names() of one string; empty for what is no expression."""
    t = text.strip()
    if len(t) < 2 or any(bool(p.search(t)) != must for p, must in _COMPILED):
        return []
    parts = set(regex.split(_BETWEEN_NAMES, t)) - {""}
    return [] if parts and parts <= ATOMS.keys() else sorted(set(regex.findall(_NAME, t)))


_EDGES = regex.compile(r"[ \t.,;:·*/\^=≈≤≥<>]*+(?P<core>[\s\S]*?)[ \t.,;:·*/+\-\^=≈≤≥<>]*")
_DOLLARS = regex.compile(r"\$(?P<core>[^$\n]{3,}?)\$")
_SCANS = [(atomic, regex.compile(p, regex.V1)) for _, atomic, p in (*lx.EXPRESSIONS, *lx.LOOSE_EXPRESSIONS)]


def expressions(text: str, protected: list[tuple[int, int]] = ()) -> list[tuple[int, int, list[str]]]:
    """(start, end, free variables) of expressions, in dollars or by any pattern; of overlapping ones
    the longest. Protected spans part what is found, but for patterns that take in what they hold."""
    shut = sorted(protected)
    found = [(*m.span(), _names(m["core"])) for m in _DOLLARS.finditer(text)]
    for atomic, pattern in _SCANS:
        for m in pattern.finditer(text):
            inside = [] if atomic else [(max(s, m.start()), min(e, m.end())) for s, e in shut if s < m.end() and e > m.start()]
            cuts = [m.start(), *(x for span in inside for x in span), m.end()]
            for low, high in zip(cuts[::2], cuts[1::2]):
                core = _EDGES.fullmatch(text, low, max(low, high))
                found.append((*core.span("core"), _names(core["core"])))
    out: list[tuple[int, int, list[str]]] = []
    for s, e, names in sorted((f for f in found if f[2]), key=lambda f: (f[0] - f[1], f[0])):
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, names))
    return sorted(out)


def clusters(atoms: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, start, end of the islands of atoms that composing operators join: two or more terms,
    two of them neither quantities nor operators; relations part them. atoms: keys, the text, and
    start, end and type of each, disjoint."""
    line = Window.partitionBy(*keys).orderBy("start")
    content = F.substring(text_col, F.col("start") + 1, F.col("end") - F.col("start"))
    own = atoms.withColumn("_sign", F.when(F.col("type") == "OP", content))
    gap = F.substring(text_col, F.lag("end").over(line) + 1, F.col("start") - F.lag("end").over(line))
    joint = F.coalesce(F.when(F.lag("type").over(line) == "OP", F.lag("_sign").over(line)), F.col("_sign"))
    joins = fills(gap, COMPOSING_GAP) | ((F.btrim(gap) == "") & fills(F.coalesce(joint, F.lit("")), COMPOSING_GAP))
    island = F.sum(F.when(joins, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    grouped = own.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(F.col("type") != "OP").alias("_terms"), F.count_if(~F.col("type").isin("OP", "QTY")).alias("_symbols")
    )
    return grouped.where("_terms >= 2 AND _symbols >= 2").select(*keys, "start", "end")
