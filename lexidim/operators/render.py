"""Regions as tags: B (bracketed) and A (marked up)."""

from __future__ import annotations

from typing import NamedTuple

import regex

from lexidim import lexicons as lx
from lexidim.functions.numbers import NumberError, format_value, grouped, number_value, parsed_number
from lexidim.functions.text import slug
from lexidim.operators.scan import Region, kept
from lexidim.units import UnitError, combined, parse, si_unit

_AMOUNT = regex.compile(rf"(?P<a>{lx.NUMBER})(?:\s*-\s*(?P<b>{lx.NUMBER}))?(?:{lx.UNCERTAINTY}(?P<u>{lx.NUMBER}))?\s*(?P<unit>.+)", regex.S)
_CONSTANTS = lx.Lexicons().values_of_constants()


class Quantity(NamedTuple):
    """A parsed quantity: what is given, its terms, and where all atoms are known its SI form."""

    raw: str
    value: float | None
    uncertainty: float | None
    unit: str
    terms: list[tuple[str, int]]
    dim: tuple[int, ...] | None = None
    factor: float | None = None
    si_unit: str | None = None
    si_value: float | None = None
    si_uncertainty: float | None = None


#: Units of the own table read before, within a worker.
_UNITS: dict[str, tuple] = {}


def unit_of(unit: str, atoms: dict | None) -> tuple:
    """Terms, dimension and factor, and SI unit."""
    return kept(_UNITS, unit, lambda u: _unit_of(u, None)) if atoms is None else _unit_of(unit, atoms)


def _unit_of(unit: str, atoms: dict | None) -> tuple:
    terms = parse(unit, atoms)
    si = combined(terms, atoms)
    return tuple(terms), si, si_unit(si[0]) if si else None


def parsed_quantity(raw: str, value: float | None, uncertainty: float | None, unit: str, atoms: dict | None = None) -> Quantity:
    terms, si, name = unit_of(unit, atoms)
    if not si:
        return Quantity(raw, value, uncertainty, unit, list(terms))
    scaled = lambda x: None if x is None else x * si[1]
    return Quantity(raw, value, uncertainty, unit, list(terms), si[0], si[1], name, scaled(value), scaled(uncertainty))


def quantities(content: str, atoms: dict | None = None) -> list[Quantity]:
    """The quantities that a text states: one, a unit by itself, or both ends of a range."""
    m = _AMOUNT.fullmatch(content.strip())
    if not m or regex.fullmatch(r"[\p{L}%‰°(].*", content.strip()):
        return [parsed_quantity(content, None, None, content.strip(), atoms)]
    spread = number_value(m["u"]) if m["u"] else None
    return [parsed_quantity(content, number_value(m[k]), spread, m["unit"].strip(), atoms) for k in ("a", "b") if m[k]]


def one_quantity(q: Quantity, region: Region, mode: str) -> str:
    if mode == "B":
        parts = []
        if q.value is not None:
            parts.append(f"value={format_value(q.value)}")
            if grouped(q.value):
                parts.append(f'r2l="{grouped(q.value)}"')
        parts.append(f"unit={q.unit}")
        if q.dim:
            parts.append("dim=[" + ",".join(map(str, q.dim)) + "]")
        if q.uncertainty is not None:
            parts.append(f"unc={format_value(q.uncertainty)}")
        if region.ambig:
            parts += [f'ambig="{region.ambig}"', f'alternatives="{"|".join(region.alternatives)}"']
        return f"[QTY {' '.join(parts)}]"
    value, spread = (q.si_value, q.si_uncertainty) if q.dim else (q.value, q.uncertainty)
    name = q.si_unit or "·".join(s if p == 1 else f"{s}^{p}" for s, p in q.terms)
    amount = "<VAL/>" if value is None else f"<VAL>{format_value(value)}</VAL>"
    return f"<QTY>{amount}<DIM>{name}</DIM>{'<UNC/>' if spread is None else f'<UNC>{format_value(spread)}</UNC>'}</QTY>"


def quantity(content: str, region: Region, mode: str, atoms: dict | None = None) -> str:
    return "-".join(one_quantity(q, region, mode) for q in quantities(content, atoms))


def number(content: str, mode: str) -> str:
    value, locale, kind = parsed_number(content)
    if mode == "A":
        return f"<NUM>{format_value(value)}</NUM>"
    r2l = f' r2l="{grouped(value)}"' if grouped(value) else ""
    return f'[NUM value={format_value(value)}{r2l} locale={locale} repr={kind} original="{content}"]'


def tag(region: Region, text: str, mode: str = "B", atoms: dict | None = None, constants: dict = _CONSTANTS) -> tuple[str, str | None]:
    """The tag and no error, or the text as it is and the error: no row fails."""
    content = text[region.start : region.end]
    try:
        if region.type == "QTY":
            return quantity(content, region, mode, atoms), None
        if region.type == "NUM":
            return number(content, mode), None
    except (UnitError, NumberError, OverflowError, ZeroDivisionError) as e:
        return content, str(e)
    if region.type == "CONST":
        if mode == "B":
            return f"[CONST:{content}]", None
        unit, value = constants[content]
        return f"<CONST><SYM>{content}</SYM><QTY><VAL>{format_value(value)}</VAL><DIM>{unit}</DIM><UNC/></QTY></CONST>", None
    if region.type == "REF":
        return (f"[REF:{content}]" if mode == "B" else f"<REF>{content}</REF>"), None
    if region.type == "IDX":
        name = region.slug or slug(content)
        return (f"[IDX:{name}]" if mode == "B" else f"<ID>{name}</ID>"), None
    if region.type == "SYM":
        return f"[SYM:{content.replace(' ', '').rstrip('.,;:')}]", None
    return content, None


def rendered(text: str, found: list[Region], mode: str = "B", encode=None, atoms: dict | None = None, constants: dict = _CONSTANTS) -> tuple[str, list[str]]:
    """The text with its regions as tags, and the errors. In mode A prose goes through encode."""
    out, errors, at = [], [], 0
    for r in found:
        out.append(text[at : r.start])
        if r.type == "PROSE" and mode == "A":
            if encode is None:
                raise NotImplementedError("mode A needs an encoder for prose")
            out.append(" ".join(map(str, encode(text[r.start : r.end]))))
        else:
            piece, error = tag(r, text, mode, atoms, constants)
            out.append(piece)
            if error:
                errors.append(error)
        at = r.end
    return "".join(out) + text[at:], errors
