"""Numbers as they are written: separators, exponents, kinds and texts, as column expressions.

Each function has a plain Python counterpart, used where a row is already in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexidim.lexicons import SUPERSCRIPTS

_UP = SUPERSCRIPTS + "⁻⁺−"
_DOWN = "0123456789-+-"
_TRANSLATE = str.maketrans(_UP, _DOWN)
_BARE = r"^\s*([+-]?)10([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)\s*$"
_RAISED = r"\s*[×x·*]\s*10\s*([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)"
_CARET = r"\s*[×x·*]\s*10\s*\^\s*\(?\s*([+-]?\d+)\s*\)?"
_SCIENTIFIC = r"[eE][+-]?\d|[×x·*]\s*10|^[+\-−]?10[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]"


class NumberError(ValueError):
    pass


# ---- plain


def decimal_text(s: str) -> str:
    """A decimal with whichever separators, as text with a point."""
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        mark = max(s.rfind("."), s.rfind(","))
        return re.sub(r"[.,]", "", s[:mark]) + "." + s[mark + 1 :]
    if dots > 1:
        return s.replace(".", "")
    if commas > 1:
        return s.replace(",", "")
    if dots and re.fullmatch(r"[+-]?(?!0\.)\d+\.\d{3}", s):
        return s.replace(".", "")
    return s.replace(",", ".")


def with_exponent(raw: str) -> str:
    s = raw.strip().replace("−", "-")
    s = re.sub(_BARE, r"\g<1>1e\g<2>", s)
    s = re.sub(_CARET, r"e\1", re.sub(_RAISED, r"e\1", s))
    return s.translate(_TRANSLATE).replace(" ", "")


def number_value(raw: str | None) -> float:
    return _value(raw, False)


def _value(raw: str | None, pointed: bool) -> float:
    """pointed: a single point in a mantissa is a decimal point, whatever follows it."""
    mantissa, _, exponent = with_exponent(raw or "").lower().partition("e")
    try:
        if not (pointed and re.fullmatch(r"[+-]?\d+\.\d+", mantissa)):
            mantissa = decimal_text(mantissa)
        return float(mantissa + ("e" + exponent if exponent else ""))
    except ValueError:
        raise NumberError(f"not a number: {raw!r}") from None


def locale_of(raw: str) -> str:
    if "," in raw and "." in raw:
        return "pt-br" if raw.rfind(",") > raw.rfind(".") else "en"
    if "," in raw:
        return "en" if raw.count(",") > 1 else "pt-br"
    if "." in raw:
        return "pt-br" if re.fullmatch(r"[+\-−]?[1-9]\d{0,2}(\.\d{3})+", raw) else "en"
    return "none"


def kind_of(raw: str) -> str:
    if raw[-1:] in ("ª", "º"):
        return "ordinal"
    if raw.endswith("%"):
        return "percentual"
    if re.fullmatch(r"[+\-−]?\d+\s*/\s*\d+", raw):
        return "fracionaria"
    if re.search(_SCIENTIFIC, raw):
        return "cientifica"
    return "decimal" if "," in raw or "." in raw else "inteira"


def format_value(value: float | None) -> str:
    if value is None:
        return ""
    if value == value // 1 and abs(value) < 1e15:
        return str(int(value))
    if abs(value) >= 1e6 or abs(value) < 1e-3:
        return f"{value:.6g}"
    return repr(value)


def grouped(value: float | None) -> str | None:
    """The integer digits in threes from the right, from a thousand up; or None."""
    if value is None or not 1000 <= abs(value) < 1e15:
        return None
    whole, _, rest = (str(int(value)) if value == value // 1 else repr(value)).partition(".")
    return f"{int(whole):,}".replace(",", " ") + ("." + rest if rest else "")


def parsed_number(raw: str) -> tuple[float, str, str]:
    """(value, locale, kind) of a number by itself: percents are parts of one, fractions divided."""
    text, kind = raw.strip(), kind_of(raw.strip())
    if kind == "ordinal":
        return number_value(text[:-1]), "none", kind
    if kind == "percentual":
        return number_value(text[:-1]) / 100, locale_of(text[:-1]), kind
    if kind == "fracionaria":
        above, below = (number_value(x) for x in text.split("/"))
        if below == 0:
            raise NumberError("division by zero")
        return above / below, "none", kind
    if kind == "cientifica":
        return _value(text, True), "en" if "." in text and "," not in text else locale_of(re.split(r"\s*[eE×x·*]", text)[0]), kind
    return number_value(text), locale_of(text), kind


# ---- columns


def col_decimal_text(s: Column) -> Column:
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    plain = F.regexp_replace(s, "[.,]", "")
    last_comma = F.regexp_replace(F.regexp_replace(s, r"\.(?=.*,)|,(?=.*,)", ""), ",", ".")
    last_dot = F.regexp_replace(s, r",(?=.*\.)|\.(?=.*\.)", "")
    comma_last = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    return (
        F.when((dots > 0) & (commas > 0), F.when(comma_last, last_comma).otherwise(last_dot))
        .when((dots > 1) | (commas > 1), plain)
        .when((dots == 1) & s.rlike(r"^[+-]?(?!0\.)\d+\.\d{3}$"), plain)
        .otherwise(F.replace(s, F.lit(","), F.lit(".")))
    )


def col_with_exponent(raw: Column) -> Column:
    s = F.regexp_replace(F.translate(F.trim(raw), "−", "-"), _BARE, "$11e$2")
    s = F.regexp_replace(F.regexp_replace(s, _RAISED, "e$1"), _CARET, "e$1")
    return F.lower(F.translate(F.translate(s, _UP, _DOWN), " ", ""))


def bound(value: Column, made) -> Column:
    """made(value), with value computed once however often made uses it."""
    return F.get(F.transform(F.array(value), made), 0)


def canonical_number(raw: Column, pointed: bool = False) -> Column:
    """The value, or null where the text is no number."""
    s = col_with_exponent(raw)
    mantissa, exponent = F.regexp_extract(s, r"^([^e]*)", 1), F.regexp_extract(s, r"(e[+-]?\d+)$", 1)
    decimal = (lambda m: F.when(m.rlike(r"^[+-]?\d+\.\d+$"), m).otherwise(col_decimal_text(m))) if pointed else col_decimal_text
    return F.concat(bound(mantissa, decimal), exponent).try_cast("double")


def number_locale(raw: Column) -> Column:
    comma, dot = raw.contains(","), raw.contains(".")
    later = F.instr(F.reverse(raw), ",") < F.instr(F.reverse(raw), ".")
    return (
        F.when(comma & dot, F.when(later, "pt-br").otherwise("en"))
        .when(comma, F.when(raw.rlike(",.*,"), "en").otherwise("pt-br"))
        .when(dot, F.when(raw.rlike(r"^[+\-−]?[1-9]\d{0,2}(\.\d{3})+$"), "pt-br").otherwise("en"))
        .otherwise("none")
    )


def number_kind(raw: Column) -> Column:
    return (
        F.when(raw.rlike("[ªº]$"), "ordinal")
        .when(raw.rlike("%$"), "percentual")
        .when(raw.rlike(r"^[+\-−]?\d+\s*/\s*\d+$"), "fracionaria")
        .when(raw.rlike(_SCIENTIFIC), "cientifica")
        .when(raw.rlike("[.,]"), "decimal")
        .otherwise("inteira")
    )


def number_parsed(raw: Column) -> Column:
    """STRUCT<value, locale, kind, sign>; the value is null where the text is no number."""
    return bound(raw, _number_parsed)


def _number_parsed(raw: Column) -> Column:
    kind = number_kind(raw)
    below = canonical_number(F.regexp_extract(raw, r"/\s*(\d+)$", 1))
    value = (
        F.when(kind == "ordinal", canonical_number(F.regexp_replace(raw, "[ªº]$", "")))
        .when(kind == "percentual", canonical_number(F.regexp_replace(raw, "%$", "")) / 100)
        .when(kind == "fracionaria", F.try_divide(canonical_number(F.regexp_extract(raw, r"^([^/\s]+)", 1)), below))
        .when(kind == "cientifica", canonical_number(raw, True))
        .otherwise(canonical_number(raw))
    )
    bare = F.regexp_replace(F.regexp_replace(raw, "[%ªº]$", ""), r"\s*[eE×x·*].*$", "")
    pointed = (kind == "cientifica") & raw.contains(".") & ~raw.contains(",")
    locale = F.when(kind.isin("ordinal", "fracionaria"), "none").when(pointed, "en").otherwise(number_locale(bare))
    sign = F.when(value > 0, "positivo").when(value < 0, "negativo").when(value == 0, "zero")
    return F.struct(value.alias("value"), locale.alias("locale"), kind.alias("kind"), sign.alias("sign"))


def col_format_value(value: Column) -> Column:
    """Integers in full below 1e15, six digits beyond 1e6 or under 1e-3, else the shortest text."""
    digits = F.regexp_replace(F.format_string("%.5e", value), r"\.?0*e", "e")
    small = F.regexp_replace(F.format_string("%.9f", value), r"0+$", "")
    shortest = value.cast("string")
    return (
        F.when(value.isNull(), "")
        .when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("decimal(16,0)").cast("string"))
        .when((F.abs(value) >= 1e6) | (F.abs(value) < 1e-4), digits)
        .when(F.abs(value) < 1e-3, small)
        .otherwise(shortest)
    )


def r2l_group(value: Column) -> Column:
    whole = F.when(value == F.floor(value), value.cast("decimal(16,0)").cast("string")).otherwise(F.regexp_extract(F.format_string("%.15f", value), r"^(-?\d+)", 1))
    rest = F.when(value == F.floor(value), "").otherwise(F.regexp_extract(value.cast("string"), r"(\.\d+)$", 1))
    groups = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", " ")
    return F.when((F.abs(value) >= 1000) & (F.abs(value) < 1e15), F.concat(groups, rest))
