"""The engine in SQL: a table function that scans regions, and scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexidim import units
from lexidim.functions.numbers import NumberError, format_value, number_value
from lexidim.functions.text import slug
from lexidim.operators.render import rendered
from lexidim.operators.scan import regions
from lexidim.plans.engine import REGION, Engine, each_once, patterns_of


def register(spark: SparkSession, prefix: str = "lexi_") -> None:
    """`SELECT … FROM docs, LATERAL lexi_regions(text)`, lexi_regions_of, lexi_preprocess, lexi_number, lexi_format,
    lexi_slug, lexi_unit_dim, lexi_unit_factor and lexi_convert: in Arrow batches, each distinct
    value of a batch once. Queries that need no Python use the column functions they stand for."""

    fields = ("type", "start", "end", "content", "tag")
    spark.udf.register(prefix + "regions_of", Engine().scanner(fields))
    columns = ", ".join(f"`{f}` {REGION[f]}" for f in fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{prefix}regions`(text STRING) RETURNS TABLE({columns}) RETURN SELECT * FROM inline(`{prefix}regions_of`(text))")

    def preprocess(text):
        return rendered(text, regions(text, patterns_of()))[0]

    def number(text):
        try:
            return number_value(text)
        except NumberError:
            return None

    def analysed(unit):
        try:
            return units.combined(units.parse(unit))
        except units.UnitError:
            return None

    def converted(value, source, target):
        a, b = analysed(source), analysed(target)
        return value * a[1] / b[1] if a and b and a[0] == b[0] else None

    for name, f, kind in (
        ("preprocess", preprocess, "STRING"),
        ("number", number, "DOUBLE"),
        ("format", lambda v: format_value(v), "STRING"),
        ("slug", lambda t: slug(t), "STRING"),
        ("unit_dim", lambda u: list(a[0]) if (a := analysed(u)) else None, "ARRAY<INT>"),
        ("unit_factor", lambda u: a[1] if (a := analysed(u)) else None, "DOUBLE"),
        ("convert", converted, "DOUBLE"),
    ):
        spark.udf.register(prefix + name, each_once(f, kind))
