"""Span resolution over exploded rows (doc, type, start, end), for spans that come from elsewhere.

Containment and overlap are found by running maxima over a window of a document's spans in their
order, so neither compares all pairs; overlap components are resolved one by one, so no fold sees
more than one component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexidim.lexicons import TYPES


def without_contained(spans: DataFrame, doc: str = "doc_id", types: tuple[str, ...] = TYPES) -> DataFrame:
    """Spans that no span of another type in the same document strictly contains: none of the others
    that begin before reaches their end, and none that begin where they do goes beyond it. The
    furthest end by type, over a window, tells; types are all that occur."""
    line = Window.partitionBy(doc).orderBy("start")
    before, beside = line.rangeBetween(Window.unboundedPreceding, -1), line.rangeBetween(0, 0)
    reach = {}
    for k, t in enumerate(types):
        end = F.when(F.col("type") == t, F.col("end"))
        reach |= {f"_before{k}": F.max(end).over(before), f"_beside{k}": F.max(end).over(beside)}
    inside = [(F.col("type") != t) & ((F.coalesce(F.col(f"_before{k}") >= F.col("end"), F.lit(False))) | F.coalesce(F.col(f"_beside{k}") > F.col("end"), F.lit(False))) for k, t in enumerate(types)]
    return spans.withColumns(reach).where(~reduce(lambda a, b: a | b, inside)).drop(*reach)


def resolved(spans: DataFrame, priority: dict[str, int], doc: str = "doc_id") -> DataFrame:
    """Disjoint spans: by precedence, then the longer, then the first."""
    order = F.create_map(*[F.lit(x) for p in priority.items() for x in p])
    line = Window.partitionBy(doc).orderBy("start", "end", "type")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int")
    islands = without_contained(spans, doc).withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(order[F.col("type")].alias("p"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "type")
    sorted_ = F.array_sort(F.collect_list(item))
    clash = lambda acc, x: F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    empty = F.slice(F.col("_all"), 1, 0)
    kept = F.aggregate("_all", empty, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.array_append(acc, x)))
    return islands.groupBy(doc, "_island").agg(sorted_.alias("_all")).select(doc, F.inline(kept)).select(doc, "type", "start", "end")


def gaps(spans: DataFrame, lengths: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, start, end) of what spans, which may overlap, leave of documents of the given length."""
    ends = lengths.select(doc, F.col("length").alias("start"), F.col("length").alias("end"))
    line = Window.partitionBy(doc).orderBy("start", "end")
    before = F.coalesce(F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_spans = spans.select(doc, "start", "end").unionByName(ends)
    return all_spans.withColumn("_from", before).where("_from < start").select(doc, F.col("_from").alias("start"), F.col("start").alias("end"))


def reassembled(pieces: DataFrame, doc: str = "doc_id", text: str = "piece") -> DataFrame:
    """The pieces of each document in the order of their start, joined."""
    parts = F.array_sort(F.collect_list(F.struct("start", text)))
    return pieces.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("text"))
