"""Line deduplication over levelled sorted runs of line hashes, in DataFrame functions alone.

A run is a table of line keys (two 64-bit hashes), hash-partitioned and sorted by key, with the
number of documents that hold the key and the largest id among them. Each batch of documents adds
its own run; when a level has FANOUT runs they are compacted into one run of the next level. Runs
have the same partitioning and order, so joins between them need no exchange. A rule that keeps a
line by its total over all batches needs all runs first; then each batch's lines are merge-anti-joined
with the runs of the keys that too few documents hold. What is left are the lines held often; the
places among them that aren't the last are carried on.

Texts take part in one exchange only, that which brings a document's dropped positions to it.

Defined results: a null text counts as one empty line; a null id counts as a document smaller than
all others; rows with the same id count as one document in "found in so many documents", and as
many rows of results as there are rows; a line that all documents lose but the largest stays there
in every place; a text whose lines all go becomes empty; other columns of the input are kept as
they are by deduplicated().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.llm.common import as_one, checkpointed, read_table

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["_h1", "_h2"]


def lowered(line: Column) -> Column:
    """A value that is the same for lines that differ in the case of A-Z only, and for no others.

    ASCII lines are lowered as they are. Others are lowered byte by byte as Latin-1: that also
    moves some lead bytes, but only to lead bytes with more bytes to follow, so no two texts meet.
    """
    by_bytes = F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(by_bytes)


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """_id, _text (a hash that tells rows of one id apart), _pos and the key of each long line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.btrim(F.col("_line"), F.lit(BLANKS))
    return (
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_text", "_pos", line.alias("_line"))
        .where(F.char_length("_line") >= min_chars)
        .select("_id", "_text", "_pos", lowered(F.col("_line")).alias("_line"))
        .select("_id", "_text", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit("second"), "_line").alias("_h2"))
    )


class LineRuns:
    """Levels of sorted runs (_h1, _h2, n_docs, last)."""

    def __init__(self, partitions: int, fanout: int = FANOUT):
        self.partitions, self.fanout = partitions, fanout
        self.levels: list[list[DataFrame]] = []

    def _sorted(self, run: DataFrame) -> DataFrame:
        return checkpointed(run.repartition(self.partitions, *KEY).sortWithinPartitions(*KEY))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """The run of a batch of lines (_id and key), at the lowest level."""
        once = lines.groupBy(*KEY, "_id").agg(F.lit(1).alias("_one"))  # dealt by id too: no line is hot
        self._put(self._sorted(once.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("_id").alias("last"))), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._put(self._sorted(merged), level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def totals(self) -> DataFrame:
        """One row per key over all runs."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else self._merged(runs)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines whose key no run holds: a merge-anti-join with each run in turn."""
        for run in self.runs():
            lines = lines.join(run.hint("merge"), KEY, "left_anti")
        return lines


def held_often(lines: DataFrame, totals: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines whose key min_docs documents hold: a merge-anti-join with the keys of the others."""
    return lines.join(totals.where(F.col("n_docs") < min_docs).select(*KEY).hint("merge"), KEY, "left_anti")


def dropped_positions(lines: DataFrame, totals: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """_id, _text, _drop: sorted positions of lines that min_docs documents hold, save in the last."""
    often = totals.where(F.col("n_docs") >= min_docs).select(*KEY, "last")
    gone = lines.join(often, KEY).where((F.col("_id") < F.col("last")) | (F.col("_id").isNull() & F.col("last").isNotNull()))
    return gone.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))


def without(text: Column, drop: Column) -> Column:
    """The text without the lines at the sorted positions, in time linear in its lines."""
    previous = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(drop, i - 1))
    marks = F.flatten(F.transform(drop, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - previous(i) - 1), F.array(F.lit(True)))))
    kept = F.filter(F.arrays_zip(F.split(text, "\n", -1).alias("line"), marks.alias("gone")), lambda z: ~F.coalesce(z["gone"], F.lit(False)))
    return F.array_join(F.transform(kept, lambda z: z["line"]), "\n")


def _deduplicated(docs: DataFrame, min_docs: int, min_chars: int, batches: int, id_col: str, text_col: str) -> DataFrame:
    """_doc (the columns of docs, the text less the dropped lines), _n_lines and _n_dropped."""
    spark = docs.sparkSession
    lines = checkpointed(long_lines(docs, id_col, text_col, min_chars).withColumn("_batch", F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int")))
    runs = LineRuns(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for b in range(batches):
        runs.add(lines.where(F.col("_batch") == b).select("_id", *KEY))
    totals = runs.totals()
    often = reduce(DataFrame.unionByName, (held_often(lines.where(F.col("_batch") == b), totals, min_docs) for b in range(batches)))
    drops = dropped_positions(often, totals, min_docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = as_one(docs.withColumn(text_col, text), _own_id=F.col(id_col), _own_text=F.xxhash64(text))
    body = F.col(f"_doc.`{text_col}`")
    return (
        marked.join(drops.hint("shuffle_hash"), F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_text") == F.col("_text")), "left")
        .select(
            F.col("_doc").withField(f"`{text_col}`", F.when(F.col("_drop").isNull(), body).otherwise(without(body, F.col("_drop")))).alias("_doc"),
            (F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).alias("_n_lines"),
            F.coalesce(F.size("_drop"), F.lit(0)).alias("_n_dropped"),
        )
    )


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text less the dropped lines, and with _n_lines and _n_dropped, which take the
    place of columns of these names."""
    own = docs.drop("_n_lines", "_n_dropped")
    return _deduplicated(own, min_docs, min_chars, batches, id_col, text_col).select("_doc.*", "_n_lines", "_n_dropped")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text less the dropped lines."""
    return _deduplicated(docs, MIN_DOCS, MIN_CHARS, BATCHES, id_col, text_col).select("_doc.*")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.col("_n_dropped").cast("long").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP7_SQL = """
WITH lines AS (
    SELECT doc_id, u.line, u.pos,
           translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM documents,
         LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u
), often AS (
    SELECT line_key, max(doc_id) AS last FROM lines
    WHERE length(line_key) >= 40 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT l.*, (o.last IS NOT NULL AND l.doc_id < o.last) AS gone
    FROM lines l LEFT JOIN often o ON l.line_key = o.line_key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
