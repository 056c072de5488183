"""Best-fit packing of token pieces by exact-complement hashing.

The plan needs only how many pieces there are of each length, at most `limit` numbers, whatever
the size of the corpus: sums of one, two and three available lengths are indexed as bit sets, the
gap beside each leading length is filled exactly from that index under the availability counts,
many bins at a time, and what finds no exact filling is placed best fit, longest first. Pieces
then take the numbered places of their length: a piece's number is its rank in its own partition
plus the pieces of that length in earlier partitions, so no length is ever gathered in one task.

Defined results: a null text counts as empty, and an empty text is one piece that holds the end
id alone; a null id stays null; every row of the input is packed, repeated rows and ids included;
no rows give no sequences. Other columns of the input are left alone.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexidim.llm.common import checkpointed, map_batches, read_table, worker_cache

LIMIT, END_ID = 2048, 0
#: Words whose ids a worker remembers, and the longest such word; all others are encoded anew.
CACHED_WORDS, CACHED_CHARS = 800_000, 48
#: Marks that stand after a word as a token run of their own.
MARKS = ".,;:!?"


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for
    themselves, the others for characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of a word that follows a blank or, if it
    begins with a newline, follows that newline."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.alphabet = tokenizer, tokenizer.model, byte_alphabet()
        self.marks: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if len(core) < len(word) and core[-1:].isalpha():
            mark = word[len(core) :]
            if mark not in self.marks:
                if len(mark) > 8:
                    return self[core] + self.encoded(mark)
                self.marks[mark] = self.encoded(mark)
            return self[core] + self.marks[mark]
        if word.isalpha():  # one pre-token, so the merges alone decide
            letters = (" " + word).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
            ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        else:
            ids = self.encoded(word if word[:1] == "\n" else " " + word)
        if len(word) <= CACHED_CHARS and len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Whole texts to ids. With a byte-level tokenizer that splits before blanks, no merge crosses
    a single blank or newline between words, so such texts are encoded word by word from a cache;
    all other texts go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        by_bytes = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.words = WordIds(self.tokenizer)
        self.by_words = by_bytes and "add_prefix_space=False" in str(self.tokenizer.pre_tokenizer)

    def __call__(self, text: str) -> bytes:
        if not self.by_words or not text:
            return self.words.encoded(text)
        parts = text.replace("\n", " \n").split(" ")
        words = text.split()
        if len(words) != len(parts) or sum(map(len, words)) + len(parts) - 1 != len(text):
            return self.words.encoded(text)
        return self.words.encoded(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:]))


def cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of so many ids; only the first may be short."""
    if total <= limit:
        return [(0, total)]
    first = total % limit
    return ([(0, first)] if first else []) + [(s, limit) for s in range(first, total, limit)]


def tokenized(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids (little-endian unsigned 32 bit), and the place of the piece
    among those of its length: part (the partition) and rank in it."""

    def setup():
        cache = worker_cache()
        encode = cache.get(("encoder", tokenizer)) or cache.setdefault(("encoder", tokenizer), Encoder(tokenizer))
        part, seen, end = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64), np.array([end_id], "<u4").tobytes()

        def kernel(ids, texts):
            out = ([], [], [], [], [], [], [])
            for i, t in zip(ids, texts):
                tokens = encode(t or "") + end
                for k, (start, length) in enumerate(cut(len(tokens) // 4, limit)):
                    for col, v in zip(out, (i, k, start, length, tokens[4 * start : 4 * (start + length)], part, int(seen[length]))):
                        col.append(v)
                    seen[length] += 1
            return out

        return kernel

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, piece INT, start LONG, length LONG, ids BINARY, part INT, rank LONG", setup)


class SumIndex:
    """Which gaps one, two or three of the available lengths fill exactly, as bit sets."""

    def __init__(self, counts: list[int]):
        self.counts = counts
        self.build()

    def build(self) -> None:
        mask = (1 << len(self.counts)) - 1
        self.lengths = [a for a, n in enumerate(self.counts) if n > 0]
        self.one = sum(1 << a for a in self.lengths)
        self.two = self.three = 0
        for a in self.lengths:
            self.two |= self.one << a
        self.two &= mask
        for a in self.lengths:
            self.three |= self.two << a
        self.three &= mask

    def fits(self, parts: tuple[int, ...]) -> int:
        """How many bins the counts allow of these lengths."""
        return min(self.counts[a] // n for a, n in Counter(parts).items())

    def filling(self, lead: int, gap: int) -> tuple[int, ...] | None:
        """At most three lengths that fill the gap beside lead, the longest possible first."""
        if self.one >> gap & 1 and self.fits((lead, gap)):
            return (gap,)
        if self.two >> gap & 1:
            for a in reversed(self.lengths[: bisect.bisect_left(self.lengths, gap)]):
                if a * 2 < gap:
                    break
                if self.one >> (gap - a) & 1 and self.fits((lead, a, gap - a)):
                    return (a, gap - a)
        if self.three >> gap & 1:
            for a in reversed(self.lengths[: bisect.bisect_left(self.lengths, gap)]):
                if a * 3 < gap:
                    break
                if not self.two >> (gap - a) & 1:
                    continue
                for b in reversed(self.lengths[: bisect.bisect_right(self.lengths, min(a, gap - a - 1))]):
                    if b * 2 < gap - a:
                        break
                    if self.one >> (gap - a - b) & 1 and self.fits((lead, a, b, gap - a - b)):
                        return (a, b, gap - a - b)
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Places (length, first rank, rank after the last, sequence of the first, offset).

    The piece of that length with rank r stands at the offset in sequence (first sequence + r -
    first rank). The work and the result depend on limit, not on how large the counts are.
    """
    left = [counts.get(n, 0) for n in range(limit + 1)]
    used, places, n_bins = [0] * (limit + 1), [], 0

    def put(length: int, bins: int, sequence: int, offset: int) -> None:
        places.append((length, used[length], used[length] + bins, sequence, offset))
        used[length] += bins
        left[length] -= bins

    def start(parts: tuple[int, ...], bins: int) -> None:
        nonlocal n_bins
        offset = 0
        for a in parts:
            put(a, bins, n_bins, offset)
            offset += a
        n_bins += bins

    if left[limit]:
        start((limit,), left[limit])
    index, live = SumIndex(left), 0
    for lead in range(limit - 1, 0, -1):
        while left[lead] and (rest := index.filling(lead, limit - lead)):
            start((lead, *rest), index.fits((lead, *rest)))
            if any(left[a] == 0 for a in rest):
                live += 1
                if live % 16 == 0:
                    index.build()
        if not left[lead] and index.one >> lead & 1:
            index.one &= ~(1 << lead)

    gaps: list[int] = []  # of the open bins, sorted
    open_bins: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence and number of bins

    def reopen(gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            if gap not in open_bins:
                bisect.insort(gaps, gap)
            open_bins.setdefault(gap, []).append((sequence, bins))

    def fill(length: int, each: int, bins: int, sequence: int, gap: int) -> None:
        for k in range(each):
            put(length, bins, sequence, limit - gap + k * length)
        reopen(gap - each * length, sequence, bins)

    for length in range(limit - 1, 0, -1):
        while n := left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                gap, sequence, bins = limit, n_bins, max(1, n // (limit // length))
                n_bins += bins
            else:
                gap = gaps[at]
                sequence, there = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap], gaps[at]
                bins = min(there, max(1, n // (gap // length)))
                reopen(gap, sequence + bins, there - bins)
            fill(length, min(gap // length, n), bins, sequence, gap)
    return places


def packed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """What tokenized() gives, without part and rank, and with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = checkpointed(pieces)  # ranks must not be dealt anew when a task runs again
    by_part = checkpointed(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    places = spark.createDataFrame(plan(counts, limit), "length LONG, low LONG, high LONG, first LONG, offset LONG")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.col("base") + F.col("rank")
    # The places are a few rows for each of at most limit lengths, whatever the input.
    return (
        pieces.join(base, ["part", "length"])
        .join(F.broadcast(places), "length")
        .where((number >= F.col("low")) & (number < F.col("high")))
        .select(*[c for c in pieces.columns if c not in ("part", "rank")], (F.col("first") + number - F.col("low")).alias("sequence_id"), "offset")
    )


def sequences(with_ids: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the packed sequences themselves, of at most limit ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return with_ids.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece, with the checksum of its ids and its place."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = tokenized(docs, str(tokenizer)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))
