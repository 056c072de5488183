"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as words: A-Z lowered, ASCII other than letters and digits taken as blanks,
one blank between words, in UTF-8 bytes. A pattern of m bytes that occurs with at most k edits
shares at least m - q + 1 - k q of its q-grams with the text, all on diagonals no more than k
apart; so shared q-grams are counted in diagonal bands of twice the width that overlap by half,
bands short of that count are dropped, and the rest is verified by banded alignment. Patterns are
benchmark items; items over PATTERN bytes are taken as windows that overlap by half.

The benchmark is the query set: it is read in blocks of a bounded size, each sent to the workers
and held against all documents. Documents aren't shuffled.

Defined results: null and wordless texts match nothing and, as items, are not looked for; a null
id stays null; every row of the documents is searched whole; an item that stands in a document
several times is reported once, at the place with the fewest edits, then the first; rows with the
same id are one document, rows without an id one each text; items with the same id count as one; other columns of either table are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexidim.llm.common import map_batches, read_table, text_mark, without_rows, worker_cache

Q = 8
#: Edits allowed for each byte of a pattern.
EDIT_RATE = 0.1
#: Bytes of the longest pattern, and of the patterns in a block.
PATTERN, BLOCK = 512, 1 << 20
#: Bytes of text whose q-grams are looked up at a time, and shared q-grams that are held at a time.
STRETCH, HITS = 1 << 20, 1 << 20
SLOT_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)

WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())


def windows(item: bytes) -> list[bytes]:
    """The item, or windows of PATTERN bytes that overlap by half and reach its end."""
    if len(item) <= PATTERN:
        return [item]
    starts = [*range(0, len(item) - PATTERN, PATTERN // 2), len(item) - PATTERN]
    return [item[s : s + PATTERN] for s in starts]


def budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed in a pattern of m bytes: so many that the lemma still asks for a q-gram."""
    return max(0, min(int(m * rate), (m - q) // q))


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """All 8-byte q-grams as integers, by position."""
    n = len(data) - q + 1
    out = np.empty(max(n, 0), np.uint64)
    for at in range(min(q, max(n, 0))):
        out[at::q] = np.frombuffer(data, "<u8", count=(n - at + q - 1) // q, offset=at)
    return out


def slots(codes: np.ndarray) -> np.ndarray:
    return (codes * MIX) >> np.uint64(64 - SLOT_BITS)


def align(pattern: bytes, text: bytes, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the pattern in a short text, within the
    edits; of equal ones the one that ends first. Only the diagonals that can hold it are computed."""
    m, size = len(pattern), len(text)
    width = size - m + 2 * edits + 1
    if width <= 0:
        return None
    wide = np.full(m + width + edits, -1, np.int16)
    wide[edits : edits + size] = np.frombuffer(text, np.uint8)
    far = np.int32(m + edits + 1)  # more than any cost within reach
    places = np.arange(width, dtype=np.int32)
    start = places - edits  # cell c of row i stands at position i + c - edits of the text
    cost = np.where((start < 0) | (start > size), far, 0).astype(np.int32)
    for i in range(m):
        diagonal = cost + (wide[i : i + width] != pattern[i])
        up = np.append(cost[1:], far) + 1
        take = up < diagonal
        new = np.where(take, up, diagonal)
        new_start = np.where(take, np.append(start[1:], 0), start)
        position = i + 1 + places - edits
        new[(position < 0) | (position > size)] = far
        # a cell may also be reached from any cell to its left
        level = new - places
        reach = np.minimum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == reach, places, 0))
        cost, start = reach + places, new_start[origin]
        cost[position > size] = far
        if i % 16 == 15 and cost.min() > edits:
            return None
    best = int(cost.argmin())
    if cost[best] > edits:
        return None
    return int(cost[best]), max(0, int(start[best])), m + best - edits


class Matcher:
    """Finds the patterns of a block in texts."""

    def __init__(self, patterns: list[tuple[object, bytes]], rate: float = EDIT_RATE):
        self.ids = [i for i, _ in patterns]
        self.patterns = [p for _, p in patterns]
        self.edits = np.array([budget(len(p), rate=rate) for p in self.patterns], np.int64)
        self.short = [k for k, p in enumerate(self.patterns) if len(p) < Q]
        self.need = np.array([max(1, len(p) - Q + 1 - Q * int(e)) for p, e in zip(self.patterns, self.edits)], np.int64)
        self.half = self.edits + 1  # width of half a band
        codes = [grams(p) for p in self.patterns]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, which = np.unique(code[order], return_inverse=True)
        self.owner, self.place = owner[order], place[order]
        self.by_code = which.astype(np.int64) * len(codes) + self.owner  # rises
        self.there = np.zeros(1 << SLOT_BITS, bool)
        self.there[slots(self.codes)] = True

    def bands(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(pattern, first diagonal) of the bands with enough shared q-grams."""
        code = grams(data)
        at = np.flatnonzero(self.there[slots(code)])
        if not len(at) or not len(self.codes):
            return
        which = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        same = self.codes[which] == code[at]
        yield from self._bands(at[same], which[same], len(data), (0, len(self.patterns)), (-PATTERN, len(data)))

    def _bands(self, at: np.ndarray, which: np.ndarray, size: int, patterns: tuple[int, int], firsts: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """bands() of a range of patterns with first diagonals in a range. A shared q-gram is held
        once for each place of each pattern that has it: where that makes more than HITS, the
        ranges are halved, since neither patterns nor stretches of text share any count."""
        (p0, p1), (low, high) = patterns, firsts
        near = slice(*np.searchsorted(at, [low, high + 2 * int(self.half.max()) + PATTERN]))
        code = which[near].astype(np.int64) * len(self.patterns)
        first, last = np.searchsorted(self.by_code, [code + p0, code + p1])
        many = last - first
        total = int(many.sum())
        if not total:
            return
        if total > HITS and (high - low > 8 * PATTERN or p1 - p0 > 1):
            if high - low > 8 * PATTERN:
                middle = (low + high) // 2
                halves = [(patterns, (low, middle)), (patterns, (middle, high))]
            else:
                middle = (p0 + p1) // 2
                halves = [((p0, middle), firsts), ((middle, p1), firsts)]
            for half in halves:
                yield from self._bands(at[near], which[near], size, *half)
            return
        entry = np.arange(total) + np.repeat(first - (np.cumsum(many) - many), many)
        pattern, place = self.owner[entry], self.place[entry]
        span = size + 2 * PATTERN  # more than a pattern has half bands
        key = pattern * span + (np.repeat(at[near], many) - place) // self.half[pattern] + PATTERN
        # cells that can't reach a pattern's count are dropped before the keys are sorted
        cells = 1 << 18
        rough = np.bincount((key * 7919) & (cells - 1), minlength=cells)
        own, after, before = (rough[((key + move) * 7919) & (cells - 1)] for move in (0, 1, -1))
        keep = own + np.maximum(after, before) >= self.need[pattern]
        if not keep.any():
            return
        # a pattern's q-gram counts once in half a band, however often the text has it there
        key = np.unique(key[keep] * PATTERN + place[keep]) // PATTERN
        keys, n = np.unique(key, return_counts=True)
        following = np.searchsorted(keys, keys + 1)
        beside = np.append(keys, -1)[following] == keys + 1
        shared = n + np.where(beside, np.append(n, 0)[following], 0)
        for k in np.flatnonzero(shared >= self.need[keys // span]):
            p = int(keys[k] // span)
            diagonal = int(keys[k] % span - PATTERN) * int(self.half[p])
            if low <= diagonal < high:
                yield p, diagonal

    def find(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """By (text, pattern): (edits, start, end) in the normalised text."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= STRETCH):
                group.append(at)
                size += len(texts[at]) + 1
                at += 1
            self._find_in(texts, group, out)
        return out

    def _find_in(self, texts: list[bytes], group: list[int], out: dict) -> None:
        data = b"\xff".join(texts[g] for g in group)
        ends = np.cumsum([len(texts[g]) + 1 for g in group])
        for k in self.short:
            if self.patterns[k]:
                for g in group:
                    where = (b" " + texts[g] + b" ").find(b" " + self.patterns[k] + b" ")
                    if where >= 0:
                        out[g, k] = (0, where, where + len(self.patterns[k]))
        seen: dict[bytes, tuple | None] = {}  # of the pattern at hand: texts copy each other
        of = None
        for k, diagonal in sorted(self.bands(data)):
            if k != of:
                of, seen = k, {}
            pattern, edits, band = self.patterns[k], int(self.edits[k]), 2 * int(self.half[k])
            middle = min(max(0, diagonal + (band + len(pattern)) // 2), len(data) - 1)
            for g in {int(np.searchsorted(ends, x, side="right")) for x in (max(0, diagonal), middle, min(len(data) - 1, diagonal + band + len(pattern)))}:
                if g >= len(group):
                    continue
                text, offset = texts[group[g]], int(ends[g]) - len(texts[group[g]]) - 1
                low = max(0, diagonal - offset - edits)
                window = text[low : max(0, diagonal - offset + band + len(pattern) + edits)]
                if window not in seen:
                    whole = window.find(pattern)
                    seen[window] = (0, whole, whole + len(pattern)) if whole >= 0 else align(pattern, window, edits) if edits else None
                if found := seen[window]:
                    found = (found[0], found[1] + low, found[2] + low)
                    out[group[g], k] = min(out.get((group[g], k), found), found)


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """Patterns in blocks of a bounded size; the benchmark passes the driver row by row."""
    block, size = [], 0
    for item, text in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        for w in windows(normal(text)):
            if w:
                block.append((item, w))
                size += len(w)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    yield block


def _in_block(docs: DataFrame, block: list, item_type: str, rate: float, id_col: str, text_col: str) -> DataFrame:
    key = ("decontamination", hash(tuple(block)), len(block), rate)

    def setup():
        cache = worker_cache()
        matcher = cache.get(key)
        if matcher is None:
            for old in [k for k in cache if k[0] == "decontamination"]:
                del cache[old]
            matcher = cache[key] = Matcher(block, rate)

        def kernel(ids, marks, texts):
            out = ([], [], [], [], [], [], [])
            words = [normal(t) for t in texts]
            for (row, k), (edits, start, end) in matcher.find(words).items():
                origin = [m.span() for m in WORDS.finditer(texts[row])]
                first, last = words[row].count(b" ", 0, start + 1), words[row].count(b" ", 0, max(start, end - 1))
                for col, v in zip(out, (ids[row], marks[row], matcher.ids[k], origin[min(first, len(origin) - 1)][0], origin[min(last, len(origin) - 1)][1], edits, 1 - edits / len(matcher.patterns[k]))):
                    col.append(v)
            return out

        return kernel

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs, [id_col, text_mark(id_col, text_col).alias("_mark"), text_col], f"`{id_col}` {kind}, _mark LONG, item_id {item_type}, start LONG, `end` LONG, edits INT, similarity DOUBLE", setup)


def _occurrences(docs: DataFrame, benchmark: DataFrame, rate: float, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    kind = dict(benchmark.dtypes)[item_col]
    found = [_in_block(docs, b, kind, rate, id_col, text_col) for b in blocks(benchmark, item_col, item_text)]
    best = Window.partitionBy(id_col, "_mark", "item_id").orderBy("edits", "start", "end")
    return reduce(DataFrame.unionByName, found).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, start, end (code points, whole words), edits, similarity: one row for each
    document and each item of which it holds an occurrence within the edit budget. Rows without an
    id are one document each text."""
    return _occurrences(docs, benchmark, rate, id_col, text_col, item_col, item_text).drop("_mark")


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item. Rows with one id go together, rows without an id by their
    own text."""
    return without_rows(docs, _occurrences(docs, benchmark, rate, id_col, text_col, item_col, item_text), id_col, text_col)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
