"""N-gram Jaccard join with vertical partitioning.

1. Every text becomes a set of hashed word n-grams; equal sets are one class, held by a 128-bit
   key. A sketch of fixed size counts the n-grams of all documents and gives them one global
   order, rare ones first.
2. Two sets that link share so many n-grams (needed()) among the first few of each in that order
   (the prefix). Classes whose prefixes do are gathered: each class has one home, the most shared
   n-gram of its prefix, and homes that share that many are held against each other. As a class
   has one home, no two classes are compared twice. Homes are packed into blocks of a bounded size;
   a home too large for that is cut into blocks of its own.
3. The global order is cut into FRAGMENTS. For each pair of blocks and fragment the overlaps of
   the pairs of sets are counted apart, as one matrix; the matrices of a pair of blocks are summed,
   and the sums decide. A pair of blocks emits a spanning star of each group it finds, never its
   pairs.
4. The blocks of a large home are first linked each by itself, then by one class of the largest
   group in each. What is in the largest group so far needs no more comparing with itself: only
   the other classes, the stray ones, are held against each other and against that group. So a
   group of m near copies ships each of its sets a few times, not once for each block.
5. Components of the links are found by alternating large and small stars; up to LINKS_IN_TASK
   links, which are counted, by one task that joins them as it reads them.

All comparisons are exact on the sets; the order, homes and blocks only say which are made.

Texts are hashed in stretches of STRETCH bytes, so what a task holds besides the texts grows with
the words of its longest text: 8 bytes a word in two arrays.

Defined results: null texts and texts without words have the empty set, which links with nothing;
so does a row with a null id, whose component is null; repeated rows fall in one class; rows with
the same id but other texts are judged each by its text; a text with fewer than n words has its
whole sequence of words as the only n-gram; other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexidim.llm.common import SLICE_ROWS, as_one, broadcast_if_small, checkpointed, read_table, worker_cache

#: Counters of the sketch that orders n-grams, and the parts in which tasks send them.
SKETCH, SKETCH_PARTS = 1 << 20, 64
FRAGMENTS = 4
#: N-grams that the prefixes of two sets must share: one for each so many of the set, and at least
#: so many. Prefixes are longer by one less than that.
SHARE, SHARED = 8, 5
#: Size of a block, where a class counts 1 and 1 more for each WEIGHT n-grams.
BLOCK, WEIGHT = 512, 2048
#: Links that one task may hold.
LINKS_IN_TASK = 1 << 18
#: Columns of the 0/1 matrices that are multiplied at a time.
COLUMNS = 4096
#: Bits of the filters that keep n-grams and texts of no use from the exchange.
FILTER_BITS = 1 << 25
#: Bytes of text that are hashed at a time, and n-grams.
STRETCH = 1 << 18
#: Classes that a task remembers so as not to give them twice.
GIVEN = 1 << 17

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


#: A word's hash is the sum of its bytes' values times powers of BASE, modulo 2^64; A-Z count as a-z.
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * U(BASE))
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def powers() -> tuple[np.ndarray, np.ndarray]:
    """The first STRETCH powers of BASE and of its inverse modulo 2^64, kept from task to task."""
    cache = worker_cache()
    if len(cache.get("powers", ((),))[0]) != STRETCH:
        sizes = np.full(STRETCH, BASE, U), np.full(STRETCH, pow(BASE, -1, 1 << 64), U)
        for p in sizes:
            p[0] = 1
        cache["powers"] = tuple(np.cumprod(p, dtype=U) for p in sizes)
    return cache["powers"]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjacent texts, text k from byte bounds[k] to bounds[k + 1], and how
    many words begin before each bound."""
    up, down = powers()
    out, open_word, n = [], None, 0  # open_word: sum and length of a word cut by a stretch's end
    at = np.zeros(len(bounds), np.int64)
    for low in range(0, len(data), STRETCH):
        part = data[low : low + STRETCH]
        word = WORD[part]
        edge = np.zeros(len(part) + 1, bool)  # a text begins here
        first, beyond = np.searchsorted(bounds, [low, low + len(part)])
        inside = bounds[first:beyond] - low
        edge[inside] = True
        edge[len(part)] = beyond < len(bounds) and bounds[beyond] == low + len(part)
        before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
        starts = np.flatnonzero(word & ~before)
        after = np.concatenate([word[1:], [False]]) & ~edge[1:]
        ends = np.flatnonzero(word & ~after) + 1
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        raw, sizes = (sums[ends] - sums[starts]) * down[starts], ends - starts
        new = starts
        if open_word is not None:
            if word[0] and not edge[0]:  # it goes on
                raw[0] = U((open_word[0] + int(raw[0]) * pow(BASE, open_word[1], 1 << 64)) % (1 << 64))
                sizes[0] += open_word[1]
                new = starts[1:]
            else:
                out.append(np.array([open_word[0]], U))
            open_word = None
        at[first:beyond] = n + np.searchsorted(new, inside)
        n += len(new)
        if len(raw) and ends[-1] == len(part) and not edge[len(part)]:
            open_word = int(raw[-1]), int(sizes[-1])
            raw = raw[:-1]
        out.append(raw)
    if open_word is not None:
        out.append(np.array([open_word[0]], U))
    at[bounds >= len(data)] = n
    return mixed(np.concatenate(out)) if out else np.empty(0, U), at


def distinct(tokens: np.ndarray) -> np.ndarray:
    """Sorted distinct values; the array given is sorted."""
    tokens.sort()
    keep = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=keep[1:])
    return tokens[keep]


def sets_of(data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    h, at = word_hashes(data, bounds)
    m = max(len(h) - n + 1, 0)
    grams = np.empty(m, U)
    for low in range(0, m, STRETCH):
        high = min(low + STRETCH, m)
        g = h[low:high] * U(3)
        for k in range(1, n):
            g = mixed(g) + h[low + k : high + k]
        grams[low:high] = mixed(g)
    short = {}
    for k in np.flatnonzero(np.diff(at) < n).tolist():
        low, high = at[k], at[k + 1]
        salted = mixed(h[low:high] + np.arange(1, high - low + 1, dtype=U) * U(BASE))
        short[k] = mixed(np.bitwise_xor.reduce(salted, keepdims=True) + U(high - low)) if high > low else np.empty(0, U)
    del h
    return [short[k] if k in short else distinct(grams[low : high - n + 1]) for k, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))]


def sets_in(column: pa.Array, n: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """The sets of a column of texts by slices of SLICE_ROWS rows, or fewer where texts are long."""
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        full = int(np.searchsorted(offsets, offsets[low] + 4 * STRETCH, side="right")) - 1
        high = min(max(full, low + 1), low + SLICE_ROWS, len(column))
        yield slice(low, high), sets_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n)
        low = high


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sets of some texts."""
    return [s for _, sets in sets_in(pa.array(texts, pa.string()), n) for s in sets]


def least_common(n, num: int, den: int):
    """N-grams that a set of n has in common with any set that links with it."""
    return -(-n * num // den)


def needed(n, num: int, den: int):
    """N-grams that the prefix of a set of n shares with that of any set that links and is no
    smaller, or as many as a small set must have in common with any other."""
    return np.minimum(np.maximum(SHARED, n // SHARE), least_common(n, num, den))


def needed_column(n: Column, num: int, den: int) -> Column:
    """needed() of a column of sizes."""
    return F.least(F.greatest(F.lit(SHARED), F.floor(n / SHARE)), F.ceil(n * num / den)).cast("int")


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _arrow_map(df: DataFrame, schema: str, run) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(source):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(batches, schema)


def described(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (_id, _hash, _n, _c1, _c2) of all documents and, with _part set, this task's sketch."""

    def run(source):
        sketch = np.zeros(SKETCH, np.int64)
        for batch in source:
            ids, marks = batch.column(0), batch.column(2)
            for at, sets in sets_in(batch.column(1), n):
                np.add.at(sketch, (np.concatenate(sets) & U(SKETCH - 1)).astype(np.int64), 1)
                keys = [class_key(s) if len(s) else (None, None) for s in sets]
                blank, size = [None] * len(sets), len(sets)
                yield ids.slice(at.start, size), marks.slice(at.start, size), [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], blank, blank
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(np.split(sketch, SKETCH_PARTS)) if p.any()]
        blank = [None] * len(parts)
        yield blank, blank, blank, blank, blank, [k for k, _ in parts], [p for _, p in parts]

    kind = dict(docs.dtypes)[id_col]
    return _arrow_map(docs.select(id_col, text_col, F.xxhash64(text_col)), f"_id {kind}, _hash LONG, _n LONG, _c1 LONG, _c2 LONG, _part INT, _counts BINARY", run)


def summed_sketch(parts: DataFrame) -> np.ndarray:
    """The sketch of all tasks; SKETCH counters reach the driver, whatever the input."""

    def add(source):
        total: dict[int, np.ndarray] = {}
        for batch in source:
            for k, p in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(zlib.decompress(p), np.int64)
                total[k] = total[k] + counts if k in total else counts.copy()
        yield list(total), [zlib.compress(c.tobytes(), 1) for c in total.values()]

    schema = "_part INT, _counts BINARY"
    out = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.int64)
    for row in _arrow_map(parts.select("_part", "_counts").repartition("_part"), schema, add).collect():
        out[row["_part"]] += np.frombuffer(zlib.decompress(row["_counts"]), np.int64)
    return out.reshape(-1)


def global_order(sketch: np.ndarray, fragments: int = FRAGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each slot, rare ones first, and the ranks at which fragments of like mass begin."""
    order = np.argsort(sketch, kind="stable")
    rank = np.empty(SKETCH, np.int32)
    rank[order] = np.arange(SKETCH, dtype=np.int32)
    mass = np.cumsum(sketch[order])
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments, side="right")
    return rank, cuts.astype(np.int32)


def prefix_tokens(docs: DataFrame, n: int, num: int, den: int, rank, sketch_one, id_col: str, text_col: str, known=None) -> DataFrame:
    """(_token, _c1, _n) of the prefixes, _n the set's size. N-grams alone in their slot can't be
    shared and are left out, as are those that the filter known doesn't let through; a task gives
    each class once."""

    def run(source):
        place, lone = rank.value, sketch_one.value
        given: set[int] = set()
        for batch in source:
            has_id = batch.column(0).is_valid().to_pylist()
            for at, sets in sets_in(batch.column(1), n):
                tokens, owners, sizes = [], [], []
                for k, s in enumerate(sets, at.start):
                    if not has_id[k] or not len(s) or (c1 := class_key(s)[0]) in given:
                        continue
                    if len(given) < GIVEN:
                        given.add(c1)
                    slot = (s & U(SKETCH - 1)).astype(np.int64)
                    size = min(len(s), len(s) - least_common(len(s), num, den) + max(SHARED, len(s) // SHARE))
                    order = place[slot].astype(U) << U(32) | s >> U(32)
                    first = (order <= np.partition(order, size - 1)[size - 1]) & ~lone[slot]  # ties too
                    mine = s[first]
                    tokens.append(mine if known is None else mine[let_in(known.value, mine)])
                    owners.append(np.full(len(tokens[-1]), c1, np.int64))
                    sizes.append(np.full(len(tokens[-1]), len(s), np.int32))
                if tokens:
                    yield pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes))

    return _arrow_map(docs.select(id_col, text_col), "_token LONG, _c1 LONG, _n INT", run)


def candidate_sets(docs: DataFrame, n: int, rank, cuts: np.ndarray, text_col: str) -> DataFrame:
    """A row for each class in _classes and fragment. docs has the text and _classes, the first
    halves of the keys of its id's classes."""
    pieces = len(cuts) + 1

    def run(source):
        place = rank.value
        for batch in source:
            wanted = batch.column(1).to_pylist()
            for at, sets in sets_in(batch.column(0), n):
                out = ([], [], [], [], [])
                for s, own in zip(sets, wanted[at]):
                    c1, c2 = class_key(s)
                    if not len(s) or c1 not in own:
                        continue
                    of = np.searchsorted(cuts, place[(s & U(SKETCH - 1)).astype(np.int64)], side="right")
                    for f in range(pieces):
                        for col, v in zip(out, (c1, c2, len(s), f, s[of == f].tobytes())):
                            col.append(v)
                yield out

    return _arrow_map(docs.select(text_col, "_classes"), "_c1 LONG, _c2 LONG, _n LONG, _fragment INT, _tokens BINARY", run)


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    h = mixed(hashes.view(U))
    return [(h >> U(k)).astype(np.int64) & (FILTER_BITS - 1) for k in (0, 31)]


def let_in(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through: all that it was made from, and some others."""
    keep = np.ones(len(hashes), bool)
    for at in _bits(hashes):
        keep &= (known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS over a column of hashes, whatever their number. What it lets
    through wrongly is dropped by the join that follows."""

    def run(source):
        seen = np.zeros(FILTER_BITS, bool)
        for b in source:
            for at in _bits(b.column(0).to_numpy()):
                seen[at] = True
        yield [[zlib.compress(np.packbits(seen).tobytes(), 1)]]

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in _arrow_map(hashes.repartition(8), "_bits BINARY", run).toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["_bits"]), np.uint8)
    return out


def let_through(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    def run(source):
        for b in source:
            yield b.filter(pa.array(let_in(known.value, b.column(2).to_numpy()))).columns[:2]

    kind = dict(docs.dtypes)[id_col]
    return _arrow_map(docs.select(id_col, text_col, F.xxhash64(id_col)), f"`{id_col}` {kind}, `{text_col}` STRING", run)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices of the shared tokens."""
    out = np.zeros((len(left), len(right)), np.uint32)
    both = [np.concatenate(side) if side else np.empty(0, U) for side in (left, right)]
    shared = np.intersect1d(*both)
    if not len(shared):
        return out
    places = []
    for side, tokens in zip((left, right), both):
        row = np.repeat(np.arange(len(side)), [len(s) for s in side])
        column = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        hit = shared[column] == tokens
        order = np.argsort(column[hit], kind="stable")
        places.append((row[hit][order], column[hit][order]))
    for low in range(0, len(shared), COLUMNS):
        high = min(low + COLUMNS, len(shared))
        matrix = []
        for (row, column), side in zip(places, (left, right)):
            a, b = np.searchsorted(column, [low, high])
            m = np.zeros((len(side), high - low), np.float32)
            m[row[a:b], column[a:b] - low] = 1
            matrix.append(m)
        out += (matrix[0] @ matrix[1].T).astype(np.uint32)
    return out


def _groups(source: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of rows with equal first columns in sorted batches."""
    key, rows = None, []
    for batch in source:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns)):
                if row[:n_keys] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[:n_keys], []
                rows.append(row[n_keys:])
    if rows:
        yield key, rows


ITEM = ["_h1", "_b1", "_h2", "_b2"]


def fragment_overlaps(shipped: DataFrame) -> DataFrame:
    """For each item and fragment, its classes on both sides and the matrix of partial overlaps."""

    def run(source):
        for key, rows in _groups(source, 5):
            sides = []
            for side in (0, 1):
                own = sorted({(c1, c2): (n, t) for s, c1, c2, n, t in rows if s == side}.items())
                sides.append(own)
            left = sides[0]
            right = sides[1] if key[0] != key[2] or key[1] != key[3] else left
            if not left or not right:
                continue
            sets = [[np.frombuffer(t, U) for _, (_, t) in side] for side in (left, right)]
            names = [np.array([[*k, n] for k, (n, _) in side], np.int64).tobytes() for side in (left, right)]
            yield [[k] for k in (*key, *names, zlib.compress(overlaps(*sets).tobytes(), 1))]

    shipped = shipped.repartition(*ITEM, "_fragment").sortWithinPartitions(*ITEM, "_fragment")
    return _arrow_map(shipped.select(*ITEM, "_fragment", "_side", "_c1", "_c2", "_n", "_tokens"), "_h1 LONG, _b1 INT, _h2 LONG, _b2 INT, _fragment INT, _left BINARY, _right BINARY, _overlap BINARY", run)


def stars(adjacent: np.ndarray) -> np.ndarray:
    """For each node of an adjacency matrix the smallest node of its component."""
    label = np.arange(len(adjacent))
    while True:
        near = np.where(adjacent, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def summed_links(partial: DataFrame, num: int, den: int) -> DataFrame:
    """Stars (_a, _b) over classes, from the overlaps summed over fragments of each item."""

    def run(source):
        for _, rows in _groups(source, 4):
            left, right = (np.frombuffer(rows[0][k], np.int64).reshape(-1, 3) for k in (1, 2))
            total = np.zeros((len(left), len(right)), np.int64)
            for _, names, others, matrix in rows:
                assert names == rows[0][1] and others == rows[0][2]
                total += np.frombuffer(zlib.decompress(matrix), np.uint32).reshape(total.shape)
            union = left[:, 2][:, None] + right[:, 2][None, :] - total
            linked = den * total >= num * union
            nodes = [tuple(x) for x in np.concatenate([left, right])[:, :2].tolist()]
            size = len(nodes)
            adjacent = np.zeros((size, size), bool)
            adjacent[: len(left), len(left) :] = linked
            adjacent |= adjacent.T
            if rows[0][1] == rows[0][2]:  # one block with itself: both sides are the same classes
                k = np.arange(len(left))
                adjacent[k, k + len(left)] = adjacent[k + len(left), k] = True
            label = stars(adjacent)
            pairs = sorted({(nodes[a], nodes[b]) for a, b in enumerate(label) if nodes[a] != nodes[b]})
            if pairs:
                yield [[p[0][0] for p in pairs], [p[0][1] for p in pairs], [p[1][0] for p in pairs], [p[1][1] for p in pairs]]

    partial = partial.repartition(*ITEM).sortWithinPartitions(*ITEM, "_fragment")
    links = _arrow_map(partial.select(*ITEM, "_fragment", "_left", "_right", "_overlap"), "_a1 LONG, _a2 LONG, _b1 LONG, _b2 LONG", run)
    return links.select(*(F.struct(F.col(f"_{x}1").alias("_c1"), F.col(f"_{x}2").alias("_c2")).alias(f"_{x}") for x in "ab")).distinct()


def joined_in_task(edges: DataFrame) -> DataFrame:
    """components() of few edges, by one task."""
    kind = edges.schema["_a"].dataType

    def run(source):
        value, parent = {}, {}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in source:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = [tuple(v.values()) if isinstance(v, dict) else v for v in pair]
                for k, v in zip(keys, pair):
                    value.setdefault(k, v)
                    parent.setdefault(k, k)
                low, high = sorted(map(root, keys))
                parent[high] = low
        found = [(k, r) for k in parent if (r := root(k)) != k]
        yield [value[k] for k, _ in found], [value[r] for _, r in found]

    return _arrow_map(edges.coalesce(1), f"_node {kind.simpleString()}, _root {kind.simpleString()}", run)


def components(links: DataFrame) -> DataFrame:
    """(_node, _root): the smallest node of the component of every linked node that isn't it."""
    edges = checkpointed(links.where("_a != _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(20, 0)")), F.sum(F.xxhash64("_b", "_a").cast("decimal(20, 0)"))).first()
    now = mark(edges)
    if now[0] <= LINKS_IN_TASK:
        return checkpointed(joined_in_task(edges))
    while True:
        before = now
        # large star: larger neighbours of each node go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.min("_b").alias("_m")).select("_a", F.least("_m", "_a").alias("_m"))
        large = both.join(least, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).distinct()
        # small star: smaller neighbours of each node, and itself, go to the smallest of them
        low = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = large.join(low, "_a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(low.select("_a", F.col("_m").alias("_b")))
        edges = checkpointed(small.where("_a != _b").distinct())
        now = mark(edges)
        if now == before:
            break
    return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))


def block_of(home: Column, block: Column) -> Column:
    return F.struct(home.alias("h"), block.cast("int").alias("b"))


def homes_of(prefixes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Homes (_c1, _home, _w: the class's weight), and pairs (_h1, _h2) of homes that meet."""
    sizes = prefixes.groupBy("_token").agg(F.count("*").alias("_size"))
    homes = prefixes.join(sizes, "_token").groupBy("_c1").agg(F.max(F.struct("_size", "_token"))["_token"].alias("_home"), F.first("_n").alias("_n"))
    homes = checkpointed(homes.select("_c1", "_home", "_n", (1 + F.floor(F.col("_n") / WEIGHT)).alias("_w")))
    # homes, and a home with itself, meet if they share as many n-grams as two of their sets must
    met = prefixes.join(homes.select("_c1", "_home"), "_c1").groupBy("_token", "_home").agg(F.count("*").alias("_m"))
    need = homes.groupBy("_home").agg(needed_column(F.min("_n"), num, den).alias("_least"))
    sides = [met.select("_token", F.col("_home").alias(f"_h{k}"), F.col("_m").alias(f"_m{k}")) for k in (1, 2)]
    pairs = (
        sides[0].join(sides[1], "_token").where("_h1 < _h2 OR (_h1 = _h2 AND _m1 > 1)")
        .groupBy("_h1", "_h2").agg(F.count("*").alias("_shared"))
        .join(need.select(F.col("_home").alias("_h1"), F.col("_least").alias("_l1")), "_h1")
        .join(need.select(F.col("_home").alias("_h2"), F.col("_least").alias("_l2")), "_h2")
        .where(F.col("_shared") >= F.least("_l1", "_l2")).select("_h1", "_h2")
    )
    return homes.drop("_n"), checkpointed(pairs)


def placed_homes(homes: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """(_home, _cluster, _large, _blocks) of the homes that meet another or themselves. Homes that
    meet, directly or through others, are a cluster. A large home has _blocks blocks of its own;
    others are in a block of their cluster, whose number is _blocks below 0."""
    used = pairs.select(F.col("_h1").alias("_home")).unionByName(pairs.select(F.col("_h2").alias("_home"))).distinct()
    weights = homes.groupBy("_home").agg(F.sum("_w").alias("_w")).join(used, "_home", "left_semi")
    roots = components(pairs.select(F.col("_h1").alias("_a"), F.col("_h2").alias("_b")))
    clusters = weights.join(roots, weights["_home"] == roots["_node"], "left").select("_home", "_w", F.coalesce("_root", "_home").alias("_cluster"))
    whole = clusters.groupBy("_cluster").agg(F.sum("_w").alias("_all"))
    large = F.col("_w") > block // 2
    shared = F.when(F.col("_all") <= block, -1).otherwise(-1 - F.pmod(F.xxhash64("_home"), F.ceil(2 * F.col("_all") / block)))
    return checkpointed(
        clusters.join(whole, "_cluster").select("_home", "_cluster", (large & (F.col("_all") > block)).alias("_large"), F.when(large & (F.col("_all") > block), F.ceil(2 * F.col("_w") / block)).otherwise(shared).cast("int").alias("_blocks"))
    )


def first_items(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Items (_p, _q: two blocks): every block with itself, and those of homes that meet, unless
    both are large."""
    large = F.col("_large")
    numbers = F.when(large, F.sequence(F.lit(0), F.greatest("_blocks", F.lit(1)) - 1)).otherwise(F.array("_blocks"))
    blocks = placed.select("_home", large, F.transform(numbers, lambda b: block_of(F.when(large, F.col("_home")).otherwise(F.col("_cluster")), b)).alias("_of"))
    sides = [blocks.select(F.col("_home").alias(f"_h{k}"), F.col("_large").alias(f"_g{k}"), F.col("_of").alias(f"_of{k}")) for k in (1, 2)]
    met = pairs.where("_h1 <> _h2").join(sides[0], "_h1").join(sides[1], "_h2").where("NOT (_g1 AND _g2)")
    cross = met.select(F.explode("_of1").alias("_x"), "_of2").select("_x", F.explode("_of2").alias("_y")).select(F.least("_x", "_y").alias("_p"), F.greatest("_x", "_y").alias("_q"))
    alone = blocks.select(F.explode("_of").alias("_p")).select("_p", F.col("_p").alias("_q"))
    return cross.unionByName(alone).distinct()


def links_of(sets: DataFrame, members: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """Stars (_a, _b) of what links within the items. members: (_c1, _block)."""
    sides = [items.select(F.col(f"_{x}").alias("_block"), "_p", "_q", F.lit(k).alias("_side")) for k, x in enumerate("pq")]
    places = members.join(sides[0].unionByName(sides[1].where("_p <> _q")), "_block")
    places = checkpointed(places.select("_c1", "_side", F.col("_p")["h"].alias("_h1"), F.col("_p")["b"].alias("_b1"), F.col("_q")["h"].alias("_h2"), F.col("_q")["b"].alias("_b2")))
    shipped = sets.join(broadcast_if_small(places), "_c1")
    return checkpointed(summed_links(fragment_overlaps(shipped), num, den))


def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with _root, the class that stands for the group they are in so far."""
    roots = components(links).select(F.col("_node")["_c1"].alias("_c1"), F.col("_root")["_c1"].alias("_root"))
    return checkpointed(members.join(roots, "_c1", "left").withColumn("_root", F.coalesce("_root", "_c1")))


def large_links(sets: DataFrame, members: DataFrame, links: DataFrame, pairs: DataFrame, placed: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links between the blocks of large homes, given those within each. members: (_c1, _home,
    _w, _cluster, _block) of the large homes."""
    sets = checkpointed(sets.join(members.select("_c1"), "_c1", "left_semi"))
    # one class of the largest group of each block, the groups' own ones
    most = F.max(F.struct("_m", "_root"))["_root"].alias("_c1")
    heads = grouped(members, links).groupBy("_cluster", "_block", "_root").agg(F.count("*").alias("_m")).groupBy("_cluster", "_block").agg(most).select("_cluster", "_c1").distinct()
    several = heads.groupBy("_cluster").agg(F.count("*").alias("_m")).where("_m > 1")
    heads = checkpointed(heads.join(several, "_cluster").select("_c1", block_of(F.col("_cluster"), F.pmod(F.xxhash64("_c1"), F.ceil(F.col("_m") / block))).alias("_block")))
    joined = links_of(sets, heads, heads.select(F.col("_block").alias("_p"), F.col("_block").alias("_q")).distinct(), num, den)
    # the largest group of a cluster, and the stray classes in blocks with odd numbers
    now = grouped(members, links.unionByName(joined))
    main = now.groupBy("_cluster", "_root").agg(F.count("*").alias("_m")).groupBy("_cluster").agg(F.max(F.struct("_m", "_root"))["_root"].alias("_main"))
    now = now.join(main, "_cluster").withColumn("_stray", (F.col("_root") != F.col("_main")).cast("int"))
    counts = now.groupBy("_home", "_stray").agg(F.ceil(2 * F.sum("_w") / block).alias("_n"))
    own = block_of(F.col("_home"), 2 * F.pmod(F.xxhash64("_c1"), "_n") + F.col("_stray"))
    moved = checkpointed(now.join(counts, ["_home", "_stray"]).select("_c1", own.alias("_block")))
    blocks = counts.groupBy("_home").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda k: block_of(F.col("_home"), 2 * k + F.col("_stray"))))).alias("_of"))
    sides = [blocks.select(F.col("_home").alias(f"_h{k}"), F.col("_of").alias(f"_of{k}")) for k in (1, 2)]
    homes = placed.where("_large").select("_home")
    meet = pairs.where("_h1 <> _h2").unionByName(homes.select(F.col("_home").alias("_h1"), F.col("_home").alias("_h2")))
    items = meet.join(sides[0], "_h1").join(sides[1], "_h2").select(F.explode("_of1").alias("_x"), "_of2").select("_x", F.explode("_of2").alias("_y"))
    items = items.where(F.col("_x")["b"] % 2 + F.col("_y")["b"] % 2 > 0).select(F.least("_x", "_y").alias("_p"), F.greatest("_x", "_y").alias("_q")).distinct()
    return joined.unionByName(links_of(sets, moved, checkpointed(items), num, den))


def near_duplicates(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, fragments: int = FRAGMENTS) -> DataFrame:
    """(_id, _hash, _n, _root, _component) of each row: its text's hash, the size of its set, and
    the smallest class and the smallest id of its component. Sets link when den * |A and B| >= num *
    |A or B|."""
    sc = docs.sparkSession.sparkContext
    seen = checkpointed(described(docs, n, id_col, text_col))
    rows = seen.where("_part IS NULL").select("_id", "_hash", "_n", "_c1", "_c2")
    sketch = summed_sketch(seen.where("_part IS NOT NULL"))
    order, cuts = global_order(sketch, fragments)
    rank, lone = sc.broadcast(order), sc.broadcast(sketch <= 1)  # of fixed size, 5 MB

    classes = rows.where("_id IS NOT NULL AND _c1 IS NOT NULL").groupBy("_c1", "_c2").agg(F.min("_id").alias("_first"))
    all_prefixes = prefix_tokens(docs, n, num, den, rank, lone, id_col, text_col)
    # n-grams in the prefixes of two classes or more, without gathering an n-gram's classes
    several = all_prefixes.groupBy("_token").agg(F.min("_c1").alias("_low"), F.max("_c1").alias("_high")).where("_low < _high").select("_token")
    several = checkpointed(several)
    again = prefix_tokens(docs, n, num, den, rank, lone, id_col, text_col, sc.broadcast(hash_filter(several)))
    prefixes = checkpointed(again.join(several, "_token", "left_semi").distinct())
    # a set with fewer shared n-grams than a link needs has none
    enough = prefixes.groupBy("_c1").agg(F.count("*").alias("_m"), needed_column(F.first("_n"), num, den).alias("_least")).where("_m >= _least").select("_c1")
    prefixes = checkpointed(prefixes.join(enough, "_c1", "left_semi"))
    homes, pairs = homes_of(prefixes, num, den)
    placed = placed_homes(homes, pairs, block)
    where_large = block_of(F.col("_home"), F.pmod(F.xxhash64("_c1"), F.greatest("_blocks", F.lit(1))))
    members = checkpointed(homes.join(placed, "_home").select("_c1", "_home", "_w", "_cluster", "_large", F.when(F.col("_large"), where_large).otherwise(block_of(F.col("_cluster"), F.col("_blocks"))).alias("_block")))

    # the sets of these classes, each by the one document whose text stands for it
    wanted = checkpointed(members.join(classes, "_c1").groupBy("_first").agg(F.collect_set("_c1").alias("_classes")))
    some = let_through(docs, sc.broadcast(hash_filter(wanted.select(F.xxhash64("_first")))), id_col, text_col)
    texts = some.join(wanted, some[id_col] == wanted["_first"]).select(text_col, "_classes")
    sets = checkpointed(candidate_sets(texts, n, rank, cuts, text_col))
    links = links_of(sets, members.select("_c1", "_block"), checkpointed(first_items(pairs, placed)), num, den)
    large = members.where("_large").drop("_large")
    if not large.isEmpty():
        links = links.unionByName(large_links(sets, large, links, pairs, placed, num, den, block))
    roots = components(links)

    klass = F.struct("_c1", "_c2")
    of_class = classes.select(klass.alias("_node"), "_first").join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    first = of_class.groupBy("_root").agg(F.min("_first").alias("_component"))
    by_class = of_class.join(first, "_root").select("_node", "_root", "_component")
    return (
        rows.withColumn("_node", F.when(F.col("_id").isNotNull() & F.col("_c1").isNotNull(), klass))
        .join(by_class, "_node", "left")
        .select("_id", "_hash", "_n", "_root", F.when(F.col("_c1").isNull(), F.col("_id")).otherwise(F.col("_component")).alias("_component"))
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates the one with the smallest id,
    and of equal rows one; rows without an id or without words all stay."""
    found = near_duplicates(docs.select(id_col, text_col), n, num, den, id_col, text_col)
    keep = found.where("_id = _component AND _root IS NOT NULL").groupBy("_id", "_root").agg(F.min("_hash").alias("_keep"))
    marked = as_one(docs, _own_id=F.col(id_col), _own_hash=F.xxhash64(text_col))
    same = (F.col("_own_id") == F.col("_id")) & (F.col("_own_hash") == F.col("_keep"))
    single = marked.join(keep, same).dropDuplicates(["_own_id", "_own_hash"]).select("_doc.*")
    wordless = F.btrim(F.coalesce(text_col, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    return single.unionByName(docs.where(wordless | F.col(id_col).isNull()))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_duplicates(docs, 3, 90, 100).select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"))
