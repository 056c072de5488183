"""License notices: exact phrases, and short notices with a few edits.

A notice that may hold k edits is split into k + 1 seeds; by the pigeonhole principle one of them
stands unedited in every such occurrence. An automaton finds the seeds, and the regex library's
bounded-error matching verifies the window around each and gives the span and its edits. A match
takes whole words: blanks stand before and after it.

Defined results: a null text counts as empty; a null id stays null; every row of the input gives
one row; texts are searched whole; of overlapping matches of one notice the one with the fewest
edits, then the first, is kept; other columns of the input are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.llm.common import map_batches, read_table, worker_cache

# Phrases that are found exactly, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short notices (words, one blank between) that may hold edits, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2": "apache-2",
    "licensed under the apache license": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by-4",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Edits allowed: one for each so many characters of a notice, and at most so many.
CHARS_PER_EDIT, MOST_EDITS = 10, 6

#: In UTF-8, bytes outside words become blanks and A-Z lower case; all of a non-ASCII character's bytes stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def edits_of(notice: str) -> int:
    return min(MOST_EDITS, max(1, len(notice) // CHARS_PER_EDIT))


def seeds_of(notice: str) -> list[tuple[str, int]]:
    """(seed, its place) of edits + 1 pieces that make up the notice."""
    n = edits_of(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [(n, label, edits_of(n), regex.compile(f"(?b)(?<= )(?:{regex.escape(n)}){{e<={edits_of(n)}}}(?= )")) for n, label in notices.items()]
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list] = {}
        for k, (n, *_) in enumerate(self.notices):
            for seed, at in seeds_of(n):
                places.setdefault(seed, []).append((k, at))
        for seed, where in places.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def exact(self, joined: bytes) -> list[tuple[str, int]]:
        """(label, word) of every place of a phrase in blank-joined, blank-framed words."""
        out = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                out.append((label, joined.count(b" ", 0, at)))
                at = joined.find(phrase, at + 1)
        return out

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By notice, disjoint stretches of the text in which an occurrence with a seed must lie."""
        out: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for k, at in where:
                notice, _, edits, _ = self.notices[k]
                low = max(0, end + 1 - size - at - edits)
                high = min(len(text), end + 2 + len(notice) - at - size + edits)  # a blank follows
                had = out.setdefault(k, [])
                if had and low <= had[-1][1] and low >= had[-1][0]:
                    had[-1][1] = max(high, had[-1][1])
                else:
                    had.append([low, high])
        return out

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, notice length) in blank-joined words, disjoint by notice."""
        out = []
        for k, stretches in self.windows(text).items():
            notice, label, edits, pattern = self.notices[k]
            found, parts = [], [tuple(s) for s in stretches]
            while parts:  # the best match of each part, then what lies before and after it
                low, high = parts.pop()
                if high - low >= len(notice) - edits and (m := pattern.search(text, low, high)):
                    found.append((sum(m.fuzzy_counts), m.start(), m.end()))
                    parts += [(low, m.start()), (m.end(), high)]
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(found):
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    out.append((label, start, end, edits, len(notice)))
        return sorted(out, key=lambda s: (s[1], s[0], s[2]))

    def __call__(self, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ")
        words = [w for w in words if w] if b"" in words else words
        joined = b" " + b" ".join(words) + b" "
        base = self.exact(joined)
        plain = joined.decode("utf-8", "surrogatepass")
        spans = []
        if found := self.fuzzy(plain):
            origin = [m.span() for m in WORDS.finditer(text)]
            starts = [0]
            for a, b in origin:
                starts.append(starts[-1] + b - a + 1)
            starts = [s + 1 for s in starts[:-1]]  # of each word in the joined text
            for label, start, end, edits, size in found:
                first = max(0, bisect_right(starts, start) - 1)
                last = max(first, bisect_right(starts, end - 1) - 1)
                spans.append({"label": label, "first_word": first, "last_word": last, "start": origin[first][0], "end": origin[last][1], "edits": edits, "size": size})
        return len(words), base, spans


def find_licenses(docs: DataFrame, phrases: dict = PHRASES, notices: dict = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, places ARRAY<STRUCT<label, word>> of the exact phrases, and spans of notices
    with their edits: words from 0, start and end in code points of the text."""

    def setup():
        cache = worker_cache()
        key = ("licenses", str(phrases), str(notices))
        scan = cache.get(key) or cache.setdefault(key, Scanner(phrases, notices))

        def kernel(ids, texts):
            found = [scan(t or "") for t in texts]
            return [ids, [f[0] for f in found], [[{"label": a, "word": w} for a, w in f[1]] for f in found], [f[2] for f in found]]

        return kernel

    kind = dict(docs.dtypes)[id_col]
    span = "STRUCT<label: STRING, first_word: LONG, last_word: LONG, start: LONG, `end`: LONG, edits: INT, size: INT>"
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, n_words LONG, places ARRAY<STRUCT<label: STRING, word: LONG>>, spans ARRAY<{span}>", setup)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    of_places, words = F.transform("places", lambda p: p["label"]), F.transform("places", lambda p: p["word"])
    of_spans = F.transform("spans", lambda s: s["label"])
    near = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / s["size"]))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])), ",")
    return find_licenses(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        labels(of_places).alias("base_labels"), labels(of_places, of_spans).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(near, F.lit(0.0))).alias("score"),
        spans.alias("spans"),
    )
