"""Benchmark leaks by template windows.

Words become templates: a number, a name or a unit is replaced by a typed placeholder, everything else is lower-cased
without the marks around it. Windows of template words of the benchmark are hashed and joined with those of every document.
Along a run of matching windows each word of the item behind a placeholder must have one word of the text, which catches a
question asked again with other numbers and leaves alone texts that merely have numbers in the same places. Windows of the
case-folded words themselves are joined beside them, so ten equal words are found whatever their case and their neighbours.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LITERALS = 10, 5
BLOCK_WORDS = 500_000
"""Benchmark words whose windows are broadcast at once (about 20 MB); a larger benchmark is joined block by block."""
WORD = re.compile(r"[^\t-\r ]+")
NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*([a-zA-Z%°µ]{0,4})")
# Units that stand as words.
UNITS = frozenset("km kg cm mm mg ml mph kmh kwh kw mhz ghz kb mb gb tb lb lbs oz ft inch inches mile miles meter meters metre metres gram grams kilogram kilograms liter liters litre litres hour hours minute minutes second seconds day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent degree degrees".split())
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„…–—¿¡"
NUM, NAME, UNIT = "\x00num", "\x00name", "\x00unit"


def template(word: str) -> str | None:
    """The template word; None for a word of marks only. Applied to both sides, so equal texts always have equal templates."""
    bare = word.strip(MARKS)
    if not bare:
        return None
    if bare[0].isdigit() and (m := NUMBER.fullmatch(bare)):
        return NUM + (UNIT if m[1] else "")
    low = bare.lower()
    if low in UNITS:
        return UNIT
    if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        return NAME
    return low


def folded(word: str) -> str:
    return word.strip(MARKS).casefold()


class Coder:
    """Codes of the words of a text, each distinct word worked out once per task: a row of template words, one of folded words."""

    MOST = 500_000

    def __init__(self):
        self.known: dict[str, int] = {}
        self.exact: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[list[str], np.ndarray]:
        words = WORD.findall(text)
        known, exact = self.known, self.exact
        if len(known) > self.MOST:
            known.clear()
            exact.clear()
        for w in words:
            if w not in known:
                t = template(w)
                known[w] = 0 if t is None else xxhash.xxh64_intdigest(t) | 1
                exact[w] = 0 if t is None else xxhash.xxh64_intdigest(folded(w)) | 1
        codes = np.empty((2, len(words)), np.uint64)
        for row, code in enumerate((known, exact)):
            codes[row] = np.fromiter(map(code.__getitem__, words), np.uint64, len(words))
        return words, codes


def hashes(codes: np.ndarray, window: int) -> np.ndarray:
    n = len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return h ^ (h >> np.uint64(29))


class Index:
    """Windows of benchmark items by hash. Items of equal words are one entry under the smallest id.

    An item shorter than the window is one window of its own length: of folded words always, of template words if it has
    ``literals`` literal ones.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, literals: int = LITERALS):
        coder = Coder()
        self.window, self.literals = window, literals
        seen: dict[tuple, int] = {}
        self.items: list[tuple[int, list[str], list[str]]] = []
        found: dict[tuple[int, int], list] = {}
        for i, text in sorted(items):
            words, codes = coder(text)
            at = np.flatnonzero(codes[0])
            words, codes = [words[k] for k in at.tolist()], codes[:, at]
            if not words or seen.setdefault(tuple(words), i) != i:
                continue
            shapes = [template(w) for w in words]
            place = len(self.items)
            self.items.append((i, words, shapes))
            size = min(window, len(words))
            for row in (0, 1):
                if row or size == window or sum(s[0] != "\x00" for s in shapes) >= literals:
                    for q, h in enumerate(hashes(codes[row], size).tolist()):
                        found.setdefault((row, size), []).append((h, place, q))
        self.tables = {}
        for key, rows in found.items():
            rows.sort()
            self.tables[key] = (np.array([h for h, _, _ in rows], np.uint64), [(p, q) for _, p, q in rows], self.sieve(rows))

    @staticmethod
    def sieve(rows: list) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[np.array([h for h, _, _ in rows], np.uint64) >> np.uint64(44)] = True
        return bits

    def matches(self, words: list[str], codes: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
        """``(item, first word, words, changed slots, exact)`` of each leak; places count the words of the text."""
        at = np.flatnonzero(codes[0])
        codes = codes[:, at]
        runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for (row, size), (keys, places, sieve) in self.tables.items():
            h = hashes(codes[row], size)
            near = np.flatnonzero(sieve[h >> np.uint64(44)]) if len(h) else h
            if not len(near):
                continue
            low = np.searchsorted(keys, h[near], "left")
            high = np.searchsorted(keys, h[near], "right")
            for p, a, b in zip(near.tolist(), low.tolist(), high.tolist()):
                for place, q in places[a:b]:
                    runs.setdefault((place, p - q, row), []).append((p, size))
        best: dict[int, tuple] = {}
        for (place, shift, row), hits in sorted(runs.items()):
            item, theirs, shapes = self.items[place]
            hits.sort()
            begin = 0
            for k in range(1, len(hits) + 1):
                if k < len(hits) and hits[k][0] == hits[k - 1][0] + 1:
                    continue
                a, b = hits[begin][0], hits[k - 1][0] + hits[k - 1][1]
                begin = k
                own = [words[i] for i in at[a:b].tolist()]
                for c, d, changed in self.parts(own, theirs[a - shift : b - shift], shapes[a - shift : b - shift], bool(row), hits[k - 1][1]):
                    made = (item, int(at[a + c]), int(at[a + d - 1]) - int(at[a + c]) + 1, changed, changed == 0)
                    if item not in best or made[2] > best[item][2]:
                        best[item] = made
        return sorted(best.values())

    def parts(self, own: list[str], theirs: list[str], shapes: list[str], exact: bool, size: int) -> list[tuple[int, int, int]]:
        """``(begin, end, changed slots)`` of the longest parts of a run in which each slot of the item has one value.

        A part of equal words counts from one window. One with changed slots needs literal words enough, and two windows
        where it is not the whole run: by chance some part of any run agrees.
        """
        n, begin, cuts = len(own), 0, []
        values: dict[tuple[str, str], tuple[str, int]] = {}
        literal, changed = [0], [0]
        for k, (mine, other, shape) in enumerate(zip(own, theirs, shapes)):
            x, y = folded(other), folded(mine)
            slot = shape[0] == "\x00"
            literal.append(literal[-1] + (not slot))
            changed.append(changed[-1] + (slot and x != y))
            after = begin
            if x != y if exact else template(mine) != shape:  # two words with one hash
                after = k + 1
            elif slot and not exact:
                value, last = values.get((shape, x), (y, -1))
                after = max(begin, last + 1) if value != y else begin
                values[shape, x] = (y, k)
            if after > begin:
                cuts.append((begin, k))
                begin = after
        cuts.append((begin, n))
        out = []
        for a, b in cuts:
            slots = changed[b] - changed[a]
            least = size if not slots or b - a == n else 2 * self.window
            if b - a >= least and (not slots or literal[b] - literal[a] >= self.literals):
                out.append((a, b, slots))
        return out


TYPE = "array<struct<item_id: bigint, first_word: bigint, n_words: bigint, changed_slots: bigint, exact: boolean>>"


def indexes(benchmark: DataFrame, id_col: str = "item_id", window: int = WINDOW, literals: int = LITERALS, block_words: int = BLOCK_WORDS):
    """Broadcast indexes of blocks of the benchmark, each of a bounded number of words."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    n = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-n // block_words))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r.i, r.t) for r in rows], window, literals))


def leaks(text: Column, index) -> Column:
    """The leaks of a text from one block of the benchmark; none for a null text."""

    @F.pandas_udf(TYPE)
    def found(batches: pd.Series) -> pd.Series:
        return batches.map(lambda t: [dict(zip(("item_id", "first_word", "n_words", "changed_slots", "exact"), m)) for m in one(t)])

    coder = []

    def one(t):
        if not t or not index.value.tables:
            return []
        if not coder:
            coder.append(Coder())
        return index.value.matches(*coder[0](t))

    return found(text)


def leaking(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, changed_slots, exact``: one row per leaking row and item, the longest run.

    Nothing is returned for null texts, for items without id or text, or from an empty table. Repeated rows return
    repeated results; other columns are not carried.
    """
    made = None
    for index in indexes(benchmark, window=window, literals=literals):
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(leaks(F.col("text").cast("string"), index)).alias("m")).select("doc_id", "m.*")
        made = part if made is None else made.unionByName(part)
    return made


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """The rows of ``docs`` without any leak, all columns as they are; rows with a null text stay."""
    for index in indexes(benchmark, window=window, literals=literals):
        docs = docs.where(F.size(leaks(docs["text"].cast("string"), index)) == 0)
    return docs
