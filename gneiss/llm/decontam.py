"""Benchmark decontamination by template canonicalisation.

Texts are cut to words (letters and digits, lower case); numbers (digits or words), units after numbers and names (capitalised inside a
sentence) become typed placeholders; a second template takes every capitalised word for a name, as names also begin sentences.
Windows of words, literal and with the placeholders of either template, are hash-joined with those of the
benchmark. A run of matching windows along one alignment is a hit if it is long enough. Literal windows count as they are,
those with placeholders only if their slots are consistent: each name (and unit) of the item stands for one of the text,
and the other way round, so a question with other numbers and names is caught and a chance likeness of templates isn't.
Numbers may become equal or differ anew where the words outside slots alone make the run long enough; in a shorter run they
have to be consistent too.
Benchmarks go out in blocks of bounded size, to the documents.

Cases: null and empty texts, and items without words, match nothing; an item shorter than a window must occur whole; null ids
are carried as they are; repeated items and documents match each for itself; texts are read whole; empty tables give an empty
result; other columns are ignored (``clean`` keeps those of the documents).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, hash_words, materialize, mix, pieces, raw_bytes, small_batches, trim, windows

WINDOW = 8
LEAST_WORDS = 13  # words that a run must cover, or half of the item if that is less
ITEM_ROWS = 20_000  # items that go out at once
ITEM_BYTES = 16 << 20  # and bytes of their texts, unless one item has more: about 40 bytes a word are broadcast
U = np.uint64

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 13, 33, 46, 63]] = True
UNITS = frozenset(
    "m cm mm km kg g mg lb lbs oz ml l liter liters litre litres meter meters metre metres mile miles inch inches foot feet yard yards s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent pct degree degrees celsius fahrenheit kmh mph watt watts volt volts joule joules newton newtons hz".split()
)
#: Of the languages at hand, without those that are mostly other words (ein, un, once).
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil".split()
)
NUMBER, UNIT, NAME = (U(x) for x in (0x6E75, 0x756E, 0x6E61))


def _hashes(words: frozenset[str]) -> np.ndarray:
    data, at = raw_bytes(pa.array(sorted(words)))
    return np.sort(hash_words(data, at[:-1], at[1:]))


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: each word's hash, its hash or placeholder, the same with all capitalised words as names, and each
    text's first word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.uint64)
        return z, z, z, np.zeros(len(offsets), np.int64)
    inside = _ALNUM[data]
    marks = np.flatnonzero(data[:-2] == 0xE2) if n > 2 else np.zeros(0, np.int64)
    marks = marks[data[marks + 1] == 0x80]  # general punctuation is no letter
    for k in range(3):
        inside[marks + k] = False
    digit = _DIGIT[data]
    point = np.zeros(n, bool)
    point[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    edges = offsets[1:-1]
    point[edges[edges < n]] = False
    point[edges[edges > 0] - 1] = False
    inside |= point
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    of = np.searchsorted(starts, offsets)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return z, z, z, of
    low = data
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1
    accent = accent[(data[accent] >= 0x80) & (data[accent] <= 0x9E) & (data[accent] != 0x97)]
    if len(accent):
        low = data.copy()
        low[accent] += 0x20
    h = hash_words(low, starts, ends, _LOWER)
    letters = np.concatenate([[0], np.cumsum(~(digit | point))])
    number = letters[ends] == letters[starts]
    number |= _NUMBER_HASHES[np.minimum(np.searchsorted(_NUMBER_HASHES, h), len(_NUMBER_HASHES) - 1)] == h
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data] & ~point)])
    initial = np.ones(len(starts), bool)
    initial[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    initial[of[:-1][of[:-1] < len(starts)]] = True
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    if len(accent):
        raised = np.zeros(n, bool)
        raised[accent - 1] = True
        capital |= raised[starts]
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1]
    after_number[of[:-1][of[:-1] < len(starts)]] = False
    unit = np.zeros(len(starts), bool)
    at = np.flatnonzero(after_number)
    if len(at):
        unit[at] = np.isin(h[at], _UNIT_HASHES)
    template = h.copy()
    template[number] = NUMBER
    template[unit] = UNIT
    name = capital & ~number & ~unit
    wide = template.copy()
    wide[name] = NAME
    template[name & ~initial] = NAME
    return h, template, wide, of


def _cover(windows: np.ndarray) -> np.ndarray:
    """Places in the item of the words that windows cover, ascending."""
    return np.unique(np.concatenate([np.arange(p, p + s) for p, s in windows[:, 3:5].tolist()])) if len(windows) else np.zeros(0, np.int64)


def _clashes(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Of pairs of values, whether one of the two is also in another pair."""
    pairs, at = np.unique(np.stack([mine, theirs], 1), axis=0, return_inverse=True)
    clash = np.zeros(len(pairs), bool)
    for side in (0, 1):
        _, k, n = np.unique(pairs[:, side], return_inverse=True, return_counts=True)
        clash |= n[k] > 1
    return clash[at.ravel()]


class Benchmark:
    """The windows of a block of items, sorted by hash."""

    def __init__(self, ids: list, column: pa.Array, width: int, templates: bool = True):
        self.ids, self.width = ids, width
        data, offsets = raw_bytes(column)
        self.h, self.t, self.wide, self.of = tokens(data, offsets)
        self.words = np.diff(self.of)
        hashes, items, at = [], [], []
        for i, n in enumerate(self.words.tolist()):
            a = self.of[i]
            for stream, salt in ((self.h, U(0)), (self.t, U(1)), (self.wide, U(2)))[: 3 if templates else 1]:
                w = windows(stream[a : a + n], min(n, width)) if n else np.zeros(0, np.uint64)
                w = mix(w ^ (U(min(n, width)) << U(8)) ^ salt)
                if salt:  # a window of placeholders alone says nothing
                    plain = np.concatenate([[0], np.cumsum(stream[a : a + n] == self.h[a : a + n])])
                    size = min(n, width)
                    good = (plain[size:] - plain[:-size]) * 2 >= size if n else np.zeros(0, bool)
                    changed = (plain[size:] - plain[:-size]) < size if n else np.zeros(0, bool)
                    keep = np.flatnonzero(good & changed)
                else:
                    keep = np.arange(len(w))
                hashes.append(w[keep])
                items.append(np.full(len(keep), i))
                at.append(keep)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(items)[order] if items else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hash >> U(42)).astype(np.int64)] = True
        self.short = sorted({int(n) for n in self.words if 0 < n < width})

    def _agreeing(self, run: np.ndarray, template: np.ndarray, least: int, h: np.ndarray) -> np.ndarray:
        """Of the item's words that a run covers, those in literal windows or in windows whose slots, by this template, are
        consistent."""
        item, shift = int(run[0, 1]), int(run[0, 2])
        covered, at, literal = _cover(run), run[:, 3], run[:, 5] == 0
        kinds = template[self.of[item] : self.of[item] + self.words[item]]
        plain = kinds == self.h[self.of[item] : self.of[item] + self.words[item]]

        def without(slots: np.ndarray, run_covers: np.ndarray) -> np.ndarray:
            bad = slots[_clashes(self.h[slots + self.of[item]], h[slots + shift])]
            if not len(bad):
                return run_covers
            clear = np.searchsorted(bad, at) == np.searchsorted(bad, at + run[:, 4])
            return np.intersect1d(run_covers, _cover(run[clear | literal]), assume_unique=True)

        number = kinds[covered] == NUMBER
        kept = without(covered[~plain[covered] & ~number], covered)
        if plain[kept].sum() >= least:
            return kept
        return without(covered[number], kept)

    def hits(self, h: np.ndarray, t: np.ndarray, wide: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
        """(text, item, words covered, words of the item, whether slots differ) of a run of texts."""
        found = []
        for size in (*self.short, self.width):
            for stream, salt in ((h, U(0)), (t, U(1)), (wide, U(2))):
                w = mix(windows(stream, size) ^ (U(size) << U(8)) ^ salt)
                q = np.flatnonzero(self.filter[(w >> U(42)).astype(np.int64)])
                if not len(q):
                    continue
                left, right = np.searchsorted(self.hash, w[q], "left"), np.searchsorted(self.hash, w[q], "right")
                n = right - left
                if not n.any():
                    continue
                q = np.repeat(q, n)
                k = np.repeat(left, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                text = np.searchsorted(of, q, "right") - 1
                whole = (q + size <= of[text + 1]) & (np.minimum(self.words[self.item[k]], self.width) == size)
                found.append(np.stack([text, self.item[k], q - self.at[k], self.at[k], np.full(len(q), size), np.full(len(q), int(salt))], 1)[whole])
        if not found:
            return
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        cut = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)]))
        best: dict[tuple[int, int], tuple[int, bool]] = {}
        for a, b in zip(cut, np.append(cut[1:], len(rows))):
            text, item, shift = (int(x) for x in rows[a, :3])
            run, n = rows[a:b], int(self.words[item])
            least = min(LEAST_WORDS, max(1, math.ceil(n / 2)))
            if len(_cover(run)) < least:
                continue
            strict = run[run[:, 5] < 2]  # names that begin sentences may clash where the same words match literally
            covered = max((self._agreeing(w, template, least, h) for w, template in ((strict, self.t), (run, self.wide)) if len(w)), key=len)
            if len(covered) < least:
                continue
            differ = self.h[covered + self.of[item]] != h[covered + shift]
            key = (text, item)
            if key not in best or best[key][0] < len(covered):
                best[key] = (len(covered), bool(differ.any()))
        for (text, item), (n, differ) in best.items():
            yield text, item, n, int(self.words[item]), differ


def _blocks(benchmark: DataFrame, width: int, item_rows: int, templates: bool) -> Iterator[Benchmark]:
    """The items with a text in blocks of bounded size, each loaded when it is asked for."""
    items = benchmark.select("item_id", "text").where("text is not null")
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(rows / item_rows), math.ceil((size or 0) / ITEM_BYTES))
    for n in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        table = part.toArrow()
        yield Benchmark(table.column("item_id").to_pylist(), table.column("text").combine_chunks(), width, templates)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, item_rows: int = ITEM_ROWS, templates: bool = True) -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, words (covered), coverage (of the item), changed (whether
    slots were filled anew). ``docs`` has doc_id and text, ``benchmark`` item_id and text; without ``templates`` only literal
    windows count."""
    small_batches(docs.sparkSession)
    out = None
    for block in _blocks(benchmark, width, item_rows, templates):
        found = _scan(docs, docs.sparkSession.sparkContext.broadcast(block), benchmark)
        found = found if out is None else materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(docs: DataFrame, sent, benchmark: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    arrow = [to_arrow_type(k) for k in kinds]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = sent.value
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            rows = []
            for first, _, raw, at in pieces(data, offsets):
                rows += [(first + i, *x) for i, *x in bench.hits(*tokens(raw, at))]
            if rows:
                who, item, words, of, changed = zip(*rows)
                columns = [
                    batch.column(0).take(pa.array(who)).cast(arrow[0]), pa.array([bench.ids[i] for i in item], arrow[1]), pa.array(words, pa.int64()),
                    pa.array([w / n for w, n in zip(words, of)], pa.float64()), pa.array(changed, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "words", "coverage", "changed"])

    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, words long, coverage double, changed boolean"
    return docs.select("doc_id", "text").mapInArrow(f, schema)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark; each row is judged by its own text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for block in _blocks(benchmark, width, ITEM_ROWS, True):
        if not len(block.hash):
            continue
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def f(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = raw_bytes(batch.column(at))
                kept = np.ones(batch.num_rows, bool)
                for first, _, raw, to in pieces(data, offsets):
                    for i, *_ in sent.value.hits(*tokens(raw, to)):
                        kept[first + i] = False
                yield batch.filter(pa.array(kept))
            trim()

        docs = docs.mapInArrow(f, docs.schema)
    return docs


def op10_decontam(spark, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
