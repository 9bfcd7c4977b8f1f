"""Benchmark decontamination by template canonicalisation.

Every word becomes a template token: numbers, names and units become typed placeholders, other words are lower-cased without the punctuation
around them. Windows of five template tokens of the items and of the documents are hash-joined, which also finds questions
whose numbers, names or units were replaced. Whether it is the same question is then a matter of slots: over the matched
windows of an occurrence of the item, each value of the item must stand for one value of the document and the other way round; windows that disagree with
the mapping most windows support do not count. A document leaks an item if the windows that count are at least
``threshold`` of the item's, in one occurrence or in all together; the best counts.

An item is looked up by its finders alone: as many of its windows as it takes for every occurrence that reaches the threshold to
have one of them, and those first that the fewest items share, so a stock phrase of many items finds none of them.

Benchmarks of up to ``block`` characters are the broadcast side of the hash join: documents stay where they are. Larger ones are joined by
shuffle: the finders' hashes of the documents (behind a filter of fixed size) meet those of the items, and only the pairs found this way have their
texts brought together, once for equal texts. Slots are made for matched windows only.

Defined results: null texts count as empty and leak nothing; items shorter than a window are one window; all windows of an item count;
items with fewer than ``literals`` literal words (or fewer than a window holds) are found by their exact values only, since any slots would
fit them; of slots that as many windows support the lesser value goes first; texts are read whole, however long; repeated rows are reported each; a null document or
item id is reported as null; ids may be of any type; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compliq.llm.common import bits_of, materialize, slices, table, text_of
from compliq.llm.words import Words

#: Units and number words. Fixed values.
UNITS = frozenset("mm cm dm m km mg g kg t ml cl l s min h hr hrs ms mph kph kmh km/h m/s in ft yd mi lb lbs oz gal usd eur gbp dollar dollars euro euros cent cents pound pounds percent % inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres gram grams kilogram kilograms ton tons tonne tonnes liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years degree degrees watt watts volt volts joule joules newton newtons".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
DIGITS = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-zA-Z]{1,3})?")
#: Bits by which a hash of the filter before the shuffle join is known: 8 MB.
FILTER_BITS = 26
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """A set of hashes that is asked for many at once."""

    def __init__(self, found):
        self.sorted = np.array(sorted(found), np.uint64)
        bits = min(24, max(10, (16 * len(self.sorted)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[self.sorted >> self.shift] = True

    def places(self, h: np.ndarray, inside: np.ndarray | bool = True) -> np.ndarray:
        """Where ``h`` has one of them."""
        at = np.flatnonzero(self.some[h >> self.shift] & inside)
        if not len(at):
            return at
        near = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == h[at]]


def codes(tokens) -> np.ndarray:
    """The codes of tokens, that is the hashes of words that say so."""
    return Words(list(tokens)).hash if tokens else np.zeros(0, np.uint64)


class Fixed:
    """Codes of the placeholders, and which codes are units and number words; made when first asked for."""

    def __init__(self):
        self.number, self.name, self.unit = (np.uint64(x) for x in (1, 2, 3))
        self.units, self.numbers = Hashes(codes(sorted(UNITS)).tolist()), Hashes(codes(sorted(NUMBER_WORDS)).tolist())


_FIXED: list[Fixed] = []


def fixed() -> Fixed:
    if not _FIXED:
        _FIXED.append(Fixed())
    return _FIXED[0]


class Texts(Words):
    """Words with their templates: ``codes``, which for numbers, names and units are those of placeholders, and ``kinds`` (codes of placeholders, 0 for literal words).

    A word with one capital at its start is a name, unless a sentence starts there.
    """

    def __init__(self, texts: list[str]):
        super().__init__(texts)
        f, n = fixed(), len(self.hash)
        kinds = np.zeros(n, np.uint64)
        first = np.append(True, self.ends[:-1]) if n else np.zeros(0, bool)
        first[self.begin[self.begin < self.end]] = True
        kinds[self.named & ~first] = f.name
        kinds[f.numbers.places(self.hash)] = f.number
        kinds[[i for i in np.flatnonzero(self.digits).tolist() if DIGITS.fullmatch(self.core(i))]] = f.number
        kinds[f.units.places(self.hash)] = f.unit
        self.kinds, self.codes = kinds, np.where(kinds > 0, kinds, self.hash)
        self.room = np.repeat(self.end, self.end - self.begin) - np.arange(n)

    def windows(self, size: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that begin at each word, by their codes or by their values, and which of them lie inside a text."""
        codes = self.hash if exact else self.codes
        m = max(len(codes) - size + 1, 0)
        h = np.zeros(m, np.uint64)
        for i in range(size):
            h = h * _BASE + codes[i : i + m]
            h ^= h >> np.uint64(29)
        return h, self.room[:m] >= size

    def value(self, at: int) -> str:
        return self.core(at).lower()


class Entry(NamedTuple):
    """An item as it is looked up: by templates or by exact values."""

    number: int
    kinds: list
    values: list
    n: int
    size: int
    exact: bool
    hashes: list[int]
    literals: list[int]


def entries(items: list[str], window: int, literals: int, threshold: float) -> Iterator[Entry]:
    for number, text in enumerate(items):
        t = Texts([text])
        length = len(t.codes)
        size = min(window, length)
        if not size:
            continue
        kinds, values = t.kinds.tolist(), [t.value(i) for i in range(length)]
        n, need = length - size + 1, min(literals, size)
        count = [kinds[p : p + size].count(0) for p in range(n)]
        # a first word with a capital may count as a name elsewhere, which a short item cannot spare
        ways = [True] if kinds.count(0) < need else [False, True] if n - 1 < threshold * n else [False]
        for exact in ways:
            yield Entry(number, kinds, values, n, size, exact, t.windows(size, exact)[0].tolist(), count)


def n_finders(n: int, threshold: float) -> int:
    """So many windows of n that those left out are too few for the threshold."""
    return min(n, n - math.ceil(threshold * n) + 1)


class Index:
    """Entries of items, and their finders by size, way and hash. What else an entry has is looked up where a finder was met."""

    def __init__(self, items: list[tuple], window: int, literals: int, threshold: float = 0.8):
        self.ids = [i for i, _ in items]
        self.entries = list(entries([x for _, x in items], window, literals, threshold))
        shared = Counter((e.size, e.exact, h) for e in self.entries for h in set(e.hashes))
        finders, self.rest = defaultdict(lambda: defaultdict(list)), []
        for k, e in enumerate(self.entries):
            order = sorted(range(e.n), key=lambda p: (shared[e.size, e.exact, e.hashes[p]], -e.literals[p], p))  # noqa: B023
            m = n_finders(e.n, threshold)
            for p in sorted(order[:m]):
                finders[e.size, e.exact][e.hashes[p]].append((k, p))
            rest = defaultdict(list)
            for p in sorted(order[m:]):
                rest[e.hashes[p]].append(p)
            self.rest.append((Hashes(rest), dict(rest)) if rest else None)
        self.finders = {way: (Hashes(found), dict(found)) for way, found in finders.items()}

    def search(self, text: str, threshold: float) -> list[tuple]:
        """(item id, share of its windows that count, windows that count, whether any slot differs)."""
        return [(self.ids[number], *found) for _, number, *found in self.search_all([text], threshold)]

    def search_all(self, texts: list[str], threshold: float) -> list[tuple]:
        """(text's number, item's number, share, windows, changed)."""
        t = Texts(texts)
        hits, made = defaultdict(list), {}
        for way, (hashes, places) in self.finders.items():
            h, inside = made[way] = t.windows(*way)
            at = hashes.places(h, inside)
            for d, k in zip(at.tolist(), np.searchsorted(t.end, at, side="right").tolist(), strict=True):
                for entry, p in places[int(h[d])]:
                    hits[k, entry].append((d, p))
        best: dict[tuple[int, int], tuple[int, bool, int]] = {}
        for (k, entry), pairs in hits.items():
            e = self.entries[entry]
            least = threshold * e.n
            if self.rest[entry]:
                hashes, places = self.rest[entry]
                if len({p for _, p in pairs}) + sum(map(len, places.values())) < least:
                    continue
                begin, h = int(t.begin[k]), made[e.size, e.exact][0][t.begin[k] : max(t.end[k] - e.size + 1, t.begin[k])]
                pairs = sorted(pairs + [(begin + d, p) for d in hashes.places(h).tolist() for p in places[int(h[d])]])
            for group in _occurrences(pairs, least):
                good, changed = _judge(group, e, t)
                was = best.get((k, e.number))
                if good >= least and (was is None or (good, not changed) > (was[0], not was[1])):
                    best[k, e.number] = good, changed, e.n
        return [(k, number, good / n, good, changed) for (k, number), (good, changed, n) in sorted(best.items())]


def _occurrences(pairs: list[tuple[int, int]], least: float) -> Iterator[list[tuple[int, int]]]:
    """Groups of matched windows (document's, item's position), of at least ``least`` windows of the item, that may be one occurrence.

    All together; runs in which the item goes on (an occurrence with words put in or left out); diagonals (one without, wherever it is).
    """
    diagonals = defaultdict(list)
    for d, p in pairs:
        diagonals[d - p].append((d, p))
    groups = [pairs]
    if len(diagonals) > 1:
        runs, last = [[]], -1
        for d, here in groupby(pairs, key=lambda x: x[0]):
            here = list(here)
            after = [p for _, p in here if p > last]
            if not after:
                runs.append([])
            last = min(after or [p for _, p in here])
            runs[-1] += here
        groups += [*(runs if len(runs) > 1 else []), *diagonals.values()]
    for group in groups:
        if len({p for _, p in group}) >= least:
            yield group


def _judge(pairs: list[tuple[int, int]], e: Entry, t: Texts) -> tuple[int, bool]:
    """How many windows of the item agree on slots, and whether any slot differs."""
    slots = [[(e.kinds[p + i], e.values[p + i], t.value(d + i)) for i in range(e.size) if e.kinds[p + i]] for d, p in pairs]
    votes = Counter(s for w in slots for s in set(w))
    there, back = {}, {}
    for (kind, a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):  # one to one, most supported first
        if (kind, a) not in there and (kind, b) not in back:
            there[kind, a], back[kind, b] = b, a
    good = {p for (_, p), w in zip(pairs, slots, strict=True) if all(there.get((k, a)) == b for k, a, b in w)}
    return len(good), any(k[1] != b for k, b in there.items())


# -- the two joins --------------------------------------------------------------------------------


def _size(items: DataFrame) -> int:
    return items.agg(F.sum(F.length("text"))).first()[0] or 0


def _found(index: Index, texts: list[str], threshold: float) -> list[tuple]:
    """``search_all`` over slices of bounded length."""
    return [(at + k, *rest) for at, part in slices(texts) for k, *rest in index.search_all(part, threshold)]


_FOUND = ((1, "share", pa.float64()), (2, "windows", pa.int32()), (3, "changed", pa.bool_()))


def _broadcast_join(rows: DataFrame, items: DataFrame, window: int, literals: int, threshold: float) -> DataFrame:
    got = items.toArrow().combine_chunks()  # at most ``block`` characters
    ids = got.column("item").combine_chunks()
    index = Index(list(enumerate(got.column("text").to_pylist())), window, literals, threshold)
    shared = rows.sparkSession.sparkContext.broadcast((index, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared.value
        for b in batches:
            found = _found(index, b.column("text").to_pylist(), threshold)
            cols = [b.column("id").take(pa.array([f[0] for f in found], pa.int64())), ids.take(pa.array([f[1] for f in found], pa.int64()))]
            cols += [pa.array([f[1 + i] for f in found], t) for i, _, t in _FOUND]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "item", *[n for _, n, _ in _FOUND]])

    shape = f"id {rows.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, share double, windows int, changed boolean"
    return rows.mapInArrow(run, shape)


def _key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _shuffle_join(rows: DataFrame, items: DataFrame, window: int, literals: int, threshold: float) -> DataFrame:
    """(key of a text of ``rows``, key of an item's text, share, windows, changed): equal texts once."""
    spark = rows.sparkSession
    each = materialize(items.select(_key(items["text"]).alias("item"), "text").dropDuplicates(["item"]))

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column("text").to_pylist()):
                made = [(at + e.number, e, p) for e in entries(part, window, literals, threshold) for p in range(e.n)]
                cols = [b.column("item").take(pa.array([k for k, _, _ in made], pa.int64())), pa.array([e.size for _, e, _ in made], pa.int32()), pa.array([e.exact for _, e, _ in made], pa.bool_()), pa.array([p for _, _, p in made], pa.int32())]
                cols += [pa.array([e.n for _, e, _ in made], pa.int32()), pa.array(np.array([e.hashes[p] for _, e, p in made], np.uint64).view(np.int64)), pa.array([e.literals[p] for _, e, p in made], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "size", "exact", "p", "n", "hash", "literals"])

    made = materialize(each.mapInArrow(list_windows, "item struct<x:long,y:long>, size int, exact boolean, p int, n int, hash long, literals int"))
    shared = made.groupBy("size", "exact", "hash").agg(F.countDistinct("item").alias("shared"))
    ranked = Window.partitionBy("item", "size", "exact").orderBy("shared", F.desc("literals"), "p")  # bounded by an item's length
    finders = made.join(shared, ["size", "exact", "hash"]).withColumn("rank", F.row_number().over(ranked))
    finders = materialize(finders.where(F.col("rank") <= F.least("n", F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)).select("item", "size", "exact", "hash").distinct())
    ways = [tuple(r) for r in finders.select("size", "exact").distinct().collect()]  # at most two a size
    some = spark.sparkContext.broadcast(bits_of(finders.select("hash"), "hash", FILTER_BITS))
    texts = rows.where("text <> ''").select(_key(rows["text"]).alias("key"), "text")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column("text").to_pylist()):
                t = Texts(part)
                for size, exact in ways:
                    h, inside = t.windows(size, exact)
                    top = h >> np.uint64(64 - FILTER_BITS)
                    hit = np.flatnonzero((some.value[top >> np.uint64(6)] >> (top & np.uint64(63)).astype(np.int64)) & 1 & inside)
                    pairs = np.unique(np.stack([np.searchsorted(t.end, hit, side="right").astype(np.uint64), h[hit]]), axis=1)
                    keys, n = b.column("key").take(pa.array(pairs[0].astype(np.int64) + at)), pairs.shape[1]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, size), pa.int32()), pa.array(np.full(n, exact), pa.bool_()), pa.array(pairs[1].view(np.int64))], names=["key", "size", "exact", "hash"])

    met = texts.mapInArrow(probe, "key struct<x:long,y:long>, size int, exact boolean, hash long")
    pairs = materialize(met.join(finders, ["size", "exact", "hash"]).select("key", "item").distinct())
    wanted = texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(wanted, "key").join(each.withColumnRenamed("text", "item_text"), "item")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, (text, item) in enumerate(zip(b.column("text"), b.column("item_text"), strict=True)):
                rows += [(k, *f[1:]) for f in Index([(0, item.as_py())], window, literals, threshold).search(text.as_py(), threshold)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("item").take(at), *[pa.array([r[i] for r in rows], t) for i, _, t in _FOUND]], names=["key", "item", *[n for _, n, _ in _FOUND]])

    return both.select("key", "item", "text", "item_text").mapInArrow(judge, "key struct<x:long,y:long>, item struct<x:long,y:long>, share double, windows int, changed boolean")


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 5, literals: int = 3, threshold: float = 0.8, block: int = 4_000_000,
) -> DataFrame:
    """One row per document and item that it leaks: id, item id, share, windows, changed (some slot differs)."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    items = benchmark.select(benchmark[item_col].alias("item"), text_of(benchmark, item_text_col).alias("text")).where("text <> ''")
    if _size(items) <= block:
        out = _broadcast_join(rows, items, window, literals, threshold)
    else:
        found = materialize(_shuffle_join(rows, items, window, literals, threshold).withColumnRenamed("item", "item_key"))
        of = items.select(_key(items["text"]).alias("item_key"), "item")
        out = rows.select("id", _key(rows["text"]).alias("key")).join(found, "key").join(of, "item_key")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "share", "windows", "changed")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 5, literals: int = 3, threshold: float = 0.8, block: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item: one filter, without a join, where the benchmark fits a block."""
    items = benchmark.select(benchmark[item_col].alias("item"), text_of(benchmark, item_text_col).alias("text")).where("text <> ''")
    if _size(items) > block:
        found = _shuffle_join(docs.select(text_of(docs, text_col).alias("text")), items, window, literals, threshold)
        bad = materialize(found.select(F.col("key").alias("_dc_key")).distinct())
        return docs.withColumn("_dc_key", _key(text_of(docs, text_col))).join(bad, "_dc_key", "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(Index([(0, r["text"]) for r in items.collect()], window, literals, threshold))  # at most ``block`` characters

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.ones(b.num_rows, bool)
            good[[f[0] for f in _found(shared.value, [x or "" for x in b.column(text_col).to_pylist()], threshold)]] = False
            yield b.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
