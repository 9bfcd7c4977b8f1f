"""Removal of repeated byte strings by bucket-pointer refinement over a sampled suffix array.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else. The sorted order of all suffixes is not
needed for that, only which of their length-byte prefixes share a bucket, and bucket-pointer refinement (Schuermann and Stoye,
2007) finds it: suffixes start in buckets by their q-gram; the bucket identifiers at later offsets refine a bucket; refined
identifiers are used again for the next, longer step. Three things make it fit a cluster:

- Identifiers are named by content: the identifier of 2q bytes at p is a 64-bit mix of those of q bytes at p and at p + q. Every task
  gives equal strings equal identifiers, so a refinement step needs no renaming pass over all suffixes.
- Suffixes are sampled: every window of ``length`` bytes is sorted under the q-gram in it whose identifier is smallest (leftmost
  among equals). The choice depends on the window's bytes alone, so equal windows meet in the bucket of equal q-grams. Windows in a
  row share their suffix, so there is about one row for 40 bytes of text.
- Buckets with one row are final and leave at once. The others are refined by the identifiers that cover the whole stretch
  under a suffix's windows: stretches that occur twice are wholly repeated. What is still single in a bucket with several kinds of
  stretches is refined in blocks of 16 windows, by the identifier of the bytes that all of them share (single: none is repeated) and
  of the bytes that any of them covers (double: all are repeated). Only blocks between the two go down to single windows.
  Each kind counts once at every step, however many copies it has.

Texts are shuffled once, into a table bucketed by their row's hash. Later steps bring what they ask of a text to its bucket, so texts that are
not asked for are neither moved nor seen by Python.

Two strings are taken for equal if 64-bit identifiers agree in the same bucket, itself a 64-bit identifier.

Defined results: null text counts as empty; texts shorter than ``length`` lose nothing; rows that repeat id and text each lose what the other repeats; null and
repeated ids are told apart by their texts; of equal least q-grams in a window the leftmost counts, everywhere alike;
an empty table gives an empty result; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compliq.llm.common import materialize, scratch, store_by, table, text_of

Q, BLOCK = 32, 16
#: Bytes handled at once; positions in a piece take 24 bits.
PIECE = 1 << 19
#: Rows of a batch handled at once.
ROWS = 256
_LOW = np.uint64(0xFFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _step(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The identifiers of two strings in a row, from theirs."""
    h = (left * _A + right) * _B
    h ^= h >> np.uint64(31)
    return h


def identifiers(data: bytes, *lengths: int) -> list[np.ndarray]:
    """For each length (8 times a power of two, ascending): the identifier of that many bytes at every position."""
    n = len(data)
    h = np.zeros(max(n - 7, 0), np.uint64)
    for k in range(8):
        if n - k >= 8:
            words = np.frombuffer(data, "<u8", (n - k) // 8, k)
            h[k : k + 8 * len(words) : 8] = words
    h = (h ^ (h >> np.uint64(32))) * _A
    h ^= h >> np.uint64(29)
    out, q = [], 8
    for want in lengths:
        while q < want:
            h = _step(h[:-q], h[q:]) if len(h) > q else h[:0]
            q *= 2
        out.append(h)
    return out


def unit(length: int) -> int:
    """Bytes of the identifiers from which those of windows, blocks and stretches are made: the most that a block's shared bytes hold."""
    if not Q + BLOCK <= length < PIECE:
        raise ValueError(f"length must be {Q + BLOCK} to {PIECE - 1}")
    return 8 << ((length - BLOCK + 1) // 8).bit_length() - 1


def cover(long: np.ndarray, begin: np.ndarray, n: np.ndarray | int, most: int, size: int) -> np.ndarray:
    """Identifiers of n bytes (``size`` to ``most``) from begin, from those of ``size`` bytes."""
    h, tail = long[begin], begin + n - size
    for k in range(1, -(-most // size)):
        h = _step(h, long[np.minimum(begin + k * size, tail)])
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    pad = np.full(-len(x) % w, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(backward[:m], forward[w - 1 : w - 1 + m])


def suffixes(texts: list[bytes], length: int = 200) -> tuple[np.ndarray, ...]:
    """Of each sampled suffix: text's index, first and last start of its windows, its own start, bucket, identifier of the stretch of its windows."""
    pieces, found = [], []
    size = 0

    def flush() -> None:
        nonlocal pieces, size
        if pieces:
            found.append(_suffixes(pieces, length))
        pieces, size = [], 0

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            pieces.append((i, at, t if len(t) < PIECE else t[at : at + PIECE + length - 1]))
            size += len(pieces[-1][2])
            if size >= PIECE:
                flush()
    flush()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(6))


def _suffixes(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = b"".join(p[2] for p in pieces)
    lens = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(lens)
    begins = ends - lens
    size = unit(length)
    short, long = identifiers(data, Q, size)
    least = _sliding_min((short & ~_LOW) | np.arange(len(short), dtype=np.uint64), length - Q + 1)
    edge = np.zeros(len(data) + 2, np.int32)
    np.add.at(edge, begins, 1)
    np.add.at(edge, ends - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(least)])
    at = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, at = starts[first], starts[last], at[first]
    stretch = cover(long, lo, hi - lo + length, 2 * length - Q, size)
    stretch = _step(_step(stretch, (at - lo).astype(np.uint64)), (hi - lo).astype(np.uint64))
    piece = np.searchsorted(ends, lo, side="right")
    shift = np.array([p[1] for p in pieces])[piece] - begins[piece]
    return np.array([p[0] for p in pieces])[piece], lo + shift, hi + shift, at + shift, short[at].view(np.int64), stretch.view(np.int64)


def blocks(text: bytes, asked: list[dict], length: int = 200) -> list[np.ndarray]:
    """Of the blocks of windows of the suffixes asked for, each once: suffix, block, copies, identifier of the shared bytes, of all bytes, and whether all windows are inside the text."""
    size = unit(length)
    (long,) = identifiers(text, size)
    most: dict[tuple[int, int], tuple[int, int]] = {}
    for q in asked:
        for j in range((q["at"] - q["hi"]) // BLOCK, (q["at"] - q["lo"]) // BLOCK + 1):
            most[q["at"], j] = max(most.get((q["at"], j), (0, 0)), (q["m"], q["bucket"]))
    at, j = np.array(list(most), np.int64).reshape(-1, 2).T
    m, bucket = np.array(list(most.values()), np.int64).reshape(-1, 2).T
    last = at - BLOCK * j
    first = last - BLOCK + 1
    tag = (bucket.view(np.uint64) ^ (j.astype(np.uint64) * _B)) * _A
    shared = _step(cover(long, last, length - BLOCK + 1, length - BLOCK + 1, size), tag)
    whole = (first >= 0) & (last + length <= len(text))
    every = _step(cover(long, np.where(whole, first, 0), np.where(whole, length + BLOCK - 1, size), length + BLOCK - 1, size), tag)
    return [at, j, m, shared.view(np.int64), every.view(np.int64), whole]


def windows(text: bytes, at: int, j: int, length: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Starts and identifiers of the windows of a block that are inside the text; in an identifier goes the distance to the suffix, since near periodic text a window lies under two suffixes of a bucket."""
    last = at - BLOCK * j
    begin = np.arange(max(last - BLOCK + 1, 0), min(last, len(text) - length) + 1)
    size = unit(length)
    (long,) = identifiers(text[begin[0] : begin[-1] + length], size)
    return begin, _step(cover(long, begin - begin[0], length, length, size), (at - begin).astype(np.uint64)).view(np.int64)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that Python objects are made for few rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


_SPANS = "array<struct<begin:int,end:int>>"


def _spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(id, text, spans) of the rows with something to remove, and (id, text) of the others."""
    unit(length)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(docs, text_col)
    each = docs.groupBy(docs[id_col].alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes"))
    repeats, size = each.agg(F.count_if((F.col("n") > 1) | F.col("id").isNull()), F.sum("bytes")).first()
    # ids tell rows apart; where they do not, a hash of the text helps
    key = F.xxhash64(text) if repeats else F.lit(0).cast("long")
    rows = docs.select(docs[id_col].alias("id"), key.alias("key"), text.cast("binary").alias("text"))
    texts = store_by(rows.withColumns({"h": F.xxhash64("id", "key"), "h2": F.xxhash64(F.lit(1), "id", "key")}), "h", size or 0)
    shape = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            i, lo, hi, at, bucket, stretch = suffixes([x.as_py() for x in b.column("text")], length)
            i = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(stretch), b.column("id").take(i), b.column("key").take(i), *[pa.array(x, pa.int32()) for x in (lo, hi, at)]], names=["bucket", "stretch", "id", "key", "lo", "hi", "at"])

    def at_texts(asked: DataFrame, how: str = "inner") -> DataFrame:
        """The texts of the rows of ``asked`` (one row a text), which comes to where they are: one key to join by, as the texts are stored by it, and a second hash."""
        asked = asked.withColumns({"_h": F.xxhash64("id", "key"), "_h2": F.xxhash64(F.lit(1), "id", "key")}).drop("id", "key")
        return texts.join(asked.hint("shuffle_hash"), (texts["h"] == asked["_h"]) & (texts["h2"].bitwiseXOR(asked["_h2"]) == 0), how)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for k in range(b.num_rows):
                at, j, m, shared, every, whole = blocks(b.column("text")[k].as_py(), b.column("asked")[k].as_py(), length)
                mine = pa.array(np.full(len(at), k))
                cols = [b.column("id").take(mine), b.column("key").take(mine), pa.array(at, pa.int32()), pa.array(j, pa.int32()), pa.array(m), pa.array(shared), pa.array(every, mask=~whole)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "at", "j", "m", "shared", "every"])

    def in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for k in range(b.num_rows):
                data = b.column("text")[k].as_py()
                for q in b.column("asked")[k].as_py():
                    begin, w = windows(data, q["at"], q["j"], length)
                    mine, same = pa.array(np.full(len(w), k)), lambda x, w=w: pa.array(np.full(len(w), x))
                    yield pa.RecordBatch.from_arrays([same(q["shared"]), pa.array(w), same(q["m"]), b.column("id").take(mine), b.column("key").take(mine), pa.array(begin, pa.int32())], names=["shared", "window", "m", "id", "key", "begin"])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            cut = [[{"begin": x, "end": y} for x, y in merge([(x["begin"], x["end"]) for x in s.as_py()])] for s in b.column("spans")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(cut, shape)], names=["id", "text", "spans"])

    def repeated(df: DataFrame, *by: str) -> DataFrame:
        return materialize(df.groupBy(*by).agg(F.sum("m").alias("t")).where("t > 1").select(*by))

    with scratch(spark):
        every = materialize(texts.select("id", "key", "text").mapInArrow(sample, f"bucket long, stretch long, id {kind}, key long, lo int, hi int, at int"))
        # buckets with one row are final
        shared = repeated(every.select("bucket", F.lit(1).alias("m")), "bucket")
        kept = materialize(every.join(shared, "bucket"), keep=True)
    # refined by the identifiers over the whole stretch; any row stands for its like
    kinds = materialize(kept.groupBy("bucket", "stretch").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("id", "key", "lo", "hi", "at")]))
    mixed = materialize(kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("bucket"))
    whole = kept.join(materialize(kinds.where("m > 1").select("bucket", "stretch")), ["bucket", "stretch"]).select("id", "key", F.col("lo").alias("begin"), (F.col("hi") + length).alias("end"))
    # what is single in a mixed bucket is refined in blocks of windows
    asked = kinds.join(mixed, "bucket").groupBy("id", "key").agg(F.collect_list(F.struct("bucket", "m", "lo", "hi", "at")).alias("asked"))  # bounded by the text
    made = materialize(at_texts(asked).select("id", "key", "text", "asked").mapInArrow(in_blocks, f"id {kind}, key long, at int, j int, m long, shared long, every long"))
    live = materialize(made.join(repeated(made, "shared"), "shared"))
    double = repeated(live.where("every is not null"), "every").withColumn("all", F.lit(True))
    live = materialize(live.join(double, "every", "left"))
    last = F.col("at") - BLOCK * F.col("j")
    in_full = live.where("m = 1 and all").select("id", "key", (last - (BLOCK - 1)).alias("begin"), (last + length).alias("end"))
    # and what is still open, window by window, with one of each kind that it shares bytes with
    unsettled = materialize(live.where("m = 1 and all is null").select("shared").distinct())
    near = materialize(live.join(unsettled, "shared"))
    one_each = near.where("every is not null").groupBy("shared", "every").agg(F.sum("m").alias("m"), *[F.first(c).alias(c) for c in ("id", "key", "at", "j")]).drop("every")
    others = near.where("every is null").select(*one_each.columns)
    asked = one_each.union(others).groupBy("id", "key").agg(F.collect_list(F.struct("shared", "m", "at", "j")).alias("asked"))
    lone = materialize(at_texts(asked).select("id", "key", "text", "asked").mapInArrow(in_windows, f"shared long, window long, m long, id {kind}, key long, begin int"))
    part = lone.where("m = 1").join(repeated(lone, "shared", "window"), ["shared", "window"]).select("id", "key", "begin", (F.col("begin") + length).alias("end"))
    spans = whole.union(in_full).union(part).groupBy("id", "key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # bounded by the text
    spans = materialize(spans)
    some = at_texts(spans).select("id", "text", "spans").mapInArrow(give, f"id {kind}, text binary, spans {_SPANS}")
    return some, at_texts(spans.select("id", "key"), "left_anti").select("id", "text")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per input row: id, text (binary), spans array<struct<begin, end>>: the maximal runs of bytes to remove."""
    some, others = _spans(docs, id_col, text_col, length)
    return some.union(others.select("id", "text", F.array().cast(_SPANS).alias("spans"))).withColumnRenamed("id", id_col)


def cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without the spans."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, repeated strings of 200 bytes."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = [(len(t), s, hashlib.sha256(cut(t, s)).hexdigest()) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            removed = [sum(x["end"] - x["begin"] for x in s) for _, s, _ in out]
            cols = [[n for n, _, _ in out], removed, [len(s) for _, s, _ in out]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols], pa.array([h for _, _, h in out], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    some, others = _spans(table(spark, sf_dir, "documents"), "doc_id", "text", 200)
    none = F.lit(0).cast("long")
    whole = others.select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return some.withColumnRenamed("id", "doc_id").mapInArrow(digest, whole.schema).union(whole)


SQL: dict[str, str] = {}
