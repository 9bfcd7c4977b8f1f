"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: the words (ASCII letters lower-cased) in shingles, each shingle hashed by XXH64, a bit set where it is set
in over half of the hashes. Texts with equal fingerprints are one point from then on.

Covering (Pagh, 2016): bit i gets a nonzero vector m(i) of radius + 1 bits; for every nonzero v, the mask of v keeps the bits
with <m(i), v> odd. Two fingerprints that differ in at most ``radius`` bits agree under at least one mask, since
``radius`` equations leave a nonzero v that is even on all differing bits. So no pair within the radius is missed.

Within a bucket (mask, masked bits) of up to ``dense`` points a search that compares reached points with the others finds the
links, and only a spanning forest of them is emitted. Points of larger buckets agree on the masked bits, so they are covered again
over the bits that are left: the guarantee holds for those bits alike, and each turn halves them, so that buckets of distinct points
cannot stay large; it goes on until none is. No partner is left out, and no task holds more than ``dense`` points of a bucket.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle; repeated rows are in one component; null ids are never a component's name unless all its ids
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compliq.llm.common import LOWER, UPPER, bounded, materialize, table, text_of
from compliq.llm.components import components

_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def grams(text: bytes, shingle: int) -> list[bytes]:
    """``bytes.split`` cuts at exactly the ASCII white space of the contract."""
    words = text.translate(_ASCII_LOWER).split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    found = grams(text, shingle)
    if not found:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in found), np.uint64, len(found))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def masks(radius: int, turn: int = 0, bits: int = 64) -> list[int]:
    """The masks of all nonzero v. The bits take the nonzero vectors in turn, so every mask keeps about half of them; later turns deal them anew."""
    n = 2 ** (radius + 1) - 1
    order = np.random.default_rng(turn).permutation(bits) if turn else np.arange(bits)
    vectors = [int(order[i]) % n + 1 for i in range(bits)]
    if n > bits:  # spread over the whole space, else low vectors alone would be used
        vectors = [int(v) for v in np.random.default_rng(turn + 100).permutation(n)[:bits] + 1]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(x.as_py(), shingle)) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def forest(points: list[int], radius: int, block: int = 256) -> list[tuple[int, int]]:
    """Links of a spanning forest of the points within the radius of each other: each component's points to its first."""
    left = np.array(points, np.int64).view(np.uint64)
    links = []
    while len(left):
        first, new, left = left[0], left[:1], left[1:]
        while len(new) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(new), block):
                near |= (np.bitwise_count(new[i : i + block, None] ^ left[None, :]) <= radius).any(axis=0)
            new, left = left[near], left[~near]
            links += [(signed(int(first)), signed(int(x))) for x in new]
    return links


def links(points: DataFrame, radius: int, dense: int = 4096) -> DataFrame:
    """(a, b): enough links between the distinct longs ``fp`` to connect all pairs within the radius."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fps in b.column("fps"):
                found = forest(sorted(fps.as_py()), radius)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    todo, found, turn = points.select("fp", F.lit(-1).cast("long").alias("open"), F.lit(0).cast("long").alias("path")), None, 0
    while True:
        cover = F.array(*[F.lit(signed(m)) for m in masks(radius, turn)])
        rows = todo.select("fp", "open", "path", F.explode(cover).alias("mask"))
        kept = F.col("mask").bitwiseAND(F.col("open"))
        rows = rows.select("fp", F.col("open").bitwiseAND(F.bitwise_not("mask")).alias("open"), F.xxhash64("path", "mask", F.col("fp").bitwiseAND(kept)).alias("bucket"))
        sizes = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        shared = materialize(rows.join(bounded(sizes), "bucket"))
        small = shared.where(F.col("m") <= dense).groupBy("bucket").agg(F.collect_list("fp").alias("fps"))  # at most ``dense`` a row
        here = small.select("fps").mapInArrow(pair, "a long, b long")
        found = here if found is None else found.union(here)
        large = shared.where(F.col("m") > dense)
        if large.isEmpty():
            return found
        if turn == 64:  # with no more open bits than 2^bits <= dense distinct points have, no bucket is large
            raise RuntimeError("buckets of distinct points stay large")
        todo, turn = large.select("fp", "open", F.col("bucket").alias("path")), turn + 1


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, dense: int = 4096) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (the smallest id reachable)."""
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    return rows.join(_labels(rows, radius, dense), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _labels(rows: DataFrame, radius: int, dense: int) -> DataFrame:
    """(fp, component_id) of the materialized (id, fp)."""
    points = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")))
    parts = components(links(points.select("fp"), radius, dense))
    named = points.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialize(named)
    names = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")))
    return materialize(named.join(names, "component").select("fp", "component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: three-word shingles, linked at 2 or fewer differing bits."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
