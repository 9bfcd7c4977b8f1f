"""Exact dedup: static binary-fuse filters per immutable snapshot, exact buckets and byte checks.

A snapshot is immutable, so its digests are known when its filter is built: the filter is a static three-wise binary-fuse
filter (Graf and Lemire, 2022), one per shard of digests, with 8-bit fingerprints: about 9 bits a digest. Incoming digests
are first grouped among themselves (copies within a new batch never meet the snapshot one by one), then screened. They stay where
they are, and the filters come to them by broadcast, up to ``FILTER_BYTES``; beyond that both meet by shard and salt, the filters once
for each salt, so that no task holds more than about ``SHARD_KEYS`` incoming digests whatever the sizes of the two. A negative is certainly new. A
positive joins the snapshot's exact buckets, and every group with more than one
member, or with a positive, has its texts compared byte by byte: it is grouped once more by the text itself, and texts that only share their
digest are kept apart.

Snapshots of like size are merged as arrivals go on, so that a batch is screened against as many as the logarithm of the arrivals.

Defined results: null text counts as empty; rows that repeat both id and text are one document, so all of them carry the
same verdict; of equal texts the largest id stays, a tie being one document; ids may be null (a null id never wins over another); texts are compared whole, however
long; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compliq.llm.common import bounded, materialize, table, text_of

#: Digests of a filter, and of the incoming side of a task; bytes of filters that are broadcast, at most.
SHARD_KEYS, FILTER_BYTES = 200_000, 32 << 20
_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The finalizer of a 64-bit hash, over an array."""
    x = x ^ _U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class FuseFilter:
    """A static filter over 64-bit keys: no false negatives, about 1 false positive in 256."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        g = _mix(h, seed + 1)
        base = ((h >> _U(32)) * _U(count) >> _U(32)) * _U(segment)
        mask = _U(segment - 1)
        slots = [(base + _U(i * segment) + ((g >> _U(18 * i)) & mask)).astype(np.int64) for i in range(3)]
        return (*slots, (h & _U(0xFF)).astype(np.uint8))

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        if n == 0:
            return cls(0, 1, 1, np.zeros(0, np.uint8))
        segment = 1 << min(17, max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        count = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1, 1000):
            if (prints := cls._peel(keys, seed, segment, count)) is not None:
                return cls(seed, segment, count, prints)
            if seed % 20 == 0:
                count += max(1, count // 10)
        raise RuntimeError("no seed peels the keys")

    @classmethod
    def _peel(cls, keys: np.ndarray, seed: int, segment: int, count: int) -> np.ndarray | None:
        """Peel all slots with one key at once, round after round; assign the rounds backwards."""
        a, b, c, mark = cls._places(keys, seed, segment, count)
        size = (count + 2) * segment
        every = np.concatenate([a, b, c])
        load = np.bincount(every, minlength=size)
        total = np.bincount(every, weights=np.tile(np.arange(len(keys)), 3), minlength=size).astype(np.int64)
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(load == 1)
            if not len(single):
                return None
            peeled, first = np.unique(total[single], return_index=True)
            rounds.append((peeled, single[first]))
            left -= len(peeled)
            for slots in (a[peeled], b[peeled], c[peeled]):
                np.subtract.at(load, slots, 1)
                np.subtract.at(total, slots, peeled)
        prints = np.zeros(size, np.uint8)
        for peeled, slot in reversed(rounds):
            prints[slot] = 0
            prints[slot] = mark[peeled] ^ prints[a[peeled]] ^ prints[b[peeled]] ^ prints[c[peeled]]
        return prints

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        a, b, c, mark = self._places(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == mark


def _u(longs: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(longs, np.int64).view(np.uint64)


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(_u(pdf["key"].to_numpy()))
    return pd.DataFrame({"shard": [key[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.count], "prints": [f.prints.tobytes()]})


def _filter(row) -> FuseFilter:
    return FuseFilter(row.seed, row.segment, row.segments, np.frombuffer(row.prints, np.uint8))


def _screen(_: tuple, incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(incoming), bool)
    for f in filters.itertuples():
        hit |= _filter(f).contains(_u(incoming["key"].to_numpy()))
    return incoming.loc[hit, ["digest", "tag"]]


def _shard(shards: int) -> Column:
    """By other bits of the key than the filter takes."""
    return F.pmod(F.shiftrightunsigned("key", 17), F.lit(shards)).cast("int")


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, tag, key, n); the key is what filters know of a digest."""
    return rows.groupBy("digest", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("digest"))


class Snapshot:
    """Immutable digests: exact buckets and their filters, written once. ``tier``: as many arrivals as 2 to its power."""

    def __init__(self, buckets: DataFrame, tier: int = 0):
        self.buckets, self.tier = materialize(buckets), tier
        self.size = self.buckets.count()
        self.shards = max(1, -(-self.size // SHARD_KEYS))
        keys = self.buckets.select("key", _shard(self.shards).alias("shard"))
        self.filters = materialize(keys.groupBy("shard").applyInPandas(_build, "shard int, seed long, segment long, segments long, prints binary"))

    def merged(self, other: Snapshot) -> Snapshot:
        both = self.buckets.union(other.buckets.select(*self.buckets.columns))
        return Snapshot(both.groupBy("digest", "tag", "key").agg(F.sum("n").alias("n")).select(*self.buckets.columns), max(self.tier, other.tier) + 1)

    def screen(self, groups: DataFrame, size: int, filter_bytes: int) -> DataFrame:
        """The groups (digest, tag), ``size`` of them, that the filters do not rule out."""
        total = self.filters.agg(F.sum(F.length("prints"))).first()[0] or 0
        if total > filter_bytes:
            salts = max(1, -(-size // (self.shards * SHARD_KEYS)))
            incoming = groups.select("digest", "tag", "key", _shard(self.shards).alias("shard"), F.pmod("key", F.lit(salts)).cast("int").alias("salt"))
            filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            return incoming.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(_screen, "digest binary, tag long")
        shards, shared = self.shards, groups.sparkSession.sparkContext.broadcast({r["shard"]: r for r in self.filters.collect()})  # at most ``filter_bytes``

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: _filter(r) for k, r in shared.value.items()}
            for b in batches:
                keys = _u(b.column("key").to_numpy())
                shard, hit = (keys >> _U(17)) % _U(shards), np.zeros(len(keys), bool)
                for k, f in filters.items():
                    here = shard == k
                    hit[here] = f.contains(keys[here])
                yield b.select(["digest", "tag"]).filter(pa.array(hit))

        return groups.select("digest", "tag", "key").mapInArrow(run, "digest binary, tag long")

    def matches(self, groups: DataFrame, size: int, filter_bytes: int) -> DataFrame:
        """Positives that the exact buckets confirm by the whole digest."""
        return self.screen(groups, size, filter_bytes).join(self.buckets.select("digest", "tag"), ["digest", "tag"])


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(batches: list[DataFrame], *, id_col: str = "doc_id", text_col: str = "text", digest=sha256, tag=F.xxhash64, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of all batches: ``id_col``, keep_id (largest id of equal texts), group_size, kept, digest (binary).

    The batches arrive in their order. Each becomes an immutable snapshot, and later ones are screened against those before. Digest
    and tag (a long) only propose: texts decide.
    """
    texts = [d.select(d[id_col].alias("id"), text_of(d, text_col).alias("text")) for d in batches]
    texts = [t.select("id", "text", digest(F.col("text")).alias("digest"), tag(F.col("text")).alias("tag")) for t in texts]
    rows = [materialize(t.select("id", "digest", "tag")) for t in texts]
    snapshots: list[Snapshot] = []
    suspects: list[DataFrame] = []
    for r in rows:
        arrived = Snapshot(_groups(r))
        suspects.append(arrived.buckets.where("n > 1").select("digest", "tag"))
        suspects += [s.matches(arrived.buckets, arrived.size, filter_bytes) for s in snapshots]
        snapshots.append(arrived)
        while len(snapshots) > 1 and snapshots[-1].tier == snapshots[-2].tier:
            last = snapshots.pop()
            snapshots.append(snapshots.pop().merged(last))
    candidates = bounded(materialize(reduce(DataFrame.union, suspects).distinct()))
    members = reduce(DataFrame.union, texts).join(candidates, ["digest", "tag"])
    alike = members.groupBy("digest", "tag", "text").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    # two texts under one digest and tag are two rows here
    known = alike.groupBy("digest", "tag").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.max("keep").alias("keep"))
    known = materialize(known)
    out = reduce(DataFrame.union, rows).join(known, ["digest", "tag"], "left").where("texts is null or texts = 1").select("id", "digest", "n", "keep")
    clash = known.where("texts > 1").select("digest", "tag")
    if not clash.isEmpty():
        apart = members.join(bounded(clash), ["digest", "tag"]).join(alike, ["digest", "tag", "text"])
        out = out.union(apart.select("id", "digest", "n", "keep"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "digest",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in two arrivals, split by a hash of the id: the first is the snapshot, the second the new batch."""
    docs = table(spark, sf_dir, "documents")
    later = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)) == 1
    out = exact_dedup([docs.where(~later), docs.where(later)])
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
