"""Sharding by a k-d tree over document metadata, in DataFrame functions only. Law: ``bytes`` (sizes near equal).

A node is split along its widest dimension (relative to the whole table's range) at the weighted median, until leaves hold
``target_bytes``; or, where the number of shards is given, a node that holds k of them is cut at the share of its left half of them.
Medians are found by distributed histograms: bytes by bin of the dimension, then, inside the bin with the median, bytes by bin of a uniform tie
key. Only one row per node reaches the driver, and there are fewer nodes than shards. The tree goes back into plans as arrays of constants,
so that placing a row is arithmetic: no join, no lookup table, no Python.

Dimensions are properties of the text alone, so equal texts share their place in the tree and, by the tie key,
stay together, whatever their other columns say. Only groups that hold more than ``group_share`` of all bytes are spread row by row, since near-equal sizes
leave no other way; there are at most 1 / group_share of those, which bounds the broadcast.

Defined results: null text has no bytes (size 1, crc32 0); repeated rows are placed one by one; a text that is larger than a shard's share makes its shard as much
larger, since texts are never cut; of equal places in a cut the tie key decides, so ties are dealt in proportion; slots follow the order of a hash of the id, then id and
checksum; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compliq.llm.common import bins_for, materialize, running_before, table, text_of, uniform

BINS = 4096


def _coordinates(docs: DataFrame, text_col: str) -> dict[str, Column]:
    text = text_of(docs, text_col)
    size = (F.octet_length(text) + 1).cast("long")
    count = lambda c: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    return {
        "_kd_size": size, "_kd_crc": F.crc32(text.cast("binary")), "_kd_tag": F.xxhash64(text), "_kd_d0": F.log(size.cast("double")),
        "_kd_d1": (F.octet_length(text) / F.greatest(F.char_length(text), F.lit(1))).cast("double"), "_kd_d2": F.log1p(count("\n")),
        "_kd_d3": count(" ") / size,
    }


DIMS = tuple(f"_kd_d{i}" for i in range(4))


class Cuts:
    """A level's cuts as constants by node: dimension, range, bin and tie bin of the cut, children; nodes without a cut have none."""

    def __init__(self, nodes: int):
        self.dim, self.lo, self.width = [0] * nodes, [0.0] * nodes, [1.0] * nodes
        self.at, self.tie_at, self.left, self.right = [0] * nodes, [0] * nodes, [-1] * nodes, [-1] * nodes

    @staticmethod
    def of(constants: list, node: Column) -> Column:
        return F.get(F.lit(constants), node)

    def bin(self, node: Column) -> Column:
        x = F.get(F.array(*[F.col(d) for d in DIMS]), self.of(self.dim, node))
        return F.least(F.floor((x - self.of(self.lo, node)) / self.of(self.width, node) * BINS), F.lit(BINS - 1)).cast("int")

    def down(self, node: Column) -> Column:
        """The child in which a row of this node goes on."""
        bin_, at = self.bin(node), self.of(self.at, node)
        goes_left = (bin_ < at) | ((bin_ == at) & (F.floor(F.col("_kd_tie") * BINS) < self.of(self.tie_at, node)))
        return F.when(self.of(self.left, node) < 0, node).when(goes_left, self.of(self.left, node)).otherwise(self.of(self.right, node))


class Plan:
    """A k-d tree's cuts, level by level, the groups that are spread row by row, and the shard of each leaf."""

    def __init__(self, large: DataFrame, id_col: str):
        self.large, self.id_col, self.levels, self.leaves = large, id_col, [], [0]

    def tied(self, rows: DataFrame) -> DataFrame:
        """Adds _kd_tie and _kd_node (the root) to rows with coordinates."""
        rows = rows.join(F.broadcast(self.large), ["_kd_tag", "_kd_crc"], "left")  # at most 1 / group_share groups
        own = uniform(F.col(self.id_col).cast("string"), F.col("_kd_crc"))
        tie = F.when(F.col("_kd_large"), own).otherwise(uniform(F.col("_kd_tag"), F.col("_kd_crc")))
        return rows.withColumn("_kd_tie", tie).drop("_kd_large").withColumn("_kd_node", F.lit(0))

    def shards(self, rows: DataFrame) -> DataFrame:
        """Adds _kd_shard to rows with coordinates."""
        rows = self.tied(rows)
        for level in self.levels:
            rows = rows.withColumn("_kd_node", level.down(F.col("_kd_node")))
        return rows.withColumn("_kd_shard", F.get(F.lit(self.leaves), F.col("_kd_node")))


def _cut(hist: DataFrame, want: dict[int, float]) -> dict[int, tuple[int, float, int]]:
    """By node: the first bin at which the running bytes (``b`` by ``node`` and ``bin``) reach what is wanted, the bytes still wanted inside it, and its bytes."""
    if not want:
        return {}
    wanted = [want.get(k, float("inf")) for k in range(max(want) + 1)]
    upto = Window.partitionBy("node").orderBy("bin")  # at most BINS rows a node
    cum = hist.withColumns({"cum": F.sum("b").over(upto), "want": Cuts.of(wanted, F.col("node"))})
    at = cum.where(F.col("cum") >= F.col("want")).groupBy("node").agg(F.min_by(F.struct("bin", "b", "cum"), "bin").alias("m"))
    return {r["node"]: (r["m"]["bin"], want[r["node"]] - (r["m"]["cum"] - r["m"]["b"]), r["m"]["b"]) for r in at.collect()}


def kd_plan(rows: DataFrame, shards: int | None, id_col: str, group_share: float, target_bytes: int | None = None) -> Plan:
    """``rows``: materialized, narrow, with coordinates. Either ``shards`` or ``target_bytes``, what a leaf should hold, is given."""
    ranges = [f(d).alias(f"{k}{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]
    facts = rows.agg(F.sum("_kd_size").alias("bytes"), *ranges).first()
    total = facts["bytes"] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    span = {d: (facts[f"hi{d}"] or 0) - (facts[f"lo{d}"] or 0) for d in DIMS}
    groups = rows.groupBy("_kd_tag", "_kd_crc").agg(F.sum("_kd_size").alias("b")).where(F.col("b") > group_share * total)
    plan = Plan(materialize(groups.select("_kd_tag", "_kd_crc", F.lit(True).alias("_kd_large"))), id_col)
    if not total:
        return plan
    rows = materialize(plan.tied(rows).select("_kd_size", "_kd_tie", "_kd_node", *DIMS))
    holds, fresh = {0: (0, shards)}, 1  # by node: its first shard and how many it holds
    while split := {k: v for k, v in holds.items() if v[1] > 1}:
        cuts, want = Cuts(fresh), {}
        for r in rows.groupBy("_kd_node").agg(F.sum("_kd_size").alias("bytes"), *ranges).collect():  # fewer rows than shards
            if (k := r["_kd_node"]) in split:
                wide = max(DIMS, key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"]) / span[d] if span[d] else 0.0)
                cuts.dim[k], cuts.lo[k], cuts.width[k] = DIMS.index(wide), float(r[f"lo{wide}"]), float(r[f"hi{wide}"] - r[f"lo{wide}"]) or 1.0
                many = split[k][1]
                want[k] = r["bytes"] * (many // 2) / many
        node = F.col("_kd_node")
        placed = rows.where(node.isin(*want)).select(node.alias("node"), F.col("_kd_size").alias("size"), F.floor(F.col("_kd_tie") * BINS).cast("int").alias("tie"), cuts.bin(node).alias("bin"))
        coarse = _cut(placed.groupBy("node", "bin").agg(F.sum("size").alias("b")), want)
        at = [coarse[k][0] if k in coarse else -1 for k in range(fresh)]
        tied = placed.where(F.col("bin") == Cuts.of(at, F.col("node"))).groupBy("node", F.col("tie").alias("bin")).agg(F.sum("size").alias("b"))
        fine = _cut(tied, {k: rest for k, (_, rest, _) in coarse.items()})
        holds = {k: v for k, v in holds.items() if k not in split}
        for k, (first, many) in split.items():
            holds |= {fresh: (first, many // 2), fresh + 1: (first + many // 2, many - many // 2)}
            if k in coarse:
                tie, rest, b = fine[k]
                cuts.at[k], cuts.tie_at[k] = coarse[k][0], tie + (2 * rest > b)  # the tie bin at the edge goes where it fits better
                cuts.left[k], cuts.right[k] = fresh, fresh + 1
            fresh += 2
        plan.levels.append(cuts)
        if any(many > 1 for _, many in holds.values()):  # written, since filters on the node would go down through all levels' arithmetic, and repeat it
            rows = materialize(rows.withColumn("_kd_node", cuts.down(node)))
    plan.leaves = [holds.get(k, (0, 0))[0] for k in range(fresh)]
    return plan


def kd_shards(docs: DataFrame, shards: int | None = 8, *, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", group_share: float = 0.002) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless from 0 within the shard)."""
    rows = materialize(docs.select(docs[id_col].alias("_kd_id"), *[c.alias(k) for k, c in _coordinates(docs, text_col).items()]))
    plan = kd_plan(rows, shards, "_kd_id", group_share, target_bytes)
    out = plan.shards(rows).select(F.col("_kd_id").alias("id"), F.col("_kd_size").alias("size"), F.col("_kd_crc").alias("crc"), F.col("_kd_shard").alias("shard"))
    out = out.withColumn("bin", F.pmod(F.xxhash64("id", "crc"), F.lit(bins_for(rows.count()))))
    out = running_before(materialize(out), ["shard"], "bin", [F.col("id"), F.col("crc"), F.col("size")], F.lit(1).cast("long"), "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def sharded(docs: DataFrame, shards: int | None = 8, *, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", group_share: float = 0.002) -> DataFrame:
    """The rows of ``docs``, all columns, and ``shard`` (in place of a column of that name); the texts are not shuffled."""
    coordinates = _coordinates(docs, text_col)
    rows = materialize(docs.select(docs[id_col].alias("_kd_id"), *[c.alias(k) for k, c in coordinates.items()]))
    plan = kd_plan(rows, shards, "_kd_id", group_share, target_bytes)
    placed = plan.shards(docs.withColumns({"_kd_id": docs[id_col], **coordinates}))
    return placed.select(*[c for c in docs.columns if c != "shard"], F.col("_kd_shard").alias("shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 7 of near-equal bytes."""
    out = kd_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}
