"""Mixing sources to target weights: Efraimidis-Spirakis sampling under token budgets, in DataFrame functions only.

Each source gets a target: its weight's share of the mix, capped at a multiple of its own size, the excess reshared by
weight (water-filling: sources whose share reaches their cap are closed and the level is raised for the others, until none more
closes; each turn is one aggregate over the sources, of which there may be many). Whole
epochs of a source come first; what is left of the target is filled in the order of exponential keys -ln(u) / w, where w is
the document's quality weight, until the prefix sum of sizes reaches it. The document at the edge gives the words that
still fit, so a source's total meets its target to within a word.

Prefix sums run in two levels (bins of the key, then within a bin), so a source with a third of all rows is no single task.

Defined results: null text has size 0 and nothing is taken of it; a null source is a source of its own, the last; keys
depend on id, text and seed alone, so reruns agree; of equal keys the smaller id comes first; repeated rows are taken one by one; texts are counted whole, however long; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compliq.llm.common import WORD, bins_for, bounded, materialize, running_before, table, text_of, uniform

WEIGHTS = (3.0, 1.0, 2.0)


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1.5: half plus the share of the characters that are letters (or their marks) of any script, or white space."""
    plain = F.length(text) - F.length(F.regexp_replace(text, r"[\p{L}\p{M}\s]+", ""))
    return F.lit(0.5) + F.when(F.length(text) > 0, plain / F.length(text)).otherwise(F.lit(0.0))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 by code point, null last: within ranges of sources, after the sizes of the ranges before."""
    ranges = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    before = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("m")).select("range", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranges.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + here - 1).drop("range", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = _ranked(sources).withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    s = materialize(s.withColumn("cap", F.lit(float(cap)) * F.col("source_size")).select("source", "source_size", "w", "cap"))
    total = float(share) * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        spent, open_, n = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.count_if(full)).first()
        if n == closed or not open_:
            return s.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("w")).alias("target"))
        level, closed = (total - spent) / open_, n


def _key(id_col: Column, text: Column, seed: int) -> Column:
    return -F.log(uniform(F.lit(seed), id_col.cast("string"), F.xxhash64(text))) / quality_weight(text)


def _part(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5, cap: float = 2.0, seed: int = 17, whole: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted), copies (rows to emit).

    ``whole``: the document at the edge counts whole or not at all, whichever is nearer; else it gives what fits.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _key(docs[id_col], text, seed).alias("key"))
    rows = materialize(rows)
    n_bins = bins_for(rows.count())
    part = _part(F.col("source"))
    rows = rows.withColumn("part", part).withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * n_bins).cast("int"))
    sources = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).withColumn("part", part))
    per_source = bounded(sources.select("part", "source_size", "target"))
    rows = running_before(rows, ["part"], "bin", [F.col("key"), F.col("id"), F.col("size")], F.col("size"), "before")
    rows = rows.join(per_source, "part")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    room = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("before")))
    if whole:
        room = F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    taken = epochs * F.col("size") + room
    copies = epochs + F.when(room > 0, 1).otherwise(0)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), copies.cast("int").alias("copies"), epochs.alias("epochs"), "key", "part")


def emit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **params) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as its source's target takes it; documents are whole.

    A source's epochs and the last key that its target reaches are one row per source, so the texts are not shuffled.
    """
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, whole=True, **params)
    edges = mixed.groupBy("part").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("copies") > F.col("epochs"), F.col("key"))).alias("edge"))
    edges = bounded(materialize(edges.select(F.col("part").alias("_mx_part"), F.col("epochs").alias("_mx_epochs"), F.col("edge").alias("_mx_edge"))))
    keyed = docs.withColumns({"_mx_part": _part(docs[source_col]), "_mx_key": _key(docs[id_col], text_of(docs, text_col), seed)})
    copies = F.col("_mx_epochs") + F.when(F.col("_mx_key") <= F.col("_mx_edge"), 1).otherwise(0)
    keyed = keyed.join(edges, "_mx_part").withColumn("_mx_n", copies.cast("int")).where("_mx_n > 0")
    return keyed.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_n")))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all of ``documents``: weights 3, 1, 2 repeating, 150 % of all words, at most twice a source's size."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL: dict[str, str] = {}
