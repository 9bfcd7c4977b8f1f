"""URL filters: host rules, then a path-template tree judged by smoothed labelled purity, in DataFrame functions only.

Rules come first: one fits its host and all subdomains where the path starts with the rule's; the longest wins. The pages
that rules decide are the labelled examples from which the tree learns about the others.

The tree has one branch per host. Segments that are variable by form (numbers, hexadecimal or mixed identifiers, dates) become
typed wildcards at once; pages are then grouped by host and template. Level by level, a node with many, mostly distinct children gets a wildcard
for them. Otherwise its children are merged with each other where their labels do not tell them apart: in the order of their purity, neighbours that differ by no
more than ``z`` standard errors become one branch; children without labels are one branch. A template's purity is smoothed towards its
parent's, the host's towards the whole table's; templates above ``threshold`` are rejected.

All of it is aggregates and joins of aggregates, by host and node and segment, so a host with a third of all pages is no single task. Only the order of
purities is a window over a node, and over distinct pairs of label counts, not over children: n labelled pages make at most about n^(2/3) such pairs.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged as any other
template; urls are read whole, however long, and segments beyond ``depth`` count as one; of rules of equal length the one that stands first; repeated rows are judged
alike; children of equal purity are merged; with no labelled page the prior decides (allow); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compliq.llm.common import LOWER, UPPER, materialize, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null. Null where no rule fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        out = F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.lit(value(r))).otherwise(out)
    return out


def typed(segment: Column) -> Column:
    """A placeholder for a segment that is variable by its form, keeping a file's extension; else the segment."""
    stem, ext = F.regexp_extract(segment, r"^(.*?)((?:\.[A-Za-z]{1,5})?)$", 1), F.regexp_extract(segment, r"^(.*?)((?:\.[A-Za-z]{1,5})?)$", 2)
    kind = (
        F.when(stem.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), "<date>").when(stem.rlike(r"^\d+$"), "<number>")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "<hex>").when(stem.rlike(r"^(?=.*\d)[\w-]{12,}$"), "<id>")
    )
    return F.when(kind.isNotNull(), F.concat(kind, ext)).otherwise(segment)


def url_verdicts(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "page_id", url_col: str = "url", depth: int = 6,
    distinct: int = 20, ratio: float = 0.5, z: float = 1.96, strength: float = 5.0, threshold: float = 0.5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity (share of block that is expected of the template).

    ``depth``: levels of the tree; deeper segments are judged with the last one. ``distinct`` and ``ratio``: children and their
    share of the pages from which they become a wildcard. ``strength``: how many labelled pages the parent's purity weighs.
    """
    host, path = host_and_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matched(rules, F.col("host"), F.col("path"), lambda r: r.name)).withColumn("ruled", matched(rules, F.col("host"), F.col("path"), lambda r: r.verdict))
    shape = F.transform(F.split(F.regexp_replace("path", r"^/+|/+$", ""), "/+"), typed)
    rows = materialize(rows.withColumn("shape", F.array_join(shape, "/")))
    counts = {"n": F.sum("n"), "labelled": F.sum("labelled"), "bad": F.sum("bad")}
    tree = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("bad"))
    tree = materialize(tree.withColumns({"segments": F.split("shape", "/"), "node": F.lit("")}))
    labels, bad = tree.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = (bad + 1) / (labels + 2) if labels else 0.0

    def nodes(t: DataFrame) -> DataFrame:
        """(host, node) with its counts."""
        return t.groupBy("host", "node").agg(*[c.alias(f"node_{k}") for k, c in counts.items()])

    def smoothed(bad: Column, labelled: Column, towards: Column) -> Column:
        return (bad + strength * towards) / (labelled + strength)

    purity = nodes(tree).select("host", "node", smoothed(F.col("node_bad"), F.col("node_labelled"), F.lit(prior)).alias("p"))
    tree = materialize(tree.join(purity, ["host", "node"]))
    for level in range(depth):
        here = F.when(F.lit(level) == depth - 1, F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments"), F.lit(1))), "/")).otherwise(F.try_element_at("segments", F.lit(level + 1)))
        tree = tree.withColumn("segment", F.coalesce(here, F.lit("")))
        open_ = tree.where("segment <> ''")
        if open_.isEmpty():
            break
        children = open_.groupBy("host", "node", "segment").agg(*[c.alias(k) for k, c in counts.items()])
        tokens = materialize(branches(children, distinct, ratio, z))
        grown = open_.join(tokens, ["host", "node", "segment"]).withColumn("node", F.concat("node", F.lit("/"), "token")).drop("token")
        grown = materialize(grown)
        of_node = nodes(grown)
        grown = grown.join(of_node, ["host", "node"]).withColumn("p", smoothed(F.col("node_bad"), F.col("node_labelled"), F.col("p")))
        tree = materialize(grown.select(*tree.columns).union(tree.where("segment = ''")).drop("segment"))
    judged = rows.join(tree.select("host", "shape", F.col("node").alias("template"), F.col("p").alias("purity")), ["host", "shape"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") > threshold, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def branches(children: DataFrame, distinct: int, ratio: float, z: float) -> DataFrame:
    """(host, node, segment) with the token of its branch, from (host, node, segment, n, labelled, bad): ``<any>``, ``<new>`` (no labels), ``<k>`` (several
    alike, numbered by purity) or the segment itself."""
    children = materialize(children)
    node = ["host", "node"]
    facts = children.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("pages"))
    wild = facts.where((F.col("kinds") >= distinct) & (F.col("kinds") >= ratio * F.col("pages"))).select(*node, F.lit(True).alias("wild"))
    # children with equal counts are alike, so what is put in order are distinct counts
    profiles = children.where("labelled > 0").groupBy(*node, "labelled", "bad").agg(F.count(F.lit(1)).alias("m"))
    profiles = profiles.withColumns({"n_": F.col("m") * F.col("labelled"), "k_": F.col("m") * F.col("bad")})
    order = Window.partitionBy(*node).orderBy(F.col("bad") / F.col("labelled"), "labelled")
    n0, k0 = F.lag("n_").over(order), F.lag("k_").over(order)
    pooled = (F.col("k_") + k0) / (F.col("n_") + n0)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.01)) * (1 / F.col("n_") + 1 / n0))
    differs = n0.isNotNull() & (F.abs(F.col("k_") / F.col("n_") - k0 / n0) > z * error)
    profiles = profiles.withColumn("differs", differs.cast("int"))
    profiles = materialize(profiles.withColumn("branch", F.sum("differs").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(*node, "labelled", "bad", "m", "branch"))
    several = profiles.groupBy(*node, "branch").agg(F.sum("m").alias("members"))
    named = profiles.join(several, [*node, "branch"]).select(*node, "labelled", "bad", F.when(F.col("members") > 1, F.concat(F.lit("<"), F.col("branch").cast("string"), F.lit(">"))).alias("branch"))
    out = children.join(wild, node, "left").join(named, [*node, "labelled", "bad"], "left")
    token = F.when(F.col("wild"), "<any>").when(F.col("labelled") == 0, "<new>").otherwise(F.coalesce("branch", "segment"))
    return out.select(*node, "segment", token.alias("token"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of ``pages``."""
    return url_verdicts(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
