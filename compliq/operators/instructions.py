"""Instruction lines as relations: duplicates, contradictions, disclosures and placeholder markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a directive, a disclosure and a marker look like.
POSITIVE = r"^(?:always|you must|must)\s+(.+)$"
NEGATIVE = r"^(?:never|do not|don't|dont|you must not|must not)\s+(.+)$"
DISCLOSE = r"(?i)\b(send|upload|post|reveal|print|echo|expose|share)\b.*\b(password|credentials?|secret|api[ _-]?key|token|private key)\b"
NEGATED = r"(?i)\b(never|do not|don't|must not|avoid)\b"
MARKER = r"\b(TODO|FIXME|NotImplementedError)\b|@(?:pytest\.)?mark\.skip|@unittest\.skip"


def normal(line: Column) -> Column:
    """A line without bullets, quotes, numbering, emphasis and final stop, in lower case."""
    bare = F.lower(F.trim(F.regexp_replace(line, r"^[\s>*\-+\d.)]+", "")))
    return F.regexp_replace(F.regexp_replace(bare, r"[\s`*_]+", " "), r"[.!]+$", "")


def instruction_lines(files: DataFrame) -> DataFrame:
    """(path, text) to (path, line, raw, norm): without code fences' contents, comments and blank lines."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]", -1)).alias("i", "raw"))
    fence = F.startswith(F.ltrim("raw"), F.lit("```"))
    upto = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"fence": fence, "open": F.sum(fence.cast("int")).over(upto) % 2})
    lines = lines.where("not fence and open = 0").withColumn("norm", normal(F.col("raw")))
    return lines.where((F.col("norm") != "") & ~F.startswith(F.ltrim("raw"), F.lit("#"))).select("path", (F.col("i") + 1).alias("line"), "raw", "norm")


def duplicates(lines: DataFrame, order: list[str], scope: list[str] = ()) -> DataFrame:
    """Lines whose normal form came earlier, with the first place. ``order``: reading order; ``scope``: columns inside which lines are compared.

    The first place of each form is an aggregate (combined before the shuffle); a form that is very common is then only a skewed key of a join.
    """
    first = lines.groupBy(*scope, "norm").agg(F.min(F.struct(*order)).alias("first"))
    joined = lines.join(first, [*scope, "norm"])
    return joined.where(F.struct(*order) > F.col("first"))


def contradictions(lines: DataFrame, order: list[str], scope: list[str] = ()) -> DataFrame:
    """Directives whose action was earlier commanded the other way, with the first such place and the action.

    A line can match both ways ("must not x" commands "not x" and forbids "x"), as two directives.
    """
    ways = F.array(*[F.struct(F.lit(s).alias("sign"), F.nullif(F.regexp_extract("norm", p, 1), F.lit("")).alias("action")) for s, p in ((1, POSITIVE), (-1, NEGATIVE))])
    each = lines.withColumn("way", F.explode(F.filter(ways, lambda w: w["action"].isNotNull()))).select(*scope, *[c for c in lines.columns if c not in scope], F.col("way.sign").alias("sign"), F.col("way.action").alias("action"))
    first = each.groupBy(*scope, "action", (-F.col("sign")).alias("sign")).agg(F.min(F.struct(*order)).alias("first"))
    joined = each.join(first, [*scope, "action", "sign"])
    return joined.where(F.struct(*order) > F.col("first"))


def disclosures(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("norm").rlike(DISCLOSE) & ~F.col("norm").rlike(NEGATED))


def markers(files: DataFrame) -> DataFrame:
    """(path, text) to one row per file: number of lines with a marker, and the first 20 of them."""
    split = F.split("text", r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]", -1)
    hits = F.filter(F.transform(split, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda s: s["text"].rlike(MARKER))
    shown = F.transform(F.slice(hits, 1, 20), lambda s: F.concat(F.lit("line "), s["line"].cast("string"), F.lit(": "), F.left(F.trim(s["text"]), F.lit(120))))
    return files.select("path", F.size(hits).cast("bigint").alias("n"), shown.alias("evidence"))
