"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import re

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, score double, shard int, fp long, id string, n int"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def documents(spark, rows):
    """rows: (doc_id, text[, lang, source])."""
    full = [(i, t, *(rest or ("en", "a")), len(t or ""), 1, 1.0, 1.0, 1, 1, "x", 1) for i, t, *rest in rows]
    return spark.createDataFrame(full, T._parse_datatype_string(SCHEMA))


def awkward(spark):
    base = [(1, "Alpha beta gamma delta. Epsilon zeta!"), (2, None), (3, ""), (4, "   \n\t "), (5, "word " * 30_000), (6, "Alpha beta gamma delta. Epsilon zeta!"), (6, "Alpha beta gamma delta. Epsilon zeta!"), (None, "Null id here"), (7, "x")]
    return documents(spark, [(i, t, *((None, None) if k % 3 == 0 else ("en", "a"))) for k, (i, t) in enumerate(base)])


def empty(spark):
    return documents(spark, [])
