"""The engine's queries over the given tables, and the SQL that they are held against.

Texts of ``documents`` have no markup. Rules on text take a text as one paragraph; rules on structure take Markdown that is made of all its lines, by
their numbers, and goes through the parser; SQL derives what must come out of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compliq import audit
from compliq.functions import lexicon
from compliq.functions.text import collapsed, heading_key_col, word_count
from compliq.operators import instructions, manifest
from compliq.plans import native
from compliq.plans.spec import Specification, load
from compliq.sources import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return documents.spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def flat_docs(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as parsed documents of one paragraph each."""
    d = read(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.lit(None).cast("string").alias("path"), F.lit("txt").alias("file_type"), text.alias("raw_text"), F.octet_length(text).cast("long").alias("size_bytes"), documents.one_paragraph(text).alias("blocks"), F.lit("{}").alias("meta"), "lang", "source")


def one_rule(checker: str, severity: str = "major", **params) -> Specification:
    return load({"version": 1, "name": checker, "requirements": [{"id": "R1", "description": checker, "checker": checker, "parameters": params, "severity": severity}]})


def run_rule(spark: SparkSession, sf: str, checker: str, **params) -> DataFrame:
    return audit.audit(flat_docs(spark, sf), one_rule(checker, **params)).select("doc_id", "status", "actual", "n")


# -- counting words -------------------------------------------------------------------------------

_W = r"\d+(?:[.,]\d+)+|[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"  # quotes doubled for SQL
_WORDS = f"len(regexp_extract_all(coalesce(text, ''), '{_W}'))"
_PLURAL = lambda n, one, many: f"format('{{:,}}', {n}) || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {many}' END"


@query(f"SELECT doc_id, {_WORDS} AS n_words, len(regexp_extract_all(coalesce(text, ''), '[^\\s\\p{{Z}}]+')) AS n_chunks FROM documents")
def q_word_count(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf, "documents").select("doc_id", word_count(text).cast("long").alias("n_words"), word_count(text, "whitespace").cast("long").alias("n_chunks"))


@query(f"""
    SELECT doc_id, CASE WHEN n BETWEEN 100 AND 400 THEN 'PASS' ELSE 'FAIL' END AS status,
           format('{{:,}}', n) || ' words' || CASE WHEN n < 100 THEN ' (short by ' || format('{{:,}}', 100 - n) || ')' WHEN n > 400 THEN ' (over by ' || format('{{:,}}', n - 400) || ')' ELSE '' END AS actual, n
    FROM (SELECT doc_id, {_WORDS} AS n FROM documents)""")
def q_word_bounds_gap(spark, sf):
    return run_rule(spark, sf, "word_count", min=100, max=400)


# -- literals, punctuation, patterns --------------------------------------------------------------


@query(f"""
    SELECT doc_id, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, {_PLURAL('n', 'occurrence', 'occurrences')} AS actual, n
    FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)licensed\\s+under|the\\s+mit|idiot')) AS n FROM documents)""")
def q_forbidden_text(spark, sf):
    return run_rule(spark, sf, "forbidden_text", values=["idiot", "the MIT", "licensed under"])


@query(f"""
    SELECT doc_id, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, {_PLURAL('n', 'occurrence', 'occurrences')} AS actual, n
    FROM (SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x IN ('the', 'und'))) AS n FROM documents)""")
def q_forbidden_text_whole_word(spark, sf):
    return run_rule(spark, sf, "forbidden_text", values=["the", "und"], whole_word=True)


_REQUIRED = """
    SELECT doc_id, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status,
           CASE WHEN {ok} THEN 'Found: ' || concat_ws(', ', CASE WHEN a > 0 THEN '"the"' END, CASE WHEN b > 0 THEN '"tion"' END, CASE WHEN c > 0 THEN '"que"' END)
                ELSE 'Missing: ' || concat_ws(', ', CASE WHEN a = 0 THEN '"the"' END, CASE WHEN b = 0 THEN '"tion"' END, CASE WHEN c = 0 THEN '"que"' END) END AS actual,
           CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) AS n
    FROM (SELECT doc_id, len(list_filter(m, lambda x: x = 'the')) AS a, len(list_filter(m, lambda x: x = 'tion')) AS b, len(list_filter(m, lambda x: x = 'que')) AS c
          FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(?i)tion|the|que'), lambda x: lower(x)) AS m FROM documents))"""


@query(_REQUIRED.format(ok="a > 0 AND b > 0 AND c > 0"))
def q_required_all(spark, sf):
    return run_rule(spark, sf, "required_text", values=["the", "tion", "que"])


@query(_REQUIRED.format(ok="a > 0 OR b > 0 OR c > 0"))
def q_required_any(spark, sf):
    return run_rule(spark, sf, "required_text", values=["the", "tion", "que"], require="any")


def turns(spark, sf) -> DataFrame:
    """``conversations`` as documents: turns in order are paragraphs."""
    t = read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    fields = [f.split(":") for f in documents.BLOCK[len("struct<") : -1].split(",")]
    values = {"position": F.col("turn") + 1, "para": F.col("turn") + 1, "kind": F.lit("paragraph"), "text": F.col("text"), "candidate": F.lit(False)}
    block = F.struct(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields])
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return grouped.select(F.col("conv_id").alias("doc_id"), F.lit(None).cast("string").alias("path"), F.lit("txt").alias("file_type"), "blocks", F.lit("{}").alias("meta"))


_WITHIN = """
    SELECT conv_id AS doc_id, CASE WHEN n IS NULL THEN 'UNVERIFIED' WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT conv_id, arg_{end}(CASE WHEN regexp_matches(text, '[^\\s]') THEN len(regexp_extract_all(text, '(?i)the')) END, turn) AS n FROM conversations GROUP BY conv_id)"""


@query(_WITHIN.format(end="min"))
def q_required_first_paragraph(spark, sf):
    return audit.audit(turns(spark, sf), one_rule("required_text", value="the", within="first_paragraph")).select("doc_id", "status")


@query(_WITHIN.format(end="max"))
def q_required_last_paragraph(spark, sf):
    return audit.audit(turns(spark, sf), one_rule("required_text", value="the", within="last_paragraph")).select("doc_id", "status")


_MARKS = "len(regexp_extract_all(coalesce(text, ''), '[!&]'))"


@query(f"SELECT doc_id, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, {_PLURAL('n', 'occurrence', 'occurrences')} AS actual, n FROM (SELECT doc_id, {_MARKS} AS n FROM documents)")
def q_forbidden_punctuation(spark, sf):
    return run_rule(spark, sf, "forbidden_punctuation", marks=["exclamation marks", "ampersand"])


@query(f"SELECT doc_id, CASE WHEN n <= 3 THEN 'PASS' ELSE 'FAIL' END AS status, {_PLURAL('n', 'occurrence', 'occurrences')} AS actual, n FROM (SELECT doc_id, {_MARKS} AS n FROM documents)")
def q_punctuation_max_allowed(spark, sf):
    return run_rule(spark, sf, "forbidden_punctuation", marks=["!", "&"], max_allowed=3)


@query(f"""
    SELECT doc_id, CASE WHEN n >= 2 THEN 'PASS' ELSE 'FAIL' END AS status, {_PLURAL('n', 'occurrence', 'occurrences')} || CASE WHEN n < 2 THEN ' (short by ' || (2 - n) || ')' ELSE '' END AS actual, n
    FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)of\\s+the')) AS n FROM documents)""")
def q_occurrences_text(spark, sf):
    return run_rule(spark, sf, "occurrences", text="of the", min=2)


@query(f"""
    SELECT doc_id, CASE WHEN n <= 1 THEN 'PASS' ELSE 'FAIL' END AS status, {_PLURAL('n', 'occurrence', 'occurrences')} || CASE WHEN n > 1 THEN ' (over by ' || format('{{:,}}', n - 1) || ')' ELSE '' END AS actual, n
    FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]{{2,}}')) AS n FROM documents)""")
def q_occurrences_regex(spark, sf):
    return run_rule(spark, sf, "occurrences", pattern="[0-9]{2,}", max=1)


@query(f"""
    SELECT doc_id, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, {_PLURAL('n', 'match', 'matches')} AS actual, n
    FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._]+@[a-z]+')) AS n FROM documents)""")
def q_forbidden_regex(spark, sf):
    return run_rule(spark, sf, "forbidden_regex", pattern="[A-Za-z0-9._]+@[a-z]+")


@query("""
    SELECT doc_id, CASE WHEN a OR b THEN 'PASS' ELSE 'FAIL' END AS status, (a::INT + b::INT) || ' of 2 patterns matched' AS actual
    FROM (SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)license') AS a, regexp_matches(coalesce(text, ''), '[0-9]{3}') AS b FROM documents)""")
def q_required_regex_any(spark, sf):
    return run_rule(spark, sf, "required_regex", patterns=["license", "[0-9]{3}"], flags=["ignorecase"], require="any").select("doc_id", "status", "actual")


@query("""
    SELECT source, word, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS BIGINT) AS place
    FROM (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents) GROUP BY source, word)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, word) <= 12""")
def q_top_counts(spark, sf):
    """Counts by key, the most frequent twelve of each source."""
    from pyspark.sql import Window

    d = read(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = d.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place.cast("long")).where("place <= 12")


@query("""
    SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || trim(regexp_replace(text[a + 1 : p + 40], '[\\t-\\r \\p{Z}\\x{85}]+', ' ', 'g')) || CASE WHEN p + 40 < length(text) THEN '…' ELSE '' END AS excerpt, line
    FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, instr(text, '!') AS p, greatest(instr(text, '!') - 41, 0) AS a, CAST(1 + length(regexp_replace(text[1 : instr(text, '!')], '[^\\n]+', '', 'g')) AS INT) AS line FROM documents WHERE instr(text, '!') > 0)""")
def q_excerpt(spark, sf):
    """The first place that a detailed audit reports for an exclamation mark: its line and excerpt."""
    out = audit.audit_in_detail(flat_docs(spark, sf), one_rule("forbidden_punctuation", marks=["!"])).where("status = 'FAIL'")
    return out.select("doc_id", F.col("locations")[0]["excerpt"].alias("excerpt"), F.col("locations")[0]["line"].alias("line"))


# -- structure ------------------------------------------------------------------------------------

#: What means something inside a line of Markdown, and what stands for it; every line begins with a sign of its own, so that it begins no block.
_MARKS_FROM, _MARKS_TO = "*_`~[]<>|#", "＊＿｀～［］＜＞｜＃"
_BLOCKS = f"""
    WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
    lines AS (SELECT doc_id, n, rtrim('¶ ' || translate(trim(regexp_replace(x, '[\\t-\\r \\p{{Z}}\\x{{85}}]+', ' ', 'g')), '{_MARKS_FROM}', '{_MARKS_TO}')) AS t FROM raw),
    blocks AS (
        SELECT doc_id, n AS position, CASE WHEN n % 12 IN (1, 8) THEN 'heading' WHEN n % 12 IN (3, 4, 10, 11) THEN 'list_item' WHEN n % 12 = 5 THEN 'table' WHEN n % 12 = 6 THEN 'code' WHEN n % 12 = 7 THEN 'quote' ELSE 'paragraph' END AS kind,
            CASE n % 12 WHEN 1 THEN CAST(1 + (n // 12) % 3 AS INT) WHEN 8 THEN 2 END AS level, CASE WHEN n % 12 IN (3, 10) THEN 'bullet' WHEN n % 12 IN (4, 11) THEN 'numbered' END AS marker,
            CASE WHEN n % 24 = 1 THEN 'Scope' WHEN n = 8 AND doc_id % 3 = 0 THEN 'Chapter 2: The Plan.' WHEN n % 12 = 5 THEN '' ELSE t END AS text FROM lines
        UNION ALL SELECT doc_id, max(n) + 1, 'heading', 1, NULL, 'References' FROM lines GROUP BY doc_id
        UNION ALL SELECT doc_id, m + 1 + k, 'list_item', NULL, 'numbered', 'Ref ' || k FROM (SELECT doc_id, max(n) AS m FROM lines GROUP BY doc_id), range(1, 4) AS r(k) WHERE k <= doc_id % 4),
    cells AS (SELECT doc_id, n AS position, r, c, CASE WHEN r = 1 AND c = 1 THEN t WHEN r = 1 THEN 'b' WHEN c = 1 THEN 'c' ELSE 'd' END AS text FROM lines, range(1, 3) AS x(r), range(1, 3) AS y(c) WHERE n % 12 = 5),
    units AS (SELECT doc_id, position, kind, text FROM blocks WHERE kind <> 'table' UNION ALL SELECT doc_id, position, 'table_cell', text FROM cells),
    spans AS (SELECT doc_id, position, level, text, CAST(coalesce((SELECT min(b.position) FROM blocks b WHERE b.doc_id = h.doc_id AND b.kind = 'heading' AND b.position > h.position AND b.level <= h.level), 1000000000) AS INT) AS until FROM blocks h WHERE kind = 'heading')"""
_ID = "CAST(doc_id AS VARCHAR) AS doc_id"


def markup(spark, sf) -> DataFrame:
    """All lines of all documents, each as a block of Markdown: headings (both kinds), list items (both kinds), tables, code, quotes and paragraphs, with front
    matter before and a list of references after them."""
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def block(x, i):
        n = i + 1
        t = F.rtrim(F.concat(F.lit("¶ "), F.translate(collapsed(x), _MARKS_FROM, _MARKS_TO)))
        k, say = n % 12, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        out = F.when(n % 24 == 1, say(F.repeat(F.lit("#"), (1 + F.floor(n / 12) % 3).cast("int")), " Scope ##")).when((n == 8) & (F.col("doc_id") % 3 == 0), "Chapter 2: The Plan.\n---")
        out = out.when(k == 1, say(F.repeat(F.lit("#"), (1 + F.floor(n / 12) % 3).cast("int")), " ", t)).when(k == 8, say(t, "\n-----")).when(k == 3, say("- ", t)).when(k == 10, say("  * ", t)).when(k == 4, say("1. ", t))
        out = out.when(k == 11, say("12) ", t)).when(k == 5, say("| ", t, " | b |\n| --- | :-: |\n| c | d |")).when(k == 6, say("```py\n", t, "\n```")).when(k == 7, say("> ", t))
        return out.otherwise(t)

    refs = F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: k <= F.col("doc_id") % 4), lambda k: F.concat(k.cast("string"), F.lit(". Ref "), k.cast("string")))
    parts = F.concat(F.transform(F.split("text", "\n", -1), block), F.array(F.lit("# References")), refs)
    return d.select("doc_id", F.concat(F.lit("---\ntitle: x\n---\n\n"), F.array_join(parts, "\n\n")).alias("text"))


def marked(spark, sf) -> DataFrame:
    return documents.from_text(markup(spark, sf), "md")


def blocks_of(spark, sf, *fields: str) -> DataFrame:
    return marked(spark, sf).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", *[f"b.{f}" for f in fields])


@query(_BLOCKS + f" SELECT {_ID}, CAST(position AS INT) AS position, kind, level, marker, text FROM blocks")
def q_markdown_blocks(spark, sf):
    """Lines written as Markdown and parsed."""
    return blocks_of(spark, sf, "position", "kind", "level", "marker", "text").where("kind <> 'table_cell'")


@query(_BLOCKS + f" SELECT {_ID}, CAST(position AS INT) AS position, CAST(r AS INT) AS row, CAST(c AS INT) AS col, text FROM cells")
def q_table_cells(spark, sf):
    return blocks_of(spark, sf, "position", "kind", "row", "col", "text").where("kind = 'table_cell'").drop("kind")


@query(_BLOCKS + f" SELECT {_ID}, CAST(position AS INT) AS position, kind, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position) AS section FROM blocks")
def q_section_asof(spark, sf):
    """The section of each block: the last heading before it."""
    return blocks_of(spark, sf, "position", "kind", "section").where("kind <> 'table_cell'")


@query(_BLOCKS + f" SELECT {_ID}, CAST(position AS INT) AS position, level, until FROM spans")
def q_section_span(spark, sf):
    """Where the section of each heading ends."""
    return blocks_of(spark, sf, "position", "kind", "level", "until").where("kind = 'heading'").drop("kind")


_TEMPLATE = "**@t** and [@t](http://u) ![@t](i.png) `@t` ~~@t~~ <http://a.b> <!-- gone -->*@t* _@t_ a_b_c"


@query(_BLOCKS + f" SELECT {_ID}, CAST(n AS INT) AS position, t || ' and ' || t || ' ' || t || ' ' || t || ' ' || t || ' http://a.b ' || t || ' ' || t || ' a_b_c' AS text FROM lines")
def q_inline_markup(spark, sf):
    """What stays of emphasis, links, images, code and comments around every line."""
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    clean = lambda x: F.rtrim(F.concat(F.lit("¶ "), F.translate(collapsed(x), _MARKS_FROM, _MARKS_TO)))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.replace(F.lit(_TEMPLATE), F.lit("@t"), clean(x)))
    docs = documents.from_text(d.select("doc_id", F.array_join(lines, "\n\n").alias("text")), "md")
    return docs.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.position", "b.text")


@query("""
    SELECT 'd/' || doc_id || '.txt' AS doc_id, CASE doc_id % 4 WHEN 2 THEN 'utf-16' WHEN 3 THEN 'cp1252' ELSE 'utf-8' END AS encoding,
        replace(replace(CASE WHEN doc_id % 4 = 3 THEN regexp_replace(coalesce(text, ''), '[^\\x09\\x0a\\x20-\\x7e\\x{a0}-\\x{ff}]', '', 'g') || ' é!' ELSE coalesce(text, '') END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) || 'end' AS text FROM documents""")
def q_text_decode(spark, sf):
    """Texts from bytes in four encodings, line ends made equal."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    latin = F.concat(F.regexp_replace(t, "[^\\x09\\x0a\\x20-\\x7e\\xa0-\\xff]", ""), F.lit(" é!"))
    ended = lambda x: F.concat(x, F.lit("\r\nend"))
    content = F.when(k == 0, F.encode(ended(t), "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(ended(t), "UTF-8"))).when(k == 2, F.encode(ended(t), "UTF-16")).otherwise(F.encode(ended(latin), "ISO-8859-1"))
    files = read(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))
    return documents.from_bytes(files).select("doc_id", F.get_json_object("meta", "$.encoding").alias("encoding"), F.col("raw_text").alias("text"))


_COUNT = f"CAST(coalesce(sum(len(regexp_extract_all(text, '{_W}'))), 0) AS BIGINT)"


@query(_BLOCKS + f""", kept AS (SELECT * FROM units u WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = u.doc_id AND s.text IN ('Scope', 'References') AND s.position <= u.position AND u.position < s.until))
    SELECT {_ID}, n, CASE WHEN n >= 50 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT d.doc_id, {_COUNT} AS n FROM documents d LEFT JOIN (SELECT doc_id, text FROM kept) k USING (doc_id) GROUP BY d.doc_id)""".replace("sum(len(regexp_extract_all(text,", "sum(len(regexp_extract_all(k.text,"))
def q_exclude_sections(spark, sf):
    """Words outside two sections, one of which comes up again and again and nests."""
    return audit.audit(marked(spark, sf), one_rule("word_count", min=50, exclude_sections=["scope", "References"])).select("doc_id", "n", "status")


@query(_BLOCKS + f" SELECT {_ID}, n, CASE WHEN n <= 150 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT doc_id, {_COUNT} AS n FROM (SELECT doc_id, CASE WHEN kind IN ('paragraph', 'list_item', 'quote') THEN text ELSE '' END AS text FROM units) GROUP BY doc_id)")
def q_scope_flags(spark, sf):
    """Words without headings, tables and code."""
    return audit.audit(marked(spark, sf), one_rule("word_count", max=150, include_headings=False, include_tables=False, exclude_code_blocks=True)).select("doc_id", "n", "status")


_ELEMENTS = {
    "bullets": "count(*) FILTER (marker = 'bullet')", "numbered_items": "count(*) FILTER (marker = 'numbered')", "list_items": "count(*) FILTER (marker IS NOT NULL)", "headings": "count(*) FILTER (kind = 'heading')",
    "tables": "count(*) FILTER (kind = 'table')", "code_blocks": "count(*) FILTER (kind = 'code')", "paragraphs": "count(*) FILTER (kind IN ('paragraph', 'quote'))", "references": "CAST(any_value(doc_id) % 4 AS BIGINT)",
}


def _element_query(element: str, sql: str) -> None:
    @query(_BLOCKS + f" SELECT {_ID}, n, CASE WHEN n >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT doc_id, {sql} AS n FROM blocks GROUP BY doc_id)")
    def run(spark, sf):
        """The checker on parsed Markdown."""
        return audit.audit(marked(spark, sf), one_rule("element_count", element=element, min=2)).select("doc_id", "n", "status")

    QUERIES[f"q_element_{element}"], ORACLE_SQL[f"q_element_{element}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _element, _sql in _ELEMENTS.items():
    _element_query(_element, _sql)


@query(_BLOCKS + f" SELECT {_ID}, {', '.join(f'{sql} AS {name}' for name, sql in _ELEMENTS.items())}, count(*) FILTER (kind = 'heading' AND level = 2) AS headings_2 FROM blocks GROUP BY doc_id")
def q_element_counts(spark, sf):
    """All elements at once, and the headings of one level."""
    b = F.col("blocks")
    return marked(spark, sf).select("doc_id", *[native.element_counts(b, e).alias(e) for e in _ELEMENTS], native.element_counts(b, "headings", 2).alias("headings_2"))


_KEY = """regexp_replace(regexp_replace(replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^#+\\s*|\\s*#+$', '', 'g'), '[*_`]', '', 'g'), '[\\t-\\r \\p{{Z}}\\x{{85}}]+', ' ', 'g'),
        '(?i)^(?:(?:chapter|section|part)\\s+(?:\\d+|[ivxlc]+)\\s*[:.\\-–—]?\\s*|\\d+(?:\\.\\d+)*[.)]?\\s+|[ivxlc]+[.)]\\s+)', ''))), 'ß', 'ss'), '[:.]+$', ''), '^ +| +$', '', 'g')"""


@query(_BLOCKS + f" SELECT {_ID}, CAST(position AS INT) AS position, {_KEY.format(x='text')} AS key FROM blocks WHERE kind = 'heading'")
def q_heading_keys(spark, sf):
    """The comparable form of every heading, as parsing makes it."""
    return blocks_of(spark, sf, "position", "kind", "key").where("kind = 'heading'").drop("kind")


@query(f"SELECT doc_id, line, {_KEY.format(x='raw')} AS key FROM (SELECT doc_id, n - 1 AS line, '## ' || (doc_id % 4) || '.1 ' || x || ':' AS raw FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents))")
def q_heading_key_lines(spark, sf):
    """The key of every line of every document as a numbered heading."""
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), heading_key_col(F.concat(F.lit("## "), (F.col("doc_id") % 4).cast("string"), F.lit(".1 "), "text", F.lit(":"))).alias("key"))


_HEADS = _BLOCKS + f", heads AS (SELECT doc_id, position, {_KEY.format(x='text')} AS key FROM blocks WHERE kind = 'heading')"


@query(_HEADS + f" SELECT {_ID}, CASE WHEN bool_or(key = 'the plan') AND bool_or(key IN ('references', 'bibliography')) THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bool_or(key = 'the plan') AS BIGINT) + CAST(bool_or(key = 'references') AS BIGINT) AS n FROM heads GROUP BY doc_id")
def q_required_section(spark, sf):
    return audit.audit(marked(spark, sf), one_rule("required_section", headings=["The plan", ["Bibliography", "References"]])).select("doc_id", "status", "n")


@query(_HEADS + f" SELECT {_ID}, CASE WHEN bool_or(contains(key, 'ung')) OR bool_or(contains(key, 'ción')) THEN 'PASS' ELSE 'FAIL' END AS status FROM heads GROUP BY doc_id")
def q_required_section_contains(spark, sf):
    return audit.audit(marked(spark, sf), one_rule("required_section", headings=["ung", "ción"], exact=False, require="any")).select("doc_id", "status")


@query(_HEADS + f""" SELECT {_ID}, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <= b THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT doc_id, min(position) FILTER (contains(key, 'th')) AS a, min(position) FILTER (contains(key, 'es')) AS b FROM heads GROUP BY doc_id)""")
def q_section_order(spark, sf):
    return audit.audit(marked(spark, sf), one_rule("required_section", headings=["Th", "Es"], exact=False, ordered=True)).select("doc_id", "status")


# -- preservation, spelling, files ----------------------------------------------------------------


def passages(spark, sf) -> list[str]:
    """The benchmark's passages as protected items: a specification, of bounded size as files of them are (``spec.BASELINE_BYTES``)."""
    from compliq.plans.spec import BASELINE_BYTES

    b = read(spark, sf, "benchmark").where("text is not null and trim(text) <> ''")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BASELINE_BYTES:
        raise ValueError(f"the passages have {size} bytes; a specification holds {BASELINE_BYTES}")
    return [r["text"] for r in b.orderBy("item_id").collect()]


_FLAT = "trim(regexp_replace({x}, '[\\t-\\r \\p{{Z}}\\x{{85}}]+', ' ', 'g'))"
_PASSAGES = "(SELECT text FROM benchmark WHERE text IS NOT NULL AND trim(text) <> '')"


@query(f"""
    SELECT doc_id, CAST(m - k AS BIGINT) AS n, CASE WHEN m = k THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN m = k THEN 'Found exactly as given' ELSE 'changed or missing: ' || (m - k) END AS actual
    FROM (SELECT d.doc_id, count(*) AS m, count(*) FILTER (contains({_FLAT.format(x="coalesce(d.text, '')")}, {_FLAT.format(x="b.text")})) AS k FROM documents d, {_PASSAGES} b GROUP BY d.doc_id)""")
def q_preserve_text(spark, sf):
    """How many of the protected passages each document does not hold unchanged (white space apart)."""
    return run_rule(spark, sf, "preserve_text", texts=passages(spark, sf)).select("doc_id", "n", "status", "actual")


@query(f"""
    SELECT doc_id, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n FROM (SELECT doc_id, 2 - CAST(contains(t, 'e o') AS BIGINT) - CAST(contains(t, 'es "er"') AS BIGINT) AS n
    FROM (SELECT doc_id, replace(lower({_FLAT.format(x="coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' ES ' || chr(10) || '“er”' ELSE '' END")}), '“er”', '"er"') AS t FROM documents))""")
def q_preserve_folded(spark, sf):
    """Two passages, whatever their case, white space and form of quotes."""
    tail = F.when(F.col("doc_id") % 2 == 0, " ES \n“er”").otherwise("")
    docs = flat_docs(spark, sf).withColumn("blocks", documents.one_paragraph(F.concat("raw_text", tail)))
    return audit.audit(docs, one_rule("preserve_text", texts=["E o", "Es \"ER\""], case_sensitive=False, normalize_quotes=True)).select("doc_id", "status", "n")


_INJECT = "text || CASE doc_id % 4 WHEN 0 THEN ' The colour of the center was \"favorite\" here.' WHEN 1 THEN ' We organised and traveled to the theatres.' WHEN 2 THEN ' An analyzed catalog, skillful' ELSE '' END"


def _spelling_sql(variant: str) -> str:
    words = ", ".join(f"'{w}'" for w in lexicon.other_words(variant))
    return f"""
    SELECT doc_id, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n FROM (SELECT doc_id,
      len(list_filter(regexp_extract_all(lower(regexp_replace(replace(t, chr(10), ' '), '"[^"]+"|“[^”]+”', '"', 'g')), '[a-z]+'), lambda w: w IN ({words}))) AS n
      FROM (SELECT doc_id, {_INJECT} AS t FROM documents))"""


def _injected(spark, sf) -> DataFrame:
    d = flat_docs(spark, sf)
    tail = F.when(F.col("doc_id") % 4 == 0, ' The colour of the center was "favorite" here.').when(F.col("doc_id") % 4 == 1, " We organised and traveled to the theatres.").when(F.col("doc_id") % 4 == 2, " An analyzed catalog, skillful").otherwise("")
    return d.withColumn("blocks", documents.one_paragraph(F.concat("raw_text", tail)))


@query(_spelling_sql("british"))
def q_spelling_british(spark, sf):
    return audit.audit(_injected(spark, sf), one_rule("spelling_variant", variant="british")).select("doc_id", "status", "n")


@query(_spelling_sql("american"))
def q_spelling_american(spark, sf):
    return audit.audit(_injected(spark, sf), one_rule("spelling_variant", variant="american")).select("doc_id", "status", "n")


@query("""
    SELECT page_id, CASE WHEN ext IN ('html', 'md') THEN 'PASS' ELSE 'FAIL' END AS status, '.' || ext AS actual
    FROM (SELECT page_id, CASE WHEN e = '' THEN 'txt' ELSE lower(e) END AS ext FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/.][^/]*\\.([^./]+)$', 1) AS e FROM pages))""")
def q_file_type(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "^[^?#]*", 0).alias("path"), F.lit("txt").alias("file_type"), documents.one_paragraph(F.lit("x")).alias("blocks"), F.lit("{}").alias("meta"))
    return audit.audit(p, one_rule("file_type", extensions=["html", "md"])).select(F.col("doc_id").alias("page_id"), "status", "actual")


_EXT = "CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.text' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' WHEN 4 THEN '.TXT' ELSE '' END"


@query(f"""
    SELECT 'd/' || doc_id || {_EXT} AS doc_id, CASE WHEN doc_id % 6 > 1 THEN 'ERROR' WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN doc_id % 6 > 1 THEN 0 ELSE n END AS n,
        CASE doc_id % 6 WHEN 2 THEN 'unsupported file type ''.pdf'' (supported: .docx, .markdown, .md, .text, .txt)' WHEN 3 THEN 'not a valid .docx file' WHEN 4 THEN 'the file looks binary (it contains NUL bytes)'
            WHEN 5 THEN 'unsupported file type ''.'' (supported: .docx, .markdown, .md, .text, .txt)' ELSE {_PLURAL('n', 'occurrence', 'occurrences')} END AS actual
    FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[!]')) AS n FROM documents)""")
def q_file_errors(spark, sf):
    """Documents as files, of which some cannot be read: those are errors, not passes, and are not lost."""
    content = F.encode(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 6 == 4, F.lit("\0")).otherwise("")), "UTF-8")
    files = read(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.expr(_EXT)).alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))
    out = audit.audit(documents.from_bytes(files), one_rule("forbidden_punctuation", marks=["!"])).select("doc_id", "status", "n", "actual")
    return out.withColumn("actual", F.when(F.col("doc_id").endswith(".docx"), F.regexp_extract("actual", "^not a valid .docx file", 0)).otherwise(F.col("actual")))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'UNVERIFIED' WHEN m OR o OR f THEN 'FAIL' WHEN u THEN 'UNVERIFIED' ELSE 'PASS' END AS status, CASE WHEN doc_id % 5 < 4 AND NOT (m OR o OR f) AND u THEN 0.5 ELSE 1.0 END AS confidence
    FROM (SELECT doc_id, doc_id % 3 = 1 AS m, doc_id % 7 = 3 AS o, doc_id % 11 = 5 AS f, doc_id % 2 = 1 OR doc_id % 11 = 6 AS u FROM documents)""")
def q_docx_format(spark, sf):
    """Page setup against margins, orientation, font and size: wrong, not known, or no Word file at all."""
    i = F.col("doc_id")
    side = lambda wrong: F.when(wrong, F.lit(3.0)).otherwise(F.lit(2.54))
    page = lambda last: F.struct(
        F.lit(2.55).alias("margin_top_cm"), F.lit(2.5).alias("margin_bottom_cm"), side((i % 3 == 1) & F.lit(last)).alias("margin_left_cm"), F.when(i % 2 == 0, 2.54).alias("margin_right_cm"),
        F.when((i % 7 == 3) & F.lit(last), "landscape").otherwise("portrait").alias("orientation"),
    )
    meta = F.struct(F.array(page(False), page(True)).alias("sections"), F.when(i % 11 == 5, "Arial").when(i % 11 != 6, "calibri").alias("default_font_name"), F.lit(11.0).alias("default_font_size_pt"), F.lit(1.15).alias("default_line_spacing"))
    docs = flat_docs(spark, sf).withColumns({"file_type": F.when(i % 5 == 4, "md").otherwise("docx"), "meta": F.to_json(meta)})
    return audit.audit(docs, one_rule("docx_format", margin_cm=2.54, orientation="portrait", font_name="Calibri", font_size_pt=11, line_spacing=1.15)).select("doc_id", "status", "confidence")


# -- scores ---------------------------------------------------------------------------------------

FLAGSHIP = {"version": 1, "name": "corpus", "requirements": [
    {"id": "C1", "description": "100 to 400 words", "checker": "word_count", "parameters": {"min": 100, "max": 400}, "severity": "critical"},
    {"id": "C2", "description": "no exclamation marks or ampersands", "checker": "forbidden_punctuation", "parameters": {"marks": ["exclamation_mark", "ampersand"]}, "severity": "major"},
    {"id": "C3", "description": "no licence lines", "checker": "forbidden_text", "parameters": {"value": "licensed under"}, "severity": "minor"},
    {"id": "C4", "description": "says the", "checker": "required_text", "parameters": {"value": "the"}, "severity": "info"},
    {"id": "C5", "description": "reads well", "verification_type": "semantic", "severity": "major"},
    {"id": "C6", "description": "approved by a person", "verification_type": "manual", "severity": "minor", "weight": 3.5},
    {"id": "C7", "description": "not asked", "checker": "word_count", "parameters": {"min": 1}, "enabled": False},
]}

_RESULTS = f"""
    WITH facts AS (SELECT doc_id, lang, source, {_WORDS} AS w, {_MARKS} AS m, len(regexp_extract_all(coalesce(text, ''), '(?i)licensed\\s+under')) AS l, len(regexp_extract_all(coalesce(text, ''), '(?i)the')) AS t FROM documents),
    results AS (
        SELECT doc_id, lang, source, 'C1' AS id, 'critical' AS severity, 'deterministic' AS kind, 8.0 AS weight, CASE WHEN w BETWEEN 100 AND 400 THEN 'PASS' ELSE 'FAIL' END AS status FROM facts
        UNION ALL SELECT doc_id, lang, source, 'C2', 'major', 'deterministic', 4.0, CASE WHEN m = 0 THEN 'PASS' ELSE 'FAIL' END FROM facts
        UNION ALL SELECT doc_id, lang, source, 'C3', 'minor', 'deterministic', 2.0, CASE WHEN l = 0 THEN 'PASS' ELSE 'FAIL' END FROM facts
        UNION ALL SELECT doc_id, lang, source, 'C4', 'info', 'deterministic', 1.0, CASE WHEN t > 0 THEN 'PASS' ELSE 'WARNING' END FROM facts
        UNION ALL SELECT doc_id, lang, source, 'C5', 'major', 'semantic', 4.0, 'UNVERIFIED' FROM facts
        UNION ALL SELECT doc_id, lang, source, 'C6', 'minor', 'manual', 3.5, 'UNVERIFIED' FROM facts)"""


@query(_RESULTS + " SELECT doc_id, id AS requirement_id, severity, status FROM results")
def q_audit(spark, sf):
    """Six requirements, one of them advisory (info), over all documents; a seventh is disabled."""
    return audit.audit(flat_docs(spark, sf), FLAGSHIP).select("doc_id", "requirement_id", "severity", "status")


@query(_RESULTS + """
    SELECT doc_id, count(*) AS total_requirements, CAST(1 AS BIGINT) AS disabled_requirements, count(*) FILTER (kind = 'deterministic') AS machine_verifiable, count(*) FILTER (status <> 'UNVERIFIED') AS verified,
      count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'WARNING') AS n_warning, count(*) FILTER (status = 'UNVERIFIED') AS n_unverified, CAST(0 AS BIGINT) AS n_error,
      count(*) FILTER (status = 'FAIL' AND severity = 'critical') AS failed_critical, count(*) FILTER (status = 'FAIL' AND severity = 'major') AS failed_major, count(*) FILTER (status = 'FAIL' AND severity = 'minor') AS failed_minor, CAST(0 AS BIGINT) AS failed_info,
      round_even(CAST(100.0 * sum(CASE status WHEN 'PASS' THEN weight WHEN 'WARNING' THEN weight / 2 ELSE 0 END) / sum(CASE WHEN status <> 'UNVERIFIED' THEN weight END) AS DOUBLE), 1) AS compliance_score,
      round_even(CAST(100.0 * count(*) FILTER (status = 'PASS') / count(*) FILTER (status <> 'UNVERIFIED') AS DOUBLE), 1) AS unweighted_compliance, round_even(CAST(100.0 * count(*) FILTER (status <> 'UNVERIFIED') / count(*) AS DOUBLE), 1) AS verification_coverage
    FROM results GROUP BY doc_id""")
def q_summary(spark, sf):
    return audit.scores(flat_docs(spark, sf), FLAGSHIP)


@query(_RESULTS + """
    SELECT doc_id, count(*) AS items, count(*) FILTER (status <> 'UNVERIFIED') AS decided, count(*) FILTER (status = 'UNVERIFIED') AS undecided, count(*) FILTER (status = 'UNVERIFIED' AND kind = 'semantic') AS semantic,
           count(*) FILTER (status = 'UNVERIFIED' AND kind = 'manual') AS human, round_even(CAST(100.0 * count(*) FILTER (status <> 'UNVERIFIED') / count(*) AS DOUBLE), 1) AS decided_share, CAST(1 AS BIGINT) AS suppressed FROM results GROUP BY doc_id""")
def q_coverage(spark, sf):
    c = audit.coverage(F.col("results"), 1)
    d = audit.verdicts(flat_docs(spark, sf), load(FLAGSHIP)).select("doc_id", *[v.alias(k) for k, v in c.items()])
    return d.select("doc_id", "items", "decided", "undecided", F.col("reasons")["semantic_judgement"].alias("semantic"), F.col("reasons")["human_judgement"].alias("human"), "decided_share", "suppressed")


@query(_RESULTS + """
    SELECT doc_id, count(*) FILTER (status = 'FAIL' AND severity = 'critical') AS critical, count(*) FILTER (status = 'FAIL' AND severity IN ('critical', 'major')) AS major,
           count(*) FILTER (status = 'FAIL' AND severity IN ('critical', 'major', 'minor')) AS minor, count(*) FILTER (status = 'FAIL') AS "any", CAST(0 AS BIGINT) AS "none", count(*) FILTER (status IN ('FAIL', 'UNVERIFIED')) AS any_or_unverified FROM results GROUP BY doc_id""")
def q_policy(spark, sf):
    """How many results block, for each threshold."""
    r = F.col("results")
    n = {f: F.size(audit.blocking(r, f)).cast("long") for f in audit.FAIL_ON} | {"any_or_unverified": F.size(audit.blocking(r, "any", True)).cast("long")}
    return audit.verdicts(flat_docs(spark, sf), load(FLAGSHIP)).select("doc_id", *[v.alias(k) for k, v in n.items()])


@query(_RESULTS + " SELECT lang, source, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) AS n FROM results GROUP BY ROLLUP (lang, source)")
def q_corpus_rollup(spark, sf):
    """Verdicts by language and source (an extension)."""
    v = audit.exploded(audit.verdicts(flat_docs(spark, sf), load(FLAGSHIP)), "lang", "source")
    return v.rollup("lang", "source").agg(F.count_if(F.col("r.status") == "PASS").alias("passed"), F.count_if(F.col("r.status") == "FAIL").alias("failed"), F.count(F.lit(1)).alias("n"))


@query(_RESULTS + " SELECT doc_id, id AS rule_id, CASE WHEN status = 'WARNING' THEN 'warning' WHEN status = 'ERROR' OR severity IN ('critical', 'major') THEN 'error' WHEN severity = 'minor' THEN 'warning' ELSE 'note' END AS level FROM results WHERE status IN ('FAIL', 'ERROR', 'WARNING')")
def q_sarif_flat(spark, sf):
    from compliq.reports import sarif_level

    v = audit.audit(flat_docs(spark, sf), FLAGSHIP).where(F.col("status").isin("FAIL", "ERROR", "WARNING"))
    return v.select("doc_id", F.col("requirement_id").alias("rule_id"), sarif_level(F.col("status"), F.col("severity")).alias("level"))


@query(f"SELECT doc_id, {_WORDS} AS word_count, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s]') THEN 0 ELSE 1 END AS notices FROM documents")
def q_document_info(spark, sf):
    return audit.document_info(flat_docs(spark, sf)).select("doc_id", "word_count", F.size("notices").alias("notices"))


# -- projects -------------------------------------------------------------------------------------


def _manifests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All documents as files, and the same after a change: some gone, some new, some other."""
    d = read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    before = d.where("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    after = d.where("doc_id % 10 <> 1").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return before, after


_DIFF = """
    WITH files AS (SELECT doc_id, source || '/doc' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
    before AS (SELECT path, sha256(text) AS h FROM files WHERE doc_id % 10 <> 0), after AS (SELECT path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM files WHERE doc_id % 10 <> 1),
    diff AS (SELECT path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM before b FULL JOIN after a USING (path) WHERE b.h IS DISTINCT FROM a.h)"""


@query(_DIFF + " SELECT path, change FROM diff")
def q_scope_diff(spark, sf):
    return manifest.changes(*_manifests(spark, sf))


@query(_DIFF + """ SELECT path, change, CASE WHEN starts_with(path, 'src1/') OR path GLOB '*doc?2.txt' THEN 'FAIL' WHEN path GLOB 'src*2.txt' OR starts_with(path, 'src5/') THEN 'PASS' ELSE 'FAIL' END AS status,
    CASE WHEN starts_with(path, 'src1/') OR path GLOB '*doc?2.txt' THEN 'protected path changed' WHEN path GLOB 'src*2.txt' OR starts_with(path, 'src5/') THEN 'change is within the allowed scope' ELSE 'change is outside the allowed scope' END AS label FROM diff""")
def q_scope_globs(spark, sf):
    c = manifest.changes(*_manifests(spark, sf))
    return manifest.judged(c, ["src*2.txt", "src5/"], ["src1/", "*doc?2.txt"]).select("path", "change", "status", "label")


_TURN_LINES = "SELECT conv_id, turn, n - 1 AS line, x AS text FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM conversations) WHERE trim(x) <> ''"
_NORMAL = "regexp_replace(regexp_replace(lower(trim(regexp_replace({x}, '^[\\t-\\r >*\\-+0-9.)]+', ''))), '[\\t-\\r `*_]+', ' ', 'g'), '[.!]+$', '')"
_SAID = f"""WITH lines AS ({_TURN_LINES}), said AS (
        SELECT conv_id, 0 AS again, turn, line, 'Always ' || text AS raw FROM lines
        UNION ALL SELECT conv_id, 1, turn, line, CASE WHEN line % 3 = 0 THEN '* Always ' ELSE '- never ' END || text FROM lines WHERE line % 3 < 2),
    directives AS (SELECT conv_id, again, turn, line, {_NORMAL.format(x="raw")} AS norm FROM said)"""


def _turn_lines(spark, sf) -> DataFrame:
    c = read(spark, sf, "conversations")
    lines = c.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    return lines.where(F.trim("text") != "")


def _directives(spark, sf) -> DataFrame:
    """Every line of every turn as a directive; at the end of the conversation (``again``) one line of three is repeated and one reversed."""
    said = _turn_lines(spark, sf).withColumn("again", F.lit(0))
    again = said.where("line % 3 < 2").withColumn("again", F.lit(1))
    start = F.when(F.col("again") == 0, "Always ").when(F.col("line") % 3 == 0, "* Always ").otherwise("- never ")
    return said.union(again).withColumn("norm", instructions.normal(F.concat(start, "text")))


@query(_SAID + " SELECT norm, conv_id, again, turn, line FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY conv_id, again, turn, line) AS k FROM directives) WHERE k > 1")
def q_context_duplicates(spark, sf):
    """Lines whose normal form came before, over all conversations."""
    return instructions.duplicates(_directives(spark, sf), ["conv_id", "again", "turn", "line"]).select("norm", "conv_id", "again", "turn", "line")


@query(_SAID + """, d AS (SELECT *, CASE WHEN starts_with(norm, 'always ') THEN 1 ELSE -1 END AS sign, regexp_extract(norm, '^(?:always|never) (.+)$', 1) AS action FROM directives WHERE regexp_matches(norm, '^(always|never) .+'))
    SELECT x.conv_id, x.again, x.turn, x.line, x.action FROM d x WHERE EXISTS (SELECT 1 FROM d y WHERE y.conv_id = x.conv_id AND y.action = x.action AND y.sign = -x.sign AND (y.again, y.turn, y.line) < (x.again, x.turn, x.line))""")
def q_context_contradictions(spark, sf):
    """Lines whose action the same conversation commanded the other way before."""
    return instructions.contradictions(_directives(spark, sf), ["again", "turn", "line"], ["conv_id"]).select("conv_id", "again", "turn", "line", "action")


_FILE_LINE = "CASE WHEN n % 7 = 3 OR n % 7 = 5 THEN '```' WHEN n % 7 = 6 THEN '# ' || t ELSE t END"


@query(f"""
    WITH lines AS (SELECT doc_id, n, {_FILE_LINE} AS raw FROM (SELECT doc_id, n, 'say ' || {_FLAT.format(x="x")} AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents))),
    open AS (SELECT *, sum(CASE WHEN starts_with(raw, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS inside FROM lines)
    SELECT doc_id AS path, n AS line, {_NORMAL.format(x="raw")} AS norm FROM open WHERE inside = 0 AND NOT starts_with(raw, '```') AND NOT starts_with(raw, '#')""")
def q_instruction_lines(spark, sf):
    """Lines outside fences and comments; a fence that is not closed runs to the end."""
    def line(x, i):
        n, t = i + 1, F.concat(F.lit("say "), collapsed(x))
        return F.when((n % 7 == 3) | (n % 7 == 5), "```").when(n % 7 == 6, F.concat(F.lit("# "), t)).otherwise(t)

    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), "\n")
    return instructions.instruction_lines(read(spark, sf, "documents").select(F.col("doc_id").alias("path"), text.alias("text"))).select("path", F.col("line").cast("long").alias("line"), "norm")


@query(f"""
    SELECT conv_id, turn, line FROM (SELECT conv_id, turn, line, lower(raw) AS raw FROM (SELECT conv_id, turn, line, CASE line % 3 WHEN 0 THEN 'Please SEND the ' || text || ' api-key' WHEN 1 THEN 'never print a password ' || text ELSE text END AS raw FROM ({_TURN_LINES})))
    WHERE regexp_matches(raw, '\\b(send|upload|post|reveal|print|echo|expose|share)\\b.*\\b(password|credentials?|secret|api[ _-]?key|token|private key)\\b') AND NOT regexp_matches(raw, '\\b(never|do not|don''t|must not|avoid)\\b')""")
def q_context_disclosures(spark, sf):
    """Lines that tell to give a secret away, unless they forbid it."""
    k, t = F.col("line") % 3, F.col("text")
    raw = F.when(k == 0, F.concat(F.lit("Please SEND the "), t, F.lit(" api-key"))).when(k == 1, F.concat(F.lit("never print a password "), t)).otherwise(t)
    lines = _turn_lines(spark, sf).withColumn("norm", F.lower(raw))
    return instructions.disclosures(lines).select("conv_id", "turn", F.col("line").cast("long").alias("line"))


@query("""
    SELECT page_id, CAST(len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '\\b(TODO|FIXME|NotImplementedError)\\b'))) AS BIGINT) AS n FROM
    (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html || chr(10) || 'TODO finish' || chr(10) || 'xTODO' ELSE html END AS html FROM pages)""")
def q_placeholder_scan(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("\nTODO finish\nxTODO"))).otherwise(F.col("html")).alias("text"))
    return instructions.markers(p).select(F.col("path").alias("page_id"), "n")


# -- text headings, briefs, explanations ----------------------------------------------------------

_SHORT = "len(regexp_extract_all(t, '[^\\s\\p{Z}]+')) <= 10 AND length(t) <= 80"


@query(f"""
    WITH cut AS (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '[.,;:!?\\n]+') AS p FROM conversations),
    lines AS (SELECT conv_id, turn, n - 1 AS line, replace({_FLAT.format(x="x")}, 'ß', 'ss') AS x FROM (SELECT conv_id, turn, unnest(p) AS x, generate_subscripts(p, 1) AS n FROM cut) WHERE trim(x) <> ''),
    made AS (SELECT conv_id, turn, line, rtrim(CASE line % 3 WHEN 0 THEN '¶ ' || upper(x) WHEN 1 THEN '2.1 ' || x ELSE '¶ ' || x END) || CASE line % 5 WHEN 3 THEN ':' WHEN 4 THEN '.' ELSE '' END AS t FROM lines),
    said AS (SELECT *, {_SHORT} AND right(t, 1) NOT IN ('.', ',', ';', '!', '?', ':') AS short, {_SHORT} AND right(t, 1) NOT IN ('.', ',', ';', '!', '?') AS lone, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 3 AND t = upper(t) AS loud FROM made),
    levels AS (SELECT *, CASE WHEN short AND line % 3 = 1 THEN 2 WHEN short AND loud THEN 1 END AS level FROM said)
    SELECT conv_id || '/' || turn AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY line) AS INT) AS position, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS kind, level, level IS NULL AND lone AS candidate, t AS text FROM levels""")
def q_text_headings(spark, sf):
    """Headings that plain text implies, by numbering and by capitals, and lone lines that may be headings: all turns, cut to short lines."""
    pieces = F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.,;:!?\n]+", -1)).alias("line", "text")
    lines = read(spark, sf, "conversations").select("conv_id", "turn", pieces).where(F.trim("text") != "")
    x = F.replace(collapsed(F.col("text")), F.lit("ß"), F.lit("ss"))
    line = F.rtrim(F.when(F.col("line") % 3 == 0, F.concat(F.lit("¶ "), F.upper(x))).when(F.col("line") % 3 == 1, F.concat(F.lit("2.1 "), x)).otherwise(F.concat(F.lit("¶ "), x)))
    line = F.concat(line, F.when(F.col("line") % 5 == 3, ":").when(F.col("line") % 5 == 4, ".").otherwise(""))
    turns = lines.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))).alias("x"))
    docs = turns.select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), F.array_join(F.transform("x", lambda v: v["text"]), "\n\n").alias("text"))
    return documents.from_text(docs, "txt").select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.position", "b.kind", "b.level", "b.candidate", "b.text")


@query("""
    WITH b AS (SELECT doc_id, 100 + doc_id % 900 AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'SG001' AS requirement_id, CASE WHEN doc_id % 4 < 2 THEN 'word_count' WHEN doc_id % 4 = 2 THEN 'forbidden_punctuation' END AS checker, CASE doc_id % 4 WHEN 0 THEN '{"min": ' || n || '}' WHEN 1 THEN '{"max": ' || n || '}' WHEN 2 THEN '{"marks": ["em_dash"]}' ELSE '{}' END AS parameters,
           CASE WHEN doc_id % 4 = 3 THEN 'semantic' ELSE 'deterministic' END AS kind FROM b
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'SG002', 'element_count', '{"element": "tables", "exact": ' || n || '}', 'deterministic' FROM b WHERE doc_id % 4 = 2""")
def q_extract(spark, sf):
    """Requirements of one brief per document."""
    from compliq.extract import extract_table

    n = (F.lit(100) + F.col("doc_id") % 900).cast("string")
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Write at least "), n, F.lit(" words."))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Do not write more than "), n, F.lit(" words.")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Do not use em dashes. Use exactly "), n, F.lit(" tables."))).otherwise("Write with warmth in a formal tone.")
    )
    return extract_table(read(spark, sf, "documents").select("doc_id", text.alias("text"))).select("doc_id", "requirement_id", "checker", "parameters", "kind")


#: By recogniser: a brief over w (a made-up word), v (another) and n (100 to 999), and what must come of it: checker, parameters, kind, category, severity.
_BRIEFS = {
    "preservation": ("'Keep the slogan exactly as written: \"' || w || ' and ' || v || '\".'", [("preserve_text", "'{\"text\": \"' || w || ' and ' || v || '\"}'", "deterministic", "preservation", "critical")]),
    "preservation_manual": ("'Do not rephrase the ' || w || ' statement.'", [(None, "'{}'", "manual", "preservation", "critical")]),
    "title": ("'Use the title \"' || w || ' ' || v || '\".'", [("required_text", "'{\"values\": [\"' || w || ' ' || v || '\"], \"case_sensitive\": true}'", "deterministic", "content", "major")]),
    "section_order": ("'Put the ' || upper(w) || ' section after the ' || upper(v) || ' section.'", [("required_section", "'{\"headings\": [\"' || upper(v) || '\", \"' || upper(w) || '\"], \"ordered\": true}'", "deterministic", "structure", "major")]),
    "stated_fact": ("'State the total ' || w || ' as ' || n || ' pounds.'", [("required_text", "'{\"values\": [\"' || n || ' pounds\"], \"whole_word\": true}'", "deterministic", "content", "major")]),
    "counted_fact": ("'Say that ' || n || ' ' || w || ' have come.'", [("required_text", "'{\"values\": [\"' || n || ' ' || w || '\"], \"whole_word\": true}'", "deterministic", "content", "major")]),
    "spelling": ("CASE n % 2 WHEN 0 THEN 'Write the ' || w || ' in UK English.' ELSE 'Please use American spelling for ' || w || '.' END", [("spelling_variant", "CASE n % 2 WHEN 0 THEN '{\"variant\": \"british\"}' ELSE '{\"variant\": \"american\"}' END", "deterministic", "style", "minor")]),
    "placeholders": ("'Leave no placeholder in the ' || w || '.'", [("forbidden_regex", None, "deterministic", "content", "major")]),
    "closing_conclusion": ("'Finish the ' || w || ' with a short clear conclusion.'", [("required_section", "'{\"headings\": [[\"Conclusion\", \"Conclusions\"]]}'", "deterministic", "structure", "major")]),
    "term_position": ("'Mention the ' || w || ' ' || v || CASE n % 2 WHEN 0 THEN ' in the opening paragraph.' ELSE ' within the last paragraph.' END", [("required_text", "'{\"values\": [\"' || w || ' ' || v || '\"], \"within\": \"' || CASE n % 2 WHEN 0 THEN 'first' ELSE 'last' END || '_paragraph\"}'", "deterministic", "terminology", "major")]),
    "citation_style": ("'Use ' || CASE n % 2 WHEN 0 THEN 'numbered' ELSE 'author-date' END || ' in-text citations for ' || w || '.'", [("required_regex", None, "deterministic", "formatting", "major")]),
    "list_count": ("'Include a ' || CASE n % 2 WHEN 0 THEN 'numbered' ELSE 'bulleted' END || ' list of no fewer than ' || n || ' ' || w || ' steps.'", [("element_count", "'{\"element\": \"' || CASE n % 2 WHEN 0 THEN 'numbered_items' ELSE 'bullets' END || '\", \"min\": ' || n || '}'", "deterministic", "count", "major")]),
    "word_range": ("'Write the ' || w || ' in ' || n || ' to ' || (n + 50) || ' words.'", [("word_count", "'{\"min\": ' || n || '}'", "deterministic", "count", "critical"), ("word_count", "'{\"max\": ' || (n + 50) || '}'", "deterministic", "count", "critical")]),
    "word_limit": ("CASE n % 4 WHEN 0 THEN 'Keep the ' || w || ' below ' || n || ' words.' WHEN 1 THEN 'Do not write more than ' || n || ' words on ' || w || '.' WHEN 2 THEN 'The ' || w || ' needs more than ' || n || ' words.' ELSE 'The ' || w || ' must have exactly ' || n || ' words.' END",
        [("word_count", "CASE n % 4 WHEN 0 THEN '{\"max\": ' || (n - 1) || '}' WHEN 1 THEN '{\"max\": ' || n || '}' WHEN 2 THEN '{\"min\": ' || (n + 1) || '}' ELSE '{\"exact\": ' || n || '}' END", "deterministic", "count", "critical")]),
    "word_about": ("'Write a ' || n || '-word ' || w || '.'", [(None, "'{}'", "manual", "count", "minor")]),
    "other_lengths": ("'The ' || w || ' must not exceed ' || n || ' pages.'", [(None, "'{}'", "unsupported", "count", "major")]),
    "forbidden_element": ("'Do not use any ' || CASE n % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'bullet points' ELSE 'code blocks' END || ' in the ' || w || '.'", [("element_count", "'{\"element\": \"' || CASE n % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'bullets' ELSE 'code_blocks' END || '\", \"exact\": 0}'", "deterministic", "formatting", "major")]),
    "forbidden_punctuation": ("'Avoid em dashes, exclamation marks and semi-colons in the ' || w || '.'", [("forbidden_punctuation", "'{\"marks\": [\"em_dash\", \"exclamation_mark\", \"semicolon\"]}'", "deterministic", "style", "major")]),
    "forbidden_quoted": ("'Never use the phrases \"' || w || '\", \"' || v || ' x\" and \"' || n || '\".'", [("forbidden_text", "'{\"values\": [\"' || w || '\", \"' || v || ' x\", \"' || n || '\"]}'", "deterministic", "terminology", "major")]),
    "forbidden_words": ("'Avoid the words ' || w || ' and ' || v || '.'", [("forbidden_text", "'{\"values\": [\"' || w || '\", \"' || v || '\"], \"whole_word\": true}'", "deterministic", "terminology", "major")]),
    "forbidden_todo": ("'Leave no TBD in the ' || w || ' and no FIXME.'", [("forbidden_text", "'{\"values\": [\"TBD\", \"FIXME\"], \"whole_word\": true, \"case_sensitive\": true}'", "deterministic", "content", "major")]),
    "element_between": ("'Use between ' || n || ' and ' || (n + 3) || ' short ' || w || ' references.'", [("element_count", "'{\"element\": \"references\", \"min\": ' || n || ', \"max\": ' || (n + 3) || '}'", "deterministic", "count", "major")]),
    "element_count": ("CASE n % 3 WHEN 0 THEN 'Cite at least five ' || w || ' sources.' WHEN 1 THEN 'Do not use more than ' || n || ' tables.' ELSE 'Add over ' || n || ' headings.' END", [("element_count", "CASE n % 3 WHEN 0 THEN '{\"element\": \"references\", \"min\": 5}' WHEN 1 THEN '{\"element\": \"tables\", \"max\": ' || n || '}' ELSE '{\"element\": \"headings\", \"min\": ' || (n + 1) || '}' END", "deterministic", "count", "major")]),
    "element_unclear": ("'Include ' || n || CASE n % 2 WHEN 0 THEN ' tables.' ELSE ' ' || w || ' citations.' END", [(None, "'{}'", "CASE n % 2 WHEN 0 THEN 'manual' ELSE 'unsupported' END", "count", "major")]),
    "occurrences": ("'Mention ' || w || ' ' || v || CASE n % 3 WHEN 0 THEN ' at least twice.' WHEN 1 THEN ' exactly ' || n || ' times.' ELSE ' at most once.' END", [("occurrences", "'{\"text\": \"' || w || ' ' || v || CASE n % 3 WHEN 0 THEN '\", \"min\": 2}' WHEN 1 THEN '\", \"exact\": ' || n || '}' ELSE '\", \"max\": 1}' END", "deterministic", "terminology", "major")]),
    "quoted_heading": ("'Add the headings \"' || w || '\" and \"' || v || '\".'", [("required_section", "'{\"headings\": [\"' || w || '\"]}'", "deterministic", "structure", "major"), ("required_section", "'{\"headings\": [\"' || v || '\"]}'", "deterministic", "structure", "major")]),
    "section_list": ("'Include the sections ' || w || ', Results and ' || v || '.'", [("required_section", "'{\"headings\": [\"' || w || '\"]}'", "deterministic", "structure", "major"), ("required_section", "'{\"headings\": [[\"Results\", \"Findings\"]]}'", "deterministic", "structure", "major"), ("required_section", "'{\"headings\": [\"' || v || '\"]}'", "deterministic", "structure", "major")]),
    "section_bullets": ("'Use these headings:' || chr(10) || '- ' || w || chr(10) || '2. The ' || v || ';' || chr(10)", [("required_section", "'{\"headings\": [\"' || w || '\"]}'", "deterministic", "structure", "major"), ("required_section", "'{\"headings\": [\"' || v || '\"]}'", "deterministic", "structure", "major")]),
    "named_section": ("'Include an abstract and a conclusion.'", [("required_section", "'{\"headings\": [\"Abstract\"]}'", "deterministic", "structure", "major"), ("required_section", "'{\"headings\": [[\"Conclusion\", \"Conclusions\"]]}'", "deterministic", "structure", "major")]),
    "required_text": ("'You must include the word \"' || w || '\".'", [("required_text", "'{\"values\": [\"' || w || '\"], \"whole_word\": true}'", "deterministic", "terminology", "major")]),
    "file_type": ("'Deliver the ' || w || CASE n % 3 WHEN 0 THEN ' as a Word document.' WHEN 1 THEN ' in plain text.' ELSE ' as a .md file.' END", [("file_type", "'{\"extensions\": [\"' || CASE n % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'txt' ELSE 'md' END || '\"]}'", "deterministic", "file", "major")]),
    "fallback": ("CASE n % 4 WHEN 0 THEN 'Use Times New Roman for ' || w || '.' WHEN 1 THEN 'Make the ' || w || ' visually appealing.' WHEN 2 THEN 'Keep the ' || w || ' in a formal tone.' ELSE 'Explain the ' || w || ' in depth.' END",
        [(None, "'{}'", "CASE n % 4 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'manual' ELSE 'semantic' END", "CASE n % 4 WHEN 0 THEN 'formatting' WHEN 1 THEN 'other' WHEN 2 THEN 'style' ELSE 'content' END", "CASE n % 4 WHEN 0 THEN 'major' WHEN 3 THEN 'major' ELSE 'minor' END")]),
    "clauses": ("'Write at least ' || n || ' words and avoid em dashes; the ' || w || ' e.g. the ' || v || ' may stay. Then use exactly 3 tables. Is the ' || w || ' done? Nice ' || w || '.'",
        [("word_count", "'{\"min\": ' || n || '}'", "deterministic", "count", "critical"), ("forbidden_punctuation", "'{\"marks\": [\"em_dash\"]}'", "deterministic", "style", "major"), ("element_count", "'{\"element\": \"tables\", \"exact\": 3}'", "deterministic", "count", "major")]),
    "chunks": ("'Rules:' || chr(10) || '* At least ' || n || ' words' || chr(13) || chr(10) || '1) Copy the following exactly:' || chr(10) || '   not this' || chr(10) || 'Keep this text unchanged:' || chr(10) || '> ' || w || chr(10) || '    ' || v || chr(10) || chr(10) || '> outside'",
        [("word_count", "'{\"min\": ' || n || '}'", "deterministic", "count", "critical"), (None, "'{}'", "manual", "preservation", "critical"), ("preserve_text", "'{\"text\": \"' || w || '\\n' || v || '\"}'", "deterministic", "preservation", "critical")]),
}
_FROM_DOCS = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, 100 + doc_id % 900 AS n, 'zor' || regexp_extract(coalesce(text, ''), '[a-z]+') AS w, 'quim' || regexp_extract(coalesce(text, ''), '[a-z]+[^a-z]+([a-z]+)', 1) AS v FROM documents"""


def _brief_query(name: str, brief: str, wanted: list[tuple]) -> None:
    text = lambda x: x if x and x.startswith(("CASE", "'")) else "NULL" if x is None else f"'{x}'"
    rows = " UNION ALL ".join(
        f"SELECT doc_id, 'SG{k:03d}' AS requirement_id, {text(c)} AS checker, {'NULL' if p is None else p} AS parameters, {text(kind)} AS kind, {text(category)} AS category, {text(severity)} AS severity FROM d" for k, (c, p, kind, category, severity) in enumerate(wanted, 1)
    )

    @query(f"WITH d AS ({_FROM_DOCS}) SELECT doc_id, requirement_id, CAST(checker AS VARCHAR) AS checker, CAST(parameters AS VARCHAR) AS parameters, kind, category, severity FROM ({rows})")
    def run(spark, sf):
        """Requirements of one brief for each document."""
        from compliq.extract import extract_table

        t = F.coalesce("text", F.lit(""))
        words = {"w": F.concat(F.lit("zor"), F.regexp_extract(t, "[a-z]+", 0)), "v": F.concat(F.lit("quim"), F.regexp_extract(t, "[a-z]+[^a-z]+([a-z]+)", 1)), "n": F.lit(100) + F.col("doc_id") % 900}
        briefs = read(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in words.items()]).select("doc_id", F.expr(brief).alias("text"))
        out = extract_table(briefs).where("requirement_id is not null")
        shown = F.lit(None).cast("string") if any(p is None for _, p, *_ in wanted) else F.col("parameters")
        return out.select("doc_id", "requirement_id", "checker", shown.alias("parameters"), "kind", "category", "severity")

    QUERIES[f"q_extract_{name}"], ORACLE_SQL[f"q_extract_{name}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _name, _brief in _BRIEFS.items():
    _brief_query(_name, *_brief)


@query()
def q_preserve_explained(spark, sf):
    """Where protected passages were changed or are missing, and how they differ."""
    out = audit.audit_in_detail(flat_docs(spark, sf), one_rule("preserve_text", texts=passages(spark, sf)))
    return out.select("doc_id", "status", "actual", F.get_json_object("details", "$.changed").alias("changed"), F.get_json_object("details", "$.missing").alias("missing"))


#: Wrong specifications, by number: requirements in YAML over i (a text) and n (a number), and the issues that they have: path and message.
_WRONG = [
    ("'[{id: A, description: d, checker: word_cuont}]'", [("'requirements[0] (A)'", "'unknown checker ' || chr(39) || 'word_cuont' || chr(39) || ' (did you mean ' || chr(39) || 'word_count' || chr(39) || '?)'")]),
    ("'[{id: R' || i || ', description: d, verification_type: manual}, {id: R' || i || ', description: d, verification_type: semantic}]'", [("'requirements[1] (R' || i || ')'", "'duplicate id ' || chr(39) || 'R' || i || chr(39) || ' (first used at requirements[0])'")]),
    ("'[{id: A, description: d, checker: word_count, parameters: {maxx: ' || n || '}}]'", [("'requirements[0] (A).parameters'", "'unknown parameter ' || chr(39) || 'maxx' || chr(39) || ' (did you mean ' || chr(39) || 'max' || chr(39) || '?)'")]),
    ("'[{id: A, description: d, checker: word_count, parameters: {min: ' || (n + 1) || ', max: ' || n || '}}]'", [("'requirements[0] (A).parameters'", "'min (' || (n + 1) || ') is greater than max (' || n || ')'")]),
    ("'[{id: B' || i || ', description: d, verification_type: deterministic}, {id: C, description: d, checker: forbidden_regex, parameters: {pattern: \"(\"}}]'", [("'requirements[0] (B' || i || ')'", "'a deterministic requirement needs a checker'"), ("'requirements[1] (C).parameters'", "'invalid regular expression: missing ) at position 1'")]),
    ("'[{id: A, description: d, severity: huge, verification_type: manual}, {id: B, description: \"\"}]'", [("'requirements[0].severity'", "'must be one of: critical, major, minor, info'"), ("'requirements[1].description'", "'must be a non-empty string'")]),
    ("'[{id: A, description: d, checker: word_count, parameters: {min: ' || n || '}}]'", []),
]


@query("WITH d AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS i, 10 + doc_id % 90 AS n FROM documents) " + " UNION ALL ".join(
    f"SELECT i AS doc_id, {o} AS ord, 'error' AS level, {path} AS path, {message} AS message FROM d WHERE k % {len(_WRONG)} = {k}" for k, (_, issues) in enumerate(_WRONG) for o, (path, message) in enumerate(issues)
))
def q_validation_issues(spark, sf):
    """Problems of specifications, one for each document."""
    made = "CASE doc_id % " + str(len(_WRONG)) + "".join(f" WHEN {k} THEN {text}" for k, (text, _) in enumerate(_WRONG)) + " END"
    d = read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("i"), (F.lit(10) + F.col("doc_id") % 90).alias("n"))
    return audit.validate_table(d.select("doc_id", F.concat(F.lit("version: 1\nname: x\nrequirements: "), F.expr(made)).alias("spec")))


_LINES_WITH = "(SELECT count(*) FROM (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS x) WHERE regexp_matches(x, '[!&]'))"
_NUMBER = lambda x: f"format('{{:,}}', {x})"


_DETAIL = f"""
    WITH facts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_WORDS} AS w, {_MARKS} AS m, len(regexp_extract_all(coalesce(text, ''), '(?i)licensed\\s+under')) AS l, len(regexp_extract_all(coalesce(text, ''), '(?i)the')) AS t,
        CAST(contains(coalesce(text, ''), '!') AS INT) + CAST(contains(coalesce(text, ''), '&') AS INT) AS marks, {_LINES_WITH} AS lines FROM documents d)
    SELECT doc_id, 'C1' AS requirement_id, CASE WHEN w BETWEEN 100 AND 400 THEN 'PASS' ELSE 'FAIL' END AS status, 'Word count is ' || {_NUMBER('w')} || CASE WHEN w BETWEEN 100 AND 400 THEN ', which is between 100 and 400 words.'
        WHEN w < 100 THEN '; required between 100 and 400 words (short by ' || (100 - w) || ').' ELSE '; required between 100 and 400 words (over by ' || {_NUMBER('w - 400')} || ').' END AS message, 1 AS n_evidence, 0 AS n_locations FROM facts
    UNION ALL SELECT doc_id, 'C2', CASE WHEN m = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN m = 0 THEN 'Punctuation within the limit (0 occurrences).' ELSE 'Found ' || {_PLURAL('m', 'occurrence', 'occurrences')} || ' of forbidden punctuation.' END,
        CASE WHEN m = 0 THEN 0 ELSE marks + least(lines, 5) END, least(m, 50) FROM facts
    UNION ALL SELECT doc_id, 'C3', CASE WHEN l = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN l = 0 THEN 'No forbidden text found.' ELSE 'Found ' || {_PLURAL('l', 'occurrence', 'occurrences')} || ' of forbidden text.' END, NULL, least(l, 50) FROM facts
    UNION ALL SELECT doc_id, 'C4', CASE WHEN t > 0 THEN 'PASS' ELSE 'WARNING' END, CASE WHEN t > 0 THEN 'Required text found.' ELSE 'Required text not found: "the". (advisory: severity is info)' END, 1, least(t, 1) FROM facts
    UNION ALL SELECT doc_id, 'C5', 'UNVERIFIED', 'This requirement needs semantic judgement. No semantic verifier is configured. It was not tested.', 0, 0 FROM facts
    UNION ALL SELECT doc_id, 'C6', 'UNVERIFIED', 'This requirement needs a human to judge it. It cannot be tested.', 0, 0 FROM facts"""


@query(_DETAIL)
def q_audit_in_detail(spark, sf):
    """Messages, evidence and places of the flagship specification; places are capped at 50, samples at 5 lines."""
    return _detailed(audit.audit_in_detail(flat_docs(spark, sf), FLAGSHIP))


@query(f"SELECT * FROM ({_DETAIL}) WHERE status IN ('FAIL', 'WARNING')")
def q_explain(spark, sf):
    """The same, of what compiled rules found to fail."""
    return _detailed(audit.explain(flat_docs(spark, sf), FLAGSHIP))


def _detailed(out: DataFrame) -> DataFrame:
    evidence = F.when(F.col("requirement_id") != "C3", F.size("evidence").cast("long"))
    return out.select("doc_id", "requirement_id", "status", "message", evidence.alias("n_evidence"), F.size("locations").cast("long").alias("n_locations"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return q_audit(spark, sf)
