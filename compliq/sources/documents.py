"""Documents as rows: file bytes or text columns to one row per document with its blocks as an array.

All structure that rules need stands in the array, so a rule is a function of its row: an audit of a corpus is a projection
without a shuffle. Blank blocks stay in (they count as elements), marked by empty text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compliq.functions.text import heading_key
from compliq.sources import docx, lines

TYPES = {"txt": "txt", "text": "txt", "md": "md", "markdown": "md", "docx": "docx"}
MAX_BYTES = 25 * 1024 * 1024
NO_END = 1_000_000_000
BLOCK = (
    "struct<position:int,para:int,kind:string,text:string,line:int,level:int,marker:string,style:string,candidate:boolean,"
    "language:string,table:int,row:int,col:int,section:string,until:int,key:string>"
)
_ARROW = pa.list_(pa.struct([
    ("position", pa.int32()), ("para", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("level", pa.int32()), ("marker", pa.string()), ("style", pa.string()),
    ("candidate", pa.bool_()), ("language", pa.string()), ("table", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("section", pa.string()), ("until", pa.int32()), ("key", pa.string()),
]))


class DocumentError(ValueError):
    """A document cannot be read."""


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-16 by its mark, UTF-8, else Windows-1252; line ends become newlines. NUL bytes are refused."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text, name = data.decode("utf-16"), "utf-16"
    elif b"\0" in data:
        raise DocumentError("the file looks binary (it contains NUL bytes)")
    else:
        try:
            text, name = data.decode("utf-8-sig"), "utf-8"
        except UnicodeDecodeError:
            try:
                text, name = data.decode("cp1252"), "cp1252"
            except UnicodeDecodeError as e:
                raise DocumentError("the file is neither UTF-8 nor Windows-1252") from e
    return text.replace("\r\n", "\n").replace("\r", "\n"), name


def flatten(blocks: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Parsed blocks to rows of the array: tables become a table row and its cells; each gets its section, headings their end."""
    out, section = [], None
    base = dict.fromkeys(("para", "level", "marker", "style", "language", "table", "row", "col", "until", "key")) | {"candidate": False}
    for b in blocks:
        if b["kind"] == "heading":
            section = b["text"]
        row = base | {k: b.get(k) for k in ("position", "kind", "text", "line", "level", "marker", "style", "language")} | {"candidate": bool(b.get("candidate")), "section": section}
        if b["kind"] == "table":
            out.append(row | {"table": b["index"]})
            for r, cells in enumerate(b["rows"], 1):
                at = b["row_lines"][r - 1] if b.get("row_lines") else b.get("line")
                out += [row | {"kind": "table_cell", "text": c, "table": b["index"], "row": r, "col": k, "line": at} for k, c in enumerate(cells, 1)]
        else:
            out.append(row | {"para": b["index"]} | ({"key": heading_key(b["text"])} if b["kind"] == "heading" or row["candidate"] else {}))
    heads = [o for o in out if o["kind"] == "heading"]
    open_: list[dict] = []
    for h in heads:  # a heading ends the open sections of its level and below
        while open_ and open_[-1]["level"] >= h["level"]:
            open_.pop()["until"] = h["position"]
        open_.append(h)
    for h in open_:
        h["until"] = NO_END
    return out


def parse_text(text: str, file_type: str) -> dict[str, Any]:
    p = lines.parse(text, file_type)
    return {"file_type": file_type, "raw_text": text, "blocks": flatten(p.blocks), "meta": {"line_count": len(p.lines), **({"front_matter": p.front_matter} if p.front_matter is not None else {})}, "path": None, "size_bytes": None}


#: Extensions of one's own: extension -> (file type, parser of bytes to (blocks, metadata)). See ``register``.
EXTRACTORS: dict[str, tuple[str, Any]] = {}


def register(extension: str, file_type: str, parser: Any) -> None:
    """Adds a file type. ``parser(data)`` gives blocks as sources.lines makes them, and metadata; it must be importable on executors."""
    ext = extension.lower().lstrip(".")
    if not ext or ext in TYPES or ext in EXTRACTORS:
        raise ValueError(f"extension '.{ext}' is empty or taken")
    EXTRACTORS[ext] = (file_type, parser)


def supported() -> list[str]:
    return sorted({*TYPES, *EXTRACTORS})


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def parse_bytes(data: bytes, path: str) -> dict[str, Any]:
    """A file's document; raises DocumentError."""
    file_type = file_type_of(path)
    if len(data) > MAX_BYTES:
        raise DocumentError(f"the file is larger than {MAX_BYTES} bytes")
    own = EXTRACTORS.get(_suffix(path))
    if own or file_type == "docx":
        try:
            blocks, meta = (own[1] if own else docx.parse)(data)
        except (docx.DocxError, *((Exception,) if own else ())) as e:
            raise DocumentError(str(e)) from e
        rows = flatten(blocks)
        doc = {"file_type": file_type, "raw_text": "\n\n".join(r["text"] for r in rows if r["text"]), "blocks": rows, "meta": meta}
    else:
        text, encoding = decode(data)
        doc = parse_text(text, file_type)
        doc["meta"]["encoding"] = encoding
    return doc | {"path": path, "size_bytes": len(data)}


def file_type_of(path: str) -> str:
    ext = _suffix(path)
    if ext in EXTRACTORS:
        return EXTRACTORS[ext][0]
    if ext not in TYPES:
        raise DocumentError(f"unsupported file type '.{ext}' (supported: {', '.join('.' + t for t in supported())})")
    return TYPES[ext]


_COLUMNS = f"doc_id string, path string, file_type string, raw_text string, size_bytes long, blocks array<{BLOCK}>, meta string, error string"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.string()), ("path", pa.string()), ("file_type", pa.string()), ("raw_text", pa.string()), ("size_bytes", pa.int64()), ("blocks", _ARROW), ("meta", pa.string()), ("error", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])


def from_text(docs: DataFrame, file_type: str = "txt", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parsed documents from a table with a text column (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse_text(t.as_py() or "", file_type) | {"doc_id": i.as_py()} for i, t in zip(b.column(0), b.column(1), strict=True)]
            yield _batch([p | {"meta": json.dumps(p["meta"])} for p in parsed])

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _COLUMNS)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents from all files under a path, one row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return from_bytes(files.select("path", "length", "content"))


def from_bytes(files: DataFrame) -> DataFrame:
    """Parsed documents from (path, length, content). Type and size are tested before the content is read; what cannot be read is a row with ``error``."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known, small = ext.isin(supported()), F.col("length") <= MAX_BYTES
    names = ", ".join("." + t for t in supported())
    error = F.when(~known, F.concat(F.lit("unsupported file type '."), ext, F.lit(f"' (supported: {names})"))).otherwise(f"the file is larger than {MAX_BYTES} bytes")
    refused = {"doc_id": F.col("path"), "path": F.col("path"), "size_bytes": F.col("length"), "error": error}
    shape = T._parse_datatype_string(_COLUMNS)
    refused = files.where(~(known & small)).select(*[refused.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
    files = files.where(known & small).select("path", "content")

    own = dict(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        EXTRACTORS.update(own)
        for b in batches:
            out = []
            for p, c in zip(b.column(0), b.column(1), strict=True):
                name, content = p.as_py(), c.as_py() or b""
                try:
                    doc = parse_bytes(content, name)
                    out.append(doc | {"doc_id": name, "meta": json.dumps(doc["meta"])})
                except DocumentError as e:
                    out.append({"doc_id": name, "path": name, "size_bytes": len(content), "error": str(e)})
            yield _batch(out)

    return files.mapInArrow(run, _COLUMNS).unionByName(refused)


def spread(df: DataFrame, per_core: int = 4 << 20, per_task: int = 512 << 10) -> DataFrame:
    """A small table over all cores. A row group of a Parquet file is one task's, and rules cost far more than moving so few bytes; tables over ``per_core`` bytes a core stay where they are."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(1, min(cores, -(-size // per_task)))) if size < cores * per_core else df


def one_paragraph(text: Column) -> Column:
    """The array for text without structure, natively: the whole text is one paragraph."""
    values = {"position": F.lit(1), "para": F.lit(1), "kind": F.lit("paragraph"), "text": text, "line": F.lit(1), "candidate": F.lit(False)}
    fields = [f.split(":") for f in BLOCK[len("struct<") : -1].split(",")]
    return F.array(F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]))
