"""Token counts by the whole-token shortcut.

Proved once, before any text is read: which strings of the vocabulary the tokenizer encodes, alone, as one token. A text is
cut into chunks (a run of white space and the run of other characters after it); no pre-token crosses a chunk's end, so
chunks are independent and their counts can be kept. A chunk met for the first time is cut into pre-tokens by the
tokenizer's own pre-tokenizer; those that are proven count one each, and only the rest are merged.

Special strings inside a text are handled as the library does by default: each counts as its one token, and the text around
it is counted piece by piece.

Defined results: null text counts as empty (no bytes, no tokens); repeated rows are counted one by one; an empty table gives
an empty result; other columns are ignored. Texts are counted whole, however long.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compliq.llm.common import table, text_of

#: White space as the pre-tokenizer's pattern knows it (Unicode White_Space). Fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks remembered by a worker, at most; and the longest chunk that is remembered.
CACHE, CACHE_CHARS = 300_000, 64


def prove(tokenizer_json: str) -> list[str]:
    """The strings of the vocabulary (in the byte alphabet of the pre-tokenizer) that encode, alone, as one token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer_json).model
    return sorted(v for v in json.loads(tokenizer_json)["model"]["vocab"] if len(model.tokenize(v)) == 1)


class Counter(dict):
    """Chunk -> number of tokens, filled as chunks are met."""

    def __init__(self, tokenizer_json: str, proven: frozenset[str]):
        super().__init__()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.cut, self.merge, self.proven = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize, proven
        self.chunks = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        special = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, chunk: str) -> int:
        n = sum(1 if p in self.proven else len(self.merge(p)) for p, _ in self.cut(chunk))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.chunks(text)))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.plain, pieces))


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. The tokenizer's file is read by the driver alone."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, frozenset(prove(spec))))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            n = [counter.count(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every whole text of ``documents``."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


SQL: dict[str, str] = {}
