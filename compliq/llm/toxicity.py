"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A document is a bag of sentences. A sentence's probability is logistic in the features of its distinct words (the word and its
prefixes, so that stems in inflected languages count); a sentence without any known feature has probability 0. The document's is
the noisy-or 1 - prod(1 - p). Only document labels are known, so the gradient of the document's loss goes through the noisy-or to
the sentences, and afterwards the sentences' own scores tell where the offence is.

Fitted on a bounded sample: at most ``sample`` positive and ``sample`` negative labelled documents, those with the smallest hash of
the id, and of these, in the order of a hash of the text, as many as have ``hits`` features in all. Features are kept if they are commoner in positive documents by ``lift``
and by a log-likelihood ratio of ``evidence`` (half of that where none reaches it), at most ``most``. Executors count features and reduce the texts to the numbers of the
features in their sentences, equal sentences counted once, so the task that fits gets numbers of a bounded size and no text.

Defined results: null text counts as empty; an empty text, or one without known features, scores 0; repeated rows score alike;
null labels or ids are no examples; an id with several labels is toxic if one says so, and so are equal texts; of features of equal evidence the lesser string goes
first; without labels of both kinds nothing is known and everything scores 0; an empty table gives an
empty result; other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compliq.llm.common import held_out, materialize, slices, table, text_of

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
PREFIXES = (3, 4, 5, 6, 7)
#: Log odds of a sentence whose features all weigh 0: fixed, so that features must explain.
BIAS = -3.0
#: Words whose score a worker remembers, at most.
CACHE = 500_000


def features(word: str) -> list[str]:
    """The word without its edges, lower-cased, and its prefixes (marked as such)."""
    w = EDGE.sub("", word).lower()
    if not w:
        return []
    return [w, *(w[:k] + "*" for k in PREFIXES if len(w) >= k)]


class Features(dict):
    """Word -> the numbers of its features that ``index`` knows (or the features themselves), filled as words are met."""

    def __init__(self, index: dict[str, int] | None = None):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> list:
        found = features(word)
        if self.index is not None:
            found = [self.index[f] for f in found if f in self.index]
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found


def counted(texts: list[str], toxic: list[int], of: Features) -> dict[str, list[int]]:
    """Feature -> in how many negative and positive texts it is."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for t, y in zip(texts, toxic, strict=True):
        for f in {f for w in set(t.split()) for f in of[w]}:
            seen[f][y] += 1
    return seen


def bag(text: str, of: Features) -> list[tuple[tuple[int, ...], int]]:
    """The sentences with known features: numbers of these and how often a sentence with just them occurs."""
    if not any(of[w] for w in set(text.split())):
        return []
    found = Counter(tuple(sorted(hit)) for s in SENTENCE.findall(text) if (hit := [i for w in set(s.split()) for i in of[w]]))
    return sorted(found.items())


def evidence_of(k: float, other: float, n_pos: int, n_neg: int) -> float:
    """Log-likelihood ratio of a feature in ``k`` positive and ``other`` negative documents."""
    share, all_share = k / (k + other), n_pos / (n_pos + n_neg)
    return 2 * (k * np.log(share / all_share) + (other * np.log((1 - share) / (1 - all_share)) if other else 0.0))


def descend(bags: list[list[tuple[tuple[int, ...], int]]], toxic: np.ndarray, k: int, n_pos: int, n_neg: int, *, steps: int = 300, rate: float = 0.1, alone: float = 6.0) -> np.ndarray:
    """Weights (not negative) of the k features, by full-batch Adam on the noisy-or's log loss.

    Documents without any known feature score 0 whatever the weights, so only those with some are given; ``n_pos`` and ``n_neg`` count all. An L1
    penalty makes a feature pay only if it explains over about ``alone`` positive documents that no other feature explains.
    """
    sentences = [(d, hit, times) for d, b in enumerate(bags) for hit, times in b]
    sent = np.repeat(np.arange(len(sentences)), [len(hit) for _, hit, _ in sentences]).astype(np.int64)
    feat = np.array([i for _, hit, _ in sentences for i in hit], np.int64)
    doc_of, times = np.array([d for d, _, _ in sentences], np.int64), np.array([t for _, _, t in sentences], float)
    n = len(bags)
    w = np.full(k, 0.05)
    l1 = 0.5 / n_pos * min(alone, n_pos / 200)
    m, v = np.zeros(k), np.zeros(k)
    weight = np.where(toxic > 0, 0.5 / n_pos, 0.5 / n_neg)
    for step in range(1, steps + 1):
        z = BIAS + np.bincount(sent, w[feat], len(doc_of))
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc_of, -times * np.logaddexp(0, z), n)  # log of prod(1 - p)
        score = np.clip(1 - np.exp(clean), 1e-9, 1)
        slope = np.where(toxic > 0, -(1 - score) / score, 1.0) * weight
        dz = slope[doc_of] * p * times
        g = np.bincount(feat, dz[sent], k) + l1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = np.maximum(w - move, 0)
    return w


def model_of(names: list[str], weights: np.ndarray) -> dict:
    return {"bias": BIAS, "weights": {f: float(x) for f, x in zip(names, weights, strict=True) if x > 0}}


def fit(texts: list[str], toxic: np.ndarray, *, evidence: float = 25.0, lift: float = 3.0, most: int = 20_000, **how) -> dict:
    """As ``train``, of texts at hand."""
    label: dict[str, int] = {}
    for t, y in zip(texts, toxic, strict=True):
        label[t] = max(label.get(t, 0), int(y))
    n_pos = sum(label.values())
    n_neg = len(label) - n_pos
    if not n_pos or not n_neg:
        return model_of([], np.zeros(0))
    seen = counted(list(label), list(label.values()), Features())
    ratio = {f: evidence_of(k, o, n_pos, n_neg) for f, (o, k) in seen.items() if k and (k + 0.5) / (n_pos + 1) >= lift * (o + 0.5) / (n_neg + 1)}
    names = chosen_features(ratio, evidence, most)
    of = Features({f: i for i, f in enumerate(names)})
    bags = [(b, y) for t, y in label.items() if (b := bag(t, of))]
    return model_of(names, descend([b for b, _ in bags], np.array([y for _, y in bags]), len(names), n_pos, n_neg, **how))


def chosen_features(ratio: dict[str, float], evidence: float, most: int) -> list[str]:
    bar = evidence if any(r >= evidence for r in ratio.values()) else evidence / 2
    return sorted((f for f, r in ratio.items() if r >= bar), key=lambda f: (-round(ratio[f], 6), f))[:most]


class Scorer(dict):
    """Word -> (known, sum of its weights), filled as words are met."""

    def __init__(self, model: dict):
        super().__init__()
        self.bias, self.weights = model["bias"], model["weights"]

    def __missing__(self, word: str) -> float | None:
        hit = [self.weights[f] for f in features(word) if f in self.weights]
        score = sum(hit) if hit else None
        if len(self) >= CACHE:
            self.clear()
        self[word] = score
        return score

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, probability) of the sentences with a known feature, in characters."""
        words = text.split()
        if not any(s is not None for s in map(self.__getitem__, words)):
            return []
        out = []
        for m in SENTENCE.finditer(text):
            if hit := [s for w in set(m.group().split()) if (s := self[w]) is not None]:
                out.append((m.start(), m.end(), 1 / (1 + float(np.exp(-np.clip(self.bias + sum(hit), -500, 500))))))
        return out


def noisy_or(ps: list[float]) -> float:
    return float(1 - np.prod([1 - p for p in ps])) if ps else 0.0


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, sample: int = 4000,
    evidence: float = 25.0, lift: float = 3.0, most: int = 20_000, hits: int = 4_000_000,
) -> dict:
    """The model; ``learn`` tells which labelled rows may be used."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y"), (F.lit(True) if learn is None else learn).alias("may"))
    known = known.where("may and id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = known.where("y = 1").orderBy(order, "id").limit(sample).union(known.where("y = 0").orderBy(order, "id").limit(sample))
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).agg(F.max("y").alias("y"), F.any_value("text").alias("text"))
    rows = materialize(rows)  # at most 2 * ``sample`` texts, each once
    n_pos, n_neg = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n_pos or not n_neg:
        return model_of([], np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for b in batches:
            toxic = b.column("y").to_pylist()
            for at, part in slices(b.column("text").to_pylist()):
                seen = counted(part, toxic[at : at + len(part)], of)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([x[k] for x in seen.values()], pa.int64()) for k in (0, 1)]], names=["feature", "neg", "pos"])

    totals = rows.select("y", "text").mapInArrow(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    lifted = totals.where((F.col("pos") > 0) & ((F.col("pos") + 0.5) / (n_pos + 1) >= lift * (F.col("neg") + 0.5) / (n_neg + 1)))
    share, all_share = F.col("pos") / (F.col("pos") + F.col("neg")), n_pos / (n_pos + n_neg)
    ratio = 2 * (F.col("pos") * F.log(share / all_share) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - all_share))).otherwise(0.0))
    best = lifted.withColumn("r", F.round(ratio, 6)).orderBy(F.desc("r"), "feature").limit(most).collect()
    names = chosen_features({r["feature"]: r["r"] for r in best}, evidence, most)
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # at most ``most``

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(shared.value)
        for b in batches:
            bags = [bag(x.as_py(), of) for x in b.column("text")]
            flat = [[x for hit, times in d for x in (times, len(hit), *hit)] for d in bags]
            n = pa.array([sum(len(hit) for hit, _ in d) for d in bags], pa.int64())
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("y"), n, pa.array(flat, pa.list_(pa.int32()))], names=["a", "b", "y", "n", "bag"])
            yield out.filter(pa.array([bool(d) for d in bags], pa.bool_()))

    bags = materialize(rows.mapInArrow(reduce_texts, "a long, b long, y int, n long, bag array<int>"))
    upto = Window.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)  # over at most 2 * ``sample`` rows
    few = bags.select("a", "b", F.sum("n").over(upto).alias("upto")).where(F.col("upto") <= hits).select("a", "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        weights = descend([list(_unflat(x)) for x in pdf["bag"]], pdf["y"].to_numpy(), len(names), n_pos, n_neg)
        return pd.DataFrame({"model": [pickle.dumps(model_of(names, weights))]})

    got = bags.join(F.broadcast(few), ["a", "b"]).groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else model_of([], np.zeros(0))


def _unflat(flat) -> Iterator[tuple[tuple[int, ...], int]]:
    i = 0
    while i < len(flat):
        n = int(flat[i + 1])
        yield tuple(int(x) for x in flat[i + 2 : i + 2 + n]), int(flat[i])
        i += 2 + n


def toxicity(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """One row per document: id, score, offences array<struct<begin, end, score>> (sentences from ``offending``, in characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most`` features
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.sentences(x.as_py()) for x in b.column("text")]
            offences = [[{"begin": s, "end": e, "score": p} for s, e, p in f if p >= offending] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([noisy_or([p for *_, p in f]) for f in found], pa.float64()), pa.array(offences, shape)], names=["id", "score", "offences"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, offences array<struct<begin:int,end:int,score:double>>").withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, model: dict, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold; read once, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([noisy_or([p for *_, p in scorer.sentences(x.as_py() or "")]) < threshold for x in b.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all of ``documents``; learns from the labelled rows outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity(docs, train(docs, labels, learn=~held_out(labels["doc_id"])))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offences").alias("n_offences"), F.to_json("offences").alias("offences"))


SQL: dict[str, str] = {}
