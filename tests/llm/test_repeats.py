import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from compliq.llm import common, repeats
from tests.llm.helpers import awkward, documents, empty

L = 200


def brute(texts, L=L):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + L] for d in data for p in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - L + 1):
            if seen[d[p : p + L]] > 1:
                gone[p : p + L] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(docs, L=L):
    out = []
    for r in repeats.repeated_spans(docs, length=L).collect():
        spans = [s.asDict() for s in r.spans]
        out.append((r.doc_id, len(r.text), sum(s["end"] - s["begin"] for s in spans), len(spans), hashlib.sha256(repeats.cut(bytes(r.text), spans)).hexdigest()))
    return sorted(out, key=str)


def check(docs, L=L):
    rows = docs.collect()
    assert run(docs, L) == sorted([(r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], L))], key=str)


def test_identifiers_follow_content():
    a, b = (repeats.identifiers(x, 8, 32, 128) for x in (b"q" * 3 + bytes(range(200)), bytes(range(200))))
    assert all((x[3:] == y).all() for x, y in zip(a, b))
    assert [len(x) for x in b] == [193, 169, 73]


def test_a_table(spark, sf):
    check(common.table(spark, sf, "documents").where("doc_id < 90"))


def test_edits_passages_runs_and_pieces(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(400), text(60)
    rows = [base, base]
    for _ in range(12):  # near copies: edits at different gaps
        w = list(base)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = rng.choice("XYZ")
        rows.append("".join(w))
    rows += [text(30) + passage + text(30) for _ in range(6)] + [passage[:250], passage[5:205], passage[5:204]]
    rows += ["z" * 199, "y" * 200, "x" * 201, "Er " * 300, text(5) + "Er " * 90 + text(5), base[:1000] + base[500:1500], "tail " * 100 + base[-300:]]
    check(documents(spark, list(enumerate(rows))))


def test_long_texts_are_cut_in_pieces(monkeypatch):
    """The pieces' windows are the text's windows, each once."""
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(6)
    data = bytes(rng.choice(b"abcdef") for _ in range(5321))
    i, lo, hi, at, bucket, stretch = repeats.suffixes([data, b"short", data[:400], data])
    for k, n in ((0, len(data)), (2, 400), (3, len(data))):
        mine = i == k
        covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[mine], hi[mine])])
        assert sorted(covered) == list(range(n - L + 1))
    assert sorted(zip(lo[i == 0], bucket[i == 0], stretch[i == 0])) == sorted(zip(lo[i == 3], bucket[i == 3], stretch[i == 3]))


@pytest.mark.parametrize("length", [48, 79, 143, 255, 400])
def test_other_lengths(spark, length):
    rng = random.Random(8)
    base = "".join(rng.choice("abcd ") for _ in range(1500))
    check(documents(spark, [(i, base[rng.randrange(500) :][: rng.randrange(30, 900)] + str(i) * rng.randrange(3)) for i in range(60)]), length)


def test_texts_are_shuffled_once(spark, sf, capsys):
    """What is asked comes to the texts, not they to it."""
    repeats.op1_suffix_dedup(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    shuffles = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert "ShuffledHashJoin" in plan and shuffles and not any("text#" in x for x in shuffles)


def test_units_fit_lengths():
    for length in range(48, 2000):
        size = repeats.unit(length)
        assert 32 <= size <= length - repeats.BLOCK + 1 < 2 * size
    for length in (47, repeats.PIECE):
        with pytest.raises(ValueError):
            repeats.unit(length)


def test_the_query_is_the_brute_force_over_a_table(spark, tmp_path):
    """The query's two ways, of texts that lose something and of those that do not."""
    rows = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.001", "documents").where("doc_id % 3 = 0").collect()] + [(9001, None), (9002, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in repeats.op1_suffix_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]))], key=str)


def test_awkward_and_empty(spark):
    check(awkward(spark).where("n_chars < 1000").union(documents(spark, [(8, "ab" * 400), (9, None)])))
    assert repeats.repeated_spans(empty(spark)).count() == 0
