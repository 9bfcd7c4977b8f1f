import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compliq.llm import common, decontaminate, quality, toxicity
from tests.llm.helpers import awkward, documents, empty

SF = "/root/testdata/sf0.01"


def remainder(i):
    return zlib.crc32(str(i).encode()) % 5


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_quality_of_a_table(spark):
    rows = quality.op3_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (remainder(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(held) > 0.95


def test_quality_is_the_direct_solution_bit_by_bit_again(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    again = {r.doc_id: r.score for r in quality.quality(docs.repartition(7, "text"), labels.repartition(3)).collect()}
    assert got == again
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(quality.FOLDS))
    known = {r.doc_id: (r.quality, r.f) for r in labels.select("doc_id", "quality", fold.alias("f")).where("quality is not null").collect()}
    ids = [r.doc_id for r in docs.collect()]
    x = np.array([quality.statistics((r.text or "").encode()) for r in docs.collect()])
    at = [i for i, d in enumerate(ids) if d in known]
    y, f = np.array([known[ids[i]][0] for i in at], float), np.array([known[ids[i]][1] for i in at])
    kernel = quality.Kernel(x[at].mean(axis=0), x[at].std(axis=0), 128, 0.7)
    z = kernel(x[at])
    penalty = np.diag([0.3] * 128 + [1e-6])
    direct = lambda use: np.linalg.solve(z[use].T @ z[use] + penalty, z[use].T @ y[use])
    outside = np.array([z[i] @ direct(f != f[i]) for i in range(len(at))])
    bins = np.clip(((outside + 1) / 3 * quality.BINS).astype(int), 0, quality.BINS - 1)
    kinds = np.unique(bins)
    c, v = quality.isotonic((kinds + 0.5) / quality.BINS * 3 - 1, np.array([y[bins == k].sum() for k in kinds]), np.array([(bins == k).sum() for k in kinds], float))
    raw = kernel(x) @ direct(np.ones(len(at), bool))
    want = np.clip(0.99 * np.interp(raw, c, v) + 0.01 * np.clip(raw, 0, 1), 0, 1)
    assert np.mean(np.abs(np.array([got[d] for d in ids]) - want) < 0.01) > 0.97  # a rounded row may fall into the next bin


def test_sums_are_added_in_rounds(spark, sf, monkeypatch):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    want = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    monkeypatch.setattr(quality, "FAN", 2)
    monkeypatch.setattr(quality, "materialize", lambda df: common.materialize(df.repartition(9) if "fold" in df.columns else df))
    assert {r.doc_id: r.score for r in quality.quality(docs, labels).collect()} == want


def test_kernel_approximates_a_gaussian():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, quality.N_STATS))
    k = quality.Kernel(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), 20_000, 1.0)
    z = k(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality.N_STATS))).max() < 0.05


def test_isotonic_is_monotone_and_pools():
    x = np.arange(6.0)
    c, v = quality.isotonic(x, np.array([0, 3, 1, 2, 4, 3.0]), np.full(6, 4.0))
    assert (np.diff(v) > 0).all() and (np.diff(c) > 0).all() and len(v) < 6


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, None), (None, 1), (7, 0)], "doc_id long, quality int")
    assert quality.quality(docs, labels).count() == 9
    none = labels.where("false")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(empty(spark), labels).count() == 0


def test_toxicity_of_a_table(spark):
    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in common.table(spark, "/root/testdata/sf0.1", "labels").collect()}
    assert len(rows) == 10_000
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert auc([h[:2] for h in held]) > 0.9
    assert sum(p for _, y, p in held if not y) <= 0.02 * len(held)
    assert sum(p for _, y, p in held if y) >= 0.75 * sum(y for _, y, _ in held)


def test_offending_sentences_are_found():
    clean = [f"The {a} went home. It was {b} there! Nobody minded" for a in ("cat", "dog", "bird", "fish", "cow") for b in ("warm", "cold", "late", "dark")] * 3
    clean = [f"{t} {i}." for i, t in enumerate(clean)]
    bad = [f"{t} You grumpkin. And then more." for t in clean[:30]]
    model = toxicity.fit(clean + bad, np.array([0] * len(clean) + [1] * len(bad)))
    text = "All is well here. Such a Grumpkin! Good night."
    (found,) = [x for x in toxicity.Scorer(model).sentences(text) if x[2] >= 0.5]
    assert text[found[0] : found[1]].strip() == "Such a Grumpkin!"
    assert toxicity.noisy_or([0.5, 0.5]) == 0.75 and toxicity.noisy_or([]) == 0.0


def test_training_on_executors_is_the_fit_at_hand(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rows = docs.join(labels.where("toxic is not null"), "doc_id").select("text", "toxic").collect()
    want = toxicity.fit([r.text or "" for r in rows], np.array([r.toxic for r in rows]))["weights"]
    got = toxicity.train(docs, labels)["weights"]
    assert got.keys() == want.keys() and want and all(abs(got[f] - want[f]) < 1e-6 for f in want)
    again = toxicity.train(docs.repartition(5, "text"), labels)["weights"]
    assert again == got
    less = toxicity.train(docs, labels, hits=20)["weights"]
    assert less != got


def test_noisy_or_is_maximised_as_by_brute_force():
    """One feature marks all offending sentences: its weight makes toxic documents likely and, alone among others, must win."""
    rng = np.random.default_rng(1)
    bags, y = [], []
    for d in range(400):
        toxic = d % 2
        bags.append([((1,), int(rng.integers(1, 4))), *([((0,), 1)] if toxic else [])])
        y.append(toxic)
    w = toxicity.descend(bags, np.array(y), 2, 200, 200)
    loss = lambda a, b: -np.mean([np.log(max(q if t else 1 - q, 1e-12)) for bg, t in zip(bags, y, strict=True) for q in [1 - np.prod([(1 - 1 / (1 + np.exp(-(toxicity.BIAS + (a if h == (0,) else b))))) ** n for h, n in bg])]])
    assert w[0] > 4 and w[1] < 0.5 and loss(*w) < loss(w[0], w[1] + 1) and loss(*w) < loss(w[0] - 2, w[1])


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.toxicity(docs, model).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.train(docs, labels.where("false"))["weights"] == {}
    assert toxicity.toxicity(empty(spark), model).count() == 0
    assert toxicity.reject_toxic(docs, model).schema == docs.schema


ITEM = "Anna Miller bought 12 apples and 3 kg of pears at the market before she walked home with all of them in the rain"


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, ""), (5, "7 8 9 10 11 12")], "item_id long, text string")


def test_leaks_with_other_slots_are_found_if_consistent(spark, benchmark):
    pad = "Some other words stand here first. Then comes the rest of it"
    other = ITEM.replace("Anna", "Bob").replace("Miller", "Jones").replace("12", "15").replace("3 kg", "4 kg").replace("apples", "apples")
    docs = documents(spark, [(1, f"{pad} so {ITEM} and {pad}"), (2, f"{pad} so {other} and {pad}"), (3, pad), (4, ITEM.upper()), (5, f"x {ITEM[:60]} y"), (6, None), (7, "it is a short one, really"), (8, "1 2 3 4 5 6 7 8")])
    got = {(r.doc_id, r.item_id): r.changed for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got.keys() >= {(1, 1), (2, 1)} and got[1, 1] is False and got[2, 1] is True
    assert {d for d, _ in got} <= {1, 2, 4, 7}
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()}
    assert kept == {r for r in range(1, 9)} - {d for d, _ in got}


def test_inconsistent_slots_do_not_count():
    item = "Anna gave Anna 5 old books and Anna gave Bob 5 new books while Anna read 5 more books to Bob and to Anna"
    mixed = item.replace("Anna read", "Carl read").replace("gave Anna", "gave Dora").replace("to Anna", "to Emil")
    index = decontaminate.Index([(1, item)], 5, 2, 0.0)
    same = index.search(item, 0.0)[0]
    other = index.search(mixed, 0.0)[0]
    assert same[1] == 1.0 and other[1] < same[1]


def test_items_of_few_literals_are_found():
    items = ["Divide 12 km by 3 h", "Convert 12 km to m", "What is 15 % of 80 ?", "7 8 9 10 11 12", "12 km", "Add 1 2 3 4 5 6 7 8 9 to the sum of Anna Miller and 4 5 6 7 8 9"]
    index = decontaminate.Index(list(enumerate(items)), 5, 3)
    found = lambda text: {x[0]: x[3] for x in index.search(text, 0.8)}
    for k, x in enumerate(items):
        assert found(f"So then : {x} and so on")[k] is False
        assert found(f"So then {x} and so on")[k] is False
    assert found("What is 20 % of the budget for the year") == {}
    assert found("What is 25 % of 90 ?") == {2: True}
    assert found("Convert 15 miles to ft or divide 4 km by 2 h") == {}
    assert found(items[5].translate(str.maketrans("123456789", "234567891"))) == {5: True}
    assert found("So put " + items[5][4:]) == {5: False}
    assert found("9 2 3 4 5 6 7 8 1 to the sum of Anna Miller") == {}


def test_each_occurrence_has_its_own_slots():
    item = "Tom has 3 apples , 5 pears and 7 plums in his bag today"
    other = item.replace("3", "8").replace("5", "2").replace("7", "9")
    index = decontaminate.Index([(1, item)], 5, 3)
    assert index.search(f"{item} {other}", 0.8) == [(1, 1.0, 10, False)]
    assert index.search(f"{other} . {item} and so on . {other.replace('9', '4')}", 0.8) == [(1, 1.0, 10, False)]
    apart = lambda x: x.replace(" and ", " and then quite a few more , ")
    long = "We saw how " + item + " while all of them went home again by the old road to town"
    index = decontaminate.Index([(1, long)], 5, 3)
    both = f"{apart(long.replace('3', '8').replace('5', '2').replace('7', '9'))} . {apart(long)}"
    assert [x[0] for x in index.search(both, 0.8)] == [1]


def test_a_shuffle_join_finds_the_same(spark):
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    parts = sorted(map(tuple, decontaminate.leaks(docs, bench, block=3000).collect()))
    assert whole == parts and whole
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert {(d, i) for d, t in texts for i, x in items if x in t} <= {(r[0], r[1]) for r in whole}
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, bench, block=3000).collect()}
    assert kept == {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {d for d, _ in texts} - {r[0] for r in whole}
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.leaks(empty(spark), bench).count() == 0 == decontaminate.leaks(empty(spark), bench, block=10).count()


def template(text):
    """Tokens (placeholder or word, value) by plain rules, one word at a time."""
    out, first = [], True
    for w in text.split():
        core = re.sub(r"^[^\w%$€£+-]+|[^\w%]+$", "", w)
        low = core.lower()
        if low in decontaminate.UNITS:
            kind = "unit"
        elif decontaminate.DIGITS.fullmatch(core) or low in decontaminate.NUMBER_WORDS:
            kind = "number"
        else:
            kind = "name" if not first and len(core) > 1 and core[0].isupper() and core[1:].islower() else None
        out.append((kind, low))
        first = bool(re.search(r"[.!?:][\"')\]]*$", w))
    return out


def leaks_by_hand(doc, item, window=5, literals=3, threshold=0.8):
    """Whether some place of the document agrees with the item, window by window, under one mapping of slots."""
    d, t = template(doc), template(item)
    size = min(window, len(t))
    n = len(t) - size + 1
    few = sum(k is None for k, _ in t) < min(literals, size)
    for at in range(-len(t) + 1, len(d)):
        same = lambda i: 0 <= at + i < len(d) and (d[at + i] == t[i] if few or t[i][0] is None else d[at + i][0] == t[i][0])  # noqa: B023, E731
        matched = [p for p in range(n) if all(same(p + i) for i in range(size))]
        if len(matched) < threshold * n:
            continue
        pairs = {p: {(t[p + i], d[at + p + i]) for i in range(size) if t[p + i][0]} for p in matched}
        votes = Counter(x for s in pairs.values() for x in s)
        one, other = {}, {}
        for (a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            if a not in one and b not in other:
                one[a], other[b] = b, a
        if sum(all(one.get(a) == b for a, b in s) for s in pairs.values()) >= threshold * n:
            return True
    return False


def test_windows_and_slots_agree_with_brute_force(spark):
    rng = random.Random(4)
    frames = ["{a} bought {x} {u} of old red apples and {y} {u} of pears while {b} sold {x} boxes to {a} and left", "How many {u} does {a} walk if the road is {x} {u} long and {b} walks {y} more ?", "Add {x} to {y} and then take {z} away from the sum before {a} counts it again with {b}"]
    fill = lambda f: f.format(a=rng.choice(["Anna", "Bob", "Cleo"]), b=rng.choice(["Dora", "Emil", "Fritz"]), x=rng.randint(2, 9), y=rng.randint(10, 19), z=rng.randint(20, 29), u=rng.choice(["km", "kg", "miles"]))

    def spoil(text):
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            i = rng.randrange(len(words))
            words[i] = rng.choice(["so", str(rng.randint(2, 9)), "Gustav", "km", words[i]])
        return " ".join(words)

    items = [fill(f) for f in frames * 3]
    texts = [" ".join(["we saw this ."] * rng.randrange(3) + [spoil(fill(rng.choice(frames)))] + ["and so on ."] * rng.randrange(3)) for _ in range(150)]
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if leaks_by_hand(t, x)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (4_000_000, 10):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, list(enumerate(texts))), bench, block=block).collect()}
        assert got == want and len(texts) < len(want) < len(texts) * len(items)


def test_words_agree_with_plain_rules():
    texts = ["", "  ", "Anna's (old) \"House.\" 3,5% of $12.50!) — km/h ÄRGER İstanbul ǅ a...", "...", "+5 -x- _y_ McAdam ABC 1st 2nd. end.'", "x" * 3_000_00 + " tail Word", "\u2003wide\u00a0blank\x1f x"]
    got = decontaminate.Texts(texts)
    kinds = {0: None, int(decontaminate.fixed().number): "number", int(decontaminate.fixed().name): "name", int(decontaminate.fixed().unit): "unit"}
    for k, text in enumerate(texts):
        here = range(got.begin[k], got.end[k])
        assert [(kinds[int(got.kinds[i])], got.value(i)) for i in here] == template(text)
    many = " ".join(f"Word{i % 97}. so" for i in range(200_000))  # more than one piece
    t = decontaminate.Texts([many, "Word5"])
    assert t.end.tolist() == [400_000, 400_001] and len(set(t.hash.tolist())) == 98 and t.hash[10] == t.hash[-1]


def test_ids_of_any_type(spark):
    docs = documents(spark, [(1, f"so {ITEM} ."), (2, "nothing")])
    for kind in ("double", "string", "decimal(5,1)", "date", "array<int>"):
        value = {"date": "date '2020-01-01'", "array<int>": "array(1, 2)"}.get(kind, f"cast(7 as {kind})")
        bench = spark.sql(f"select {value} as item_id, '{ITEM}' as text")
        for block in (4_000_000, 10):
            (row,) = decontaminate.leaks(docs, bench, block=block).collect()
            assert row.doc_id == 1 and row.item_id == bench.first().item_id


def test_pipeline(spark, sf):
    """Each stage on its own input; all but the last give the columns of documents; and run() gives their result."""
    docs = common.table(spark, sf, "documents")
    rows, n = docs, docs.count()
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = common.materialize(stage(spark, rows, sf))
        seen[name] = rows.count()
        if k < 4:
            assert rows.columns == docs.columns
    assert n >= seen["toxicity"] > seen["near_dedup"] > seen["decontamination"] > 0.5 * n
    assert {r.shard for r in rows.select("shard").distinct().collect()} == set(range(8))
    assert seen["sharding"] == seen["mixing"]
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.shard) for r in whole.collect()) == sorted((r.doc_id, r.shard) for r in rows.collect())


def test_pipeline_of_awkward_and_empty_rows(spark, sf):
    """Row 6 is a copy of row 1, and there twice; 2, 3 and 4 say nothing alike; nothing is toxic or leaked; the source of two is null."""
    docs = awkward(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, sf))
        ids = sorted((r.doc_id for r in docs.collect()), key=str)
        if name == "toxicity":
            assert ids == sorted([1, 2, 3, 4, 5, 6, 6, None, 7], key=str)
        elif k < 3:
            assert ids == sorted([1, 2, 5, None, 7], key=str)
        else:
            assert set(ids) <= {1, 2, 5, None, 7} and 5 in ids and max(ids.count(i) for i in ids) <= 2
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf))
        assert docs.count() == 0


def test_scratch_is_deleted_and_what_is_kept_stays(spark):
    with common.scratch(spark):
        gone = common.materialize(spark.range(3).toDF("x"))
        kept = common.materialize(gone, keep=True)
        assert gone.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(*gone.inputFiles()).count()
