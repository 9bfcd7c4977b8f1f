import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compliq.llm import common, exact_dedup, mixing, sharding, url_filter
from tests.llm.helpers import WORDS, awkward, documents, empty


def test_fuse_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = exact_dedup.FuseFilter.build(keys)
        assert f.contains(keys).all()
        other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
        assert f.contains(other).mean() < 0.02


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak,arrivals,filter_bytes", [("", 2, 1 << 20), ("digest", 2, 1 << 20), ("both", 2, 1 << 20), ("", 5, 0), ("both", 3, 0), ("", 1, 0)])
def test_exact_dedup_matches_brute_force(spark, weak, arrivals, filter_bytes):
    """With a weak digest and tag different texts share them: the texts decide."""
    docs = awkward(spark).union(documents(spark, [(100 + k, f"text {k % 7}") for k in range(60)]))
    digest = (lambda t: F.substring(exact_dedup.sha256(t), 1, 1)) if weak else exact_dedup.sha256
    tag = (lambda t: F.xxhash64(t) % 2) if weak == "both" else F.xxhash64
    turn = F.coalesce(F.col("doc_id") % arrivals, F.lit(0))
    out = exact_dedup.exact_dedup([docs.where(turn == k) for k in range(arrivals)], digest=digest, tag=tag, filter_bytes=filter_bytes)
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()], key=str)
    assert got == brute_dedup([(r.doc_id, r.text) for r in docs.collect()])


def test_snapshots_are_merged_in_tiers_and_screens_deal_a_large_batch(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 50)
    made = []
    real = exact_dedup.Snapshot.screen
    monkeypatch.setattr(exact_dedup.Snapshot, "screen", lambda self, g, n, b: made.append((self.tier, self.shards)) or real(self, g, n, b))
    docs = documents(spark, [(k, f"text {k % 700}") for k in range(1200)])
    parts = [docs.where(F.col("doc_id") % 4 == k) for k in range(4)]
    out = exact_dedup.exact_dedup(parts, filter_bytes=0)
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()], key=str)
    assert got == brute_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert [t for t, _ in made] == [0, 1, 1, 0] and all(s > 1 for _, s in made)


def test_exact_dedup_of_a_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    out = exact_dedup.op8_exact_dedup(spark, sf).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out], key=str) == brute_dedup(rows)
    text = dict(rows)
    assert all(r.text_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() for r in out)


def test_empty_tables(spark):
    e = empty(spark)
    assert exact_dedup.exact_dedup([e, e]).count() == 0
    assert mixing.mix(e).count() == 0
    assert sharding.kd_shards(e).count() == 0


def water(sizes, weights=(3.0, 1.0, 2.0)):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    total, out, left = 1.5 * sum(sizes.values()), {}, set(names)
    while left:
        level = (total - sum(out.values())) / sum(w[k] for k in left)
        full = {k for k in left if level * w[k] > 2 * sizes[k]}
        if not full:
            return out | {k: level * w[k] for k in left}
        out |= {k: 2.0 * sizes[k] for k in full}
        left -= full
    return out


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_mixing_targets_and_bounds(spark, sf, which):
    docs = common.table(spark, sf, "documents") if which == "table" else awkward(spark)
    rows = mixing.mix(docs).collect()
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(len(WORDS.findall(r.text or "")))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] in text[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = water(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mixing_prefers_quality(spark):
    docs = documents(spark, [(i, ("good words here " * 5) if i % 2 else ("BAD $$$ 123 " * 5), "en", "a" if i < 600 else "b") for i in range(800)])
    rows = [r for r in mixing.mix(docs, share=0.6).collect() if r.taken < r["size"] * 2 and r.source == "a"]
    good = sum(r.taken for r in rows if r.doc_id % 2)
    assert good > 1.1 * sum(r.taken for r in rows if not r.doc_id % 2)


def test_quality_weight_is_fair_to_scripts(spark):
    texts = ["plain words and more of them", "كلمات عادية وأكثر منها", "普通的文字和更多的文字", "обычные слова и ещё", "ORDINARY WORDS", "$$$ 123 %%% 456"]
    w = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.quality_weight(F.col("t")).alias("w")).collect()]
    assert all(math.isclose(x, 1.5) for x in w[:5]) and w[5] < 0.8


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"s{i:05d}": int(rng.paretovariate(0.7) * 10) for i in range(3000)} | {"zero": 0, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def check_shards(rows, shards, tolerance):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(size) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - min(size.values()) <= tolerance


@pytest.mark.parametrize("shards", [8, 5])
def test_sharding_balances_bytes(spark, sf, shards):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.kd_shards(docs, shards).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(text)
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    check_shards(rows, shards, max(r["size"] for r in rows))
    together = defaultdict(set)
    for r in rows:
        together[text[r.doc_id]].add(r.shard)
    total = sum(r["size"] for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[text[r.doc_id]] += r["size"]
    assert all(len(v) == 1 for t, v in together.items() if sizes[t] <= 0.002 * total)


def test_shards_of_like_documents_are_equal_within_a_hundredth(spark):
    rng = random.Random(8)
    docs = documents(spark, [(i, " ".join(rng.choice(["aa", "bbb", "c\nc", "ü"]) for _ in range(rng.randint(5, 60))) + f" {i}", rng.choice(["en", "fr", None]), "a") for i in range(4000)])
    for shards, target in ((8, None), (7, None), (None, 40_000)):
        rows = sharding.kd_shards(docs, shards, target_bytes=target).collect()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.shard] += r["size"]
        total = sum(sizes.values())
        n = shards or -(-total // target)
        assert sorted(sizes) == list(range(n)) and max(sizes.values()) <= 1.01 * total / n + 200 and min(sizes.values()) >= 0.99 * total / n - 200
        if target:
            assert max(sizes.values()) <= 1.01 * target


def test_equal_texts_stay_together_whatever_their_language(spark):
    docs = documents(spark, [(2 * i + k, f"text number {i} " + "x" * (i % 90), lang, "a") for i in range(2000) for k, lang in enumerate(("en", "fr"))])
    rows = {r.doc_id: r for r in sharding.kd_shards(docs, 8).collect()}
    assert all(rows[2 * i].shard == rows[2 * i + 1].shard for i in range(2000))
    placed = {r.doc_id: r.shard for r in sharding.sharded(docs, 8).collect()}
    assert placed == {k: r.shard for k, r in rows.items()}


def test_sharding_uses_no_python_and_no_product(spark, sf, capsys):
    docs = common.table(spark, sf, "documents")
    for df in (sharding.kd_shards(docs, 8), sharding.sharded(docs, 8)):
        df.explain("formatted")
        plan = capsys.readouterr().out
        assert "Python" not in plan and "Pandas" not in plan and "ExistingRDD" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_sharding_spreads_a_hot_group_and_keeps_small_ones(spark):
    rng = random.Random(3)
    rows = [(i, "the same text again" if i % 3 == 0 else " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.randint(1, 30))) + f" {i // 6}") for i in range(3000)]
    docs = documents(spark, rows)
    out = sharding.kd_shards(docs, 8).collect()
    check_shards(out, 8, 400)
    groups, text = defaultdict(set), dict(rows)
    for r in out:
        groups[text[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for k, v in groups.items() if k != "the same text again")


def test_sharding_of_awkward_rows(spark):
    rows = sharding.kd_shards(awkward(spark)).collect()
    assert len(rows) == 9
    check_shards(rows, 8, 200_000)


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def brute_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_rules_match_brute_force(spark, sf):
    odd = [None, "", "no scheme", "http://", "HTTP://ÀB.Example.ORG?x/y", "http://a.org", "http://a.org/", "x://example.org/en/12#/z", "http://notexample.org/es/", "http://sub.EXAMPLE.org/es/q", "a://b://c/d", "http://h\n.com/fr/\n", "http://x.com/" + "a/" * 500]
    pages = common.table(spark, sf, "pages").select("page_id", "url").union(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    rows = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    assert rows.keys() == urls.keys()
    for k, u in urls.items():
        host, path = brute_url(u)
        rule = brute_rule(host, path)
        r = rows[k]
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)


def test_url_tree_rejects_blocked_templates_and_merges_like_ones(spark):
    rules = (url_filter.Rule("block", "h.com", "/spam/0"), url_filter.Rule("allow", "h.com", "/news/0"))
    urls = [f"http://h.com/{k}/{i:03d}x{i * i}" for k in ("spam", "news") for i in range(200)] + ["http://h.com/other/1", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = {urls[r.page_id]: r for r in url_filter.url_verdicts(pages, rules).collect()}
    assert all(r.verdict == "block" for u, r in rows.items() if u and "/spam/" in u)
    assert all(r.verdict == "allow" for u, r in rows.items() if u and "/news/" in u)
    assert len({r.template for u, r in rows.items() if u and "/spam/" in u and r.rule is None}) < 50
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_verdicts(none).count() == 0


def test_branches_merge_with_each_other_where_labels_agree(spark):
    """a and b are blocked alike, c and d allowed alike, e half and half, f and g unlabelled: compared with each other, not with the pool of all."""
    rows = [("h", "", s, 50, n, k) for s, n, k in (("a", 40, 39), ("b", 40, 40), ("c", 40, 1), ("d", 30, 0), ("e", 40, 20), ("f", 0, 0), ("g", 0, 0))] + [("i", "", "only", 5, 5, 5)]
    children = spark.createDataFrame(rows, "host string, node string, segment string, n long, labelled long, bad long")
    token = {(r.host, r.segment): r.token for r in url_filter.branches(children, 20, 0.5, 1.96).collect()}
    h = {s: t for (host, s), t in token.items() if host == "h"}
    assert h["a"] == h["b"] and h["c"] == h["d"] and h["f"] == h["g"] == "<new>" and len({h["a"], h["c"], h["e"], h["f"]}) == 4 and h["e"] == "e" and token["i", "only"] == "only"
    many = spark.createDataFrame([("h", "", f"s{i}", 1, 0, 0) for i in range(30)], children.schema)
    assert {r.token for r in url_filter.branches(many, 20, 0.5, 1.96).collect()} == {"<any>"}


def brute_branch_purity(urls, rules, threshold=0.5, strength=5.0):
    """Verdicts of one host's pages under its first segment alone, by counting."""
    labels = {u: (brute_rule_of(rules, *brute_url(u)) or None) for u in urls}
    known = [r.verdict == "block" for r in labels.values() if r]
    p = (sum(known) + 1) / (len(known) + 2)
    host = (sum(known) + strength * p) / (len(known) + strength)
    out = {}
    for u in urls:
        mine = [labels[v].verdict == "block" for v in urls if labels[v] and brute_url(v)[1].split("/")[1] == brute_url(u)[1].split("/")[1]]
        out[u] = labels[u].verdict if labels[u] else "block" if (sum(mine) + strength * host) / (len(mine) + strength) > threshold else "allow"
    return out


def brute_rule_of(rules, host, path):
    return max((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.name), default=None)


def test_verdicts_of_one_level_match_brute_force(spark):
    rng = random.Random(6)
    rules = (url_filter.Rule("block", "h.com", "/a"), url_filter.Rule("block", "h.com", "/bad-1"), url_filter.Rule("allow", "h.com", "/good-1"), url_filter.Rule("allow", "h.com", "/ab"))
    urls = [f"http://h.com/{rng.choice(['aa', 'ab', 'bad-1', 'bad-2', 'good-1', 'new', 'ac'])}" for _ in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = brute_branch_purity(urls, rules)
    assert all(r.verdict == want[urls[r.page_id]] for r in url_filter.url_verdicts(pages, rules, depth=1).collect())


def test_url_filters_use_no_python_and_no_window_over_pages(spark, sf, capsys):
    url_filter.url_verdicts(common.table(spark, sf, "pages")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Window" not in plan and "NestedLoop" not in plan


def test_materialized_tables_can_be_released(spark):
    df = common.materialize(spark.range(5).toDF("x"))
    assert df.count() == 5
    common.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(*df.inputFiles()).count()
