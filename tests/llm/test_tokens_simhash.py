import random
from collections import defaultdict

import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from compliq.llm import common, components, simhash, token_count
from tests.llm.helpers import WORDS, awkward, documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    spec = open(PATH, encoding="utf-8").read()
    return token_count.Counter(spec, frozenset(token_count.prove(spec)))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["", " ", "\n\n a", "a  b\t\tc \n", "don't 'twas we'll've", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "naïve ÉÈ ß 中文字 123abc ١٢٣", "  x　 y\x1c z\x85q", "a\x00b", "🙂🙂 👩‍👩‍👧", "!!!???...", "word" * 5000, " " * 3000 + "a"]


def test_counts_match_the_library(counter, library):
    for t in ODD:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t[:40])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r'aAsS1.  \x1c")), max_size=60))
def test_counts_match_on_any_text(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_tables(spark, sf, library):
    for docs in (common.table(spark, sf, "documents"), awkward(spark)):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, PATH).collect())
        want = []
        for r in docs.collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want.append((str(r.doc_id), len((r.text or "").encode()), n, n > 1024))
        assert got == sorted(want)
    assert token_count.token_counts(empty(spark), PATH).count() == 0


def brute_fp(text, k=3):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(points, radius):
    left, out = list(points), {}
    while left:
        group, new = [], [left.pop()]
        while new:
            x = new.pop()
            group.append(x)
            near = [y for y in left if (x[1] ^ y[1]).bit_count() <= radius]
            left = [y for y in left if y not in near]
            new += near
        ids = [x[0] for x in group if x[0] is not None]
        out |= {x[0]: min(ids) if ids else None for x in group}
    return out


def test_masks_cover_all_pairs_within_the_radius():
    for radius in (1, 2, 3, 4):
        ms, rng = simhash.masks(radius), random.Random(radius)
        assert len(ms) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & diff == 0 for m in ms)


def test_fingerprints_and_components_of_a_table(spark, sf):
    for docs in (common.table(spark, sf, "documents"), awkward(spark)):
        rows = docs.collect()
        out = simhash.simhash_components(docs).collect()
        assert len(out) == len(rows)
        fps = {r.doc_id: brute_fp(r.text) for r in rows}
        assert all(simhash.signed(fps[r.doc_id]) == r.fp for r in out)
        want = brute_components(list(fps.items()), 2)
        assert {r.doc_id: r.component_id for r in out} == want
    assert simhash.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [4, 4096])
def test_links_are_whole_in_dense_buckets(spark, dense):
    """Thousands of points in one bucket: the exact way for large buckets finds the same components."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    pts = set(base)
    for _ in range(500):
        x = rng.choice(sorted(pts))
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 6])):
            x ^= 1 << b
        pts.add(x)
    want = brute_components([(simhash.signed(p), p) for p in pts], 2)
    df = spark.createDataFrame([(simhash.signed(p),) for p in pts], "fp long")
    got = {r.node: r.component for r in components.components(simhash.links(df, 2, dense)).collect()}
    groups = defaultdict(set)
    for p in pts:
        groups[want[simhash.signed(p)]].add(simhash.signed(p))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_words_are_only_a_shape(spark):
    docs = documents(spark, [(1, "A b C"), (2, "a\tB\nc "), (3, "a b"), (4, "É b c")])
    fps = {r.id: r.fp for r in simhash.fingerprints(docs).collect()}
    assert fps[1] == fps[2] != fps[3] != fps[4]
