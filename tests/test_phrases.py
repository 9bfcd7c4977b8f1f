import pytest

from compliq.functions import grammar
from compliq.functions.phrases import Said, tokens

LISTS = {"FRUIT": ["apple(s)", "passion fruit(s)"]}


def find(text, *patterns):
    f = Said(text).find(*patterns, lists=LISTS)
    return f and (f.begin, f.end, {k: v for k, v in f.names.items() if not k.endswith("_at")})


def test_tokens():
    kinds = [(t.kind, t.low) for t in tokens("Don’t use 1,500 \"Red, blue\" U.K. co-op, e.g. it's 'so'!")]
    assert kinds == [
        ("word", "don't"), ("word", "use"), ("number", "1,500"), ("quote", "Red, blue"), ("word", "u.k."), ("word", "co"), ("mark", "-"), ("word", "op"), ("mark", ","), ("word", "e.g."), ("word", "it's"), ("quote", "so"), ("mark", "!"),
    ]


@pytest.mark.parametrize("text,patterns,want", [
    ("eat two Apples now", ["#n {FRUIT}=what"], (1, 3, {"n": 2, "what": "Apples"})),
    ("eat 1,200 passion-fruits", ["#!n {FRUIT}=what"], (1, 5, {"n": 1200, "what": "passion-fruits"})),
    ("eat two apples", ["#!n {FRUIT}"], None),
    ("give the very old dog a bone", ["give the? _1-3=who (a bone|a)"], (0, 7, {"who": "very old dog"})),
    ("give 'x', \"y\" and “z” to", ['give "=all'], (0, 6, {"all": ["x", "y", "z"]})),
    ("keep it, please", ["^ keep _1-2=x $"], (0, 4, {"x": "it, please"})),
    ("so keep it", ["^ keep"], None),
    ("exactly 5 and exactly so", ["(exactly !#) so"], (3, 5, {})),
    ("a b. c d", ["a .. d"], None),
    ("a b: c d", ["a .. d=x"], (0, 5, {"x": "d"})),
    ("the Getting There section", ["the? @1-5=name section"], (0, 4, {"name": "Getting There"})),
    ("very very very big", ["very* big"], (0, 4, {})),
    ("one of the rest is here", ["one ...=rest"], (0, 6, {"rest": "of the rest is here"})),
    ("x y", ["y", "x"], (0, 1, {})),
])
def test_patterns(text, patterns, want):
    assert find(text, *patterns) == want


def test_every_pattern_of_the_grammar_can_be_read():
    for patterns in grammar.PATTERNS.values():
        for p in patterns:
            for name in __import__("re").findall(r"\{(\w+)\}", p):
                assert grammar.LISTS[name]
            Said("a plain sentence of seven words here").find(p, lists=grammar.LISTS)
