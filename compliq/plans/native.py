"""Rules compiled to columns over a document's array of blocks.

A verdict is a function of its row, so the rules of a specification are one projection: no shuffle, no Python. What needs Python for the same
result (patterns of users, under a time limit, and difflib's explanations) is left to plans.detail; ``compile_rule`` returns None there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from compliq.functions import lexicon
from compliq.functions.text import U, collapsed, counted_col, flat, folded, heading_key, heading_key_col, java, literal_pattern, word_count
from compliq.plans.detail import _STRAIGHT, bounds_text, quoted, untested
from compliq.plans.spec import Requirement, config

VERDICT = "struct<status:string,expected:string,actual:string,n:bigint,confidence:double>"


class Facts:
    """What rules need, as columns of their own: computed once a row, in steps, and then only referred to.

    Without it an expression would be evaluated wherever it occurs. Catalyst keeps the steps apart, since it does not inline
    what is costly and used more than once.
    """

    def __init__(self) -> None:
        self.steps: list[dict[str, Column]] = [{}, {}, {}, {}]
        self._known: dict[tuple, str] = {}

    def add(self, step: int, col: Column, key: str | None = None) -> Column:
        """``key``: facts of the same step and key are one."""
        name = self._known.get((step, key)) if key else None
        if name is None:
            name = f"_fact{step}_{len(self.steps[step])}"
            self.steps[step][name] = col
            if key:
                self._known[step, key] = name
        return F.col(name)

    def units(self, blocks: Column, scope: dict | None = None) -> Column:
        return self.add(0, units(blocks, scope), repr(scope))

    def lines(self, blocks: Column, scope: dict | None = None) -> Column:
        """The texts of the units, each on one line."""
        return self.add(0, F.transform(units(blocks, scope), lambda u: flat(u["text"])), "lines " + repr(scope))


def has_text(b: Column) -> Column:
    return b["text"].rlike(U + r"\S")


def units(blocks: Column, scope: dict | None = None) -> Column:
    out = F.filter(blocks, lambda b: has_text(b) & (b["kind"] != "table"))
    if scope is None:
        return out
    dropped = [k for k, drop in (("heading", not scope["headings"]), ("table_cell", not scope["tables"]), ("code", scope["no_code"])) if drop]
    if dropped:
        out = F.filter(out, lambda b: ~b["kind"].isin(dropped))
    if scope["without"]:
        keys = sorted({heading_key(n) for n in scope["without"]})
        spans = F.filter(blocks, lambda b: (b["kind"] == "heading") & b["key"].isin(keys))
        out = F.filter(out, lambda u: ~F.exists(spans, lambda s: (s["position"] <= u["position"]) & (u["position"] < s["until"])))
    return out


def total(units_: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(units_, F.lit(0).cast("bigint"), lambda a, u: a + of(u).cast("bigint"))


def found(lines: Column, pattern: str) -> Column:
    """All matches in the lines, in order, as an array of texts."""
    return F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))))


def times(lines: Column, pattern: str) -> Column:
    return total(lines, lambda x: F.regexp_count(x, F.lit(pattern)))


def norm_literal(text: Column, case: bool) -> Column:
    one = F.regexp_replace(text, U + r"\s+", " ")
    return one if case else folded(one)


def value_counts(keys: Column, values: list[str], case: bool) -> list[Column]:
    """How often each value is among the normal forms ``keys``; of values that are equal when folded, the last counts."""
    norm = lambda v: re.sub(r"\s+", " ", v) if case else re.sub(r"\s+", " ", v).casefold()
    last = {norm(v): v for v in values}
    times = lambda key: F.size(F.filter(keys, lambda k: k == key)).cast("bigint")
    return [times(norm(v)) if last[norm(v)] == v else F.lit(0).cast("bigint") for v in values]


def bounded(n: Column, bounds: tuple) -> Column:
    low, high = bounds
    tests = [n >= low] if low is not None else []
    tests += [n <= high] if high is not None else []
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def gap(n: Column, bounds: tuple) -> Column:
    """``short by 3`` or ``over by 3``; null inside the bounds."""
    low, high = bounds
    out = F.lit(None).cast("string")
    if high is not None:
        out = F.when(n > high, F.concat(F.lit("over by "), F.format_number(n - high, 0))).otherwise(out)
    if low is not None:
        out = F.when(n < low, F.concat(F.lit("short by "), F.format_number(low - n, 0))).otherwise(out)
    return out


def verdict(ok: Column, expected, actual: Column, n: Column, confidence: Column | float = 1.0, failed: str = "FAIL") -> Column:
    status = F.when(ok, "PASS").otherwise(failed)
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(status.alias("status"), as_col(expected).alias("expected"), actual.alias("actual"), n.cast("bigint").alias("n"), as_col(confidence).cast("double").alias("confidence")).cast(VERDICT)


def _count_verdict(n: Column, bounds: tuple, noun: str, label: str = "", one: Column | None = None, confidence: float = 1.0) -> Column:
    said = one if one is not None else F.concat(F.format_number(n, 0), F.lit(f" {noun}"))
    off = gap(n, bounds)
    actual = F.when(off.isNull(), said).otherwise(F.concat(said, F.lit(" ("), off, F.lit(")")))
    return verdict(bounded(n, bounds), label + bounds_text(bounds, noun), actual, n, confidence)


def _words(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    n = facts.add(1, total(facts.units(b, c["scope"]), lambda u: word_count(u["text"], c["method"])))
    return _count_verdict(n, c["bounds"], "words")


def _forbidden(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    n = facts.add(1, times(facts.lines(b, c["scope"]), java(literal_pattern(c["values"], c["whole"]), c["case"])))
    return verdict(n == 0, f"None of: {quoted(c['values'])}", counted_col(n, "occurrence"), n)


def _required(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    lines = facts.lines(b, c["scope"])
    if c["within"] != "document":
        body = facts.add(0, F.filter(b, lambda x: (x["kind"] == "paragraph") & ~x["candidate"] & has_text(x)), "body")
        target = F.try_element_at(body, F.lit(1 if c["within"] == "first_paragraph" else -1))["position"]
        lines = F.transform(F.filter(facts.units(b, c["scope"]), lambda u: (u["position"] == target) & (u["kind"] == "paragraph")), lambda u: flat(u["text"]))
    hits = facts.add(1, found(lines, java(literal_pattern(c["values"], c["whole"]), c["case"])))
    keys = facts.add(2, F.transform(hits, lambda m: norm_literal(m, c["case"])))
    counts = [facts.add(3, n) for n in value_counts(keys, c["values"], c["case"])]
    list_of = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(n), F.lit(f'"{v}"')) for v, n in zip(c["values"], counts, strict=True)])), ", ")
    hit = sum([F.when(n > 0, 1).otherwise(0) for n in counts], F.lit(0))
    every = c["require"] == "all"
    ok = hit == len(counts) if every else hit > 0
    actual = F.when(ok, F.concat(F.lit("Found: "), list_of(lambda n: n > 0))).otherwise(F.concat(F.lit("Missing: "), list_of(lambda n: n == 0)))
    out = verdict(ok, f"{'All' if every else 'At least one'} of: {quoted(c['values'])}", actual, hit)
    if c["within"] == "document":
        return out
    none = verdict(F.lit(True), f"Text in the {c['within'].replace('_', ' ')}", F.lit(None).cast("string"), F.lit(0))
    return F.when(F.size(body) == 0, none.withField("status", F.lit("UNVERIFIED"))).otherwise(out)


def _punctuation(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    n = facts.add(1, times(facts.lines(b, c["scope"]), literal_pattern(c["values"], False)))
    return verdict(n <= c["most"], f"{quoted(c['values'])}: {'at most ' + str(c['most']) if c['most'] else 'none'} allowed", counted_col(n, "occurrence"), n)


def _occurrences(b: Column, c: dict, doc: dict, facts: Facts) -> Column | None:
    if c["text"] is None:
        return None
    n = facts.add(1, times(facts.lines(b, c["scope"]), java(literal_pattern([c["text"]], c["whole"]), c["case"])))
    return _count_verdict(n, c["bounds"], "occurrences", f'"{c["text"]}": ', counted_col(n, "occurrence"))


def element_counts(b: Column, element: str, level: int | None = None, names: list[str] | None = None) -> Column:
    if element == "references":
        keys = sorted({heading_key(n) for n in names or lexicon.REFERENCE_HEADINGS})
        head = F.try_element_at(F.filter(b, lambda x: (x["kind"] == "heading") & x["key"].isin(keys)), F.lit(1))
        inside = F.filter(b, lambda x: (x["position"] > head["position"]) & (x["position"] < head["until"]) & ~x["kind"].isin("heading", "code", "table", "table_cell") & has_text(x))
        return F.when(head.isNull(), 0).otherwise(F.size(inside)).cast("bigint")
    tests = {
        "bullets": lambda x: x["marker"] == "bullet", "numbered_items": lambda x: x["marker"] == "numbered", "list_items": lambda x: x["marker"].isNotNull(),
        "headings": lambda x: (x["kind"] == "heading") & ((x["level"] == level) if level is not None else F.lit(True)), "code_blocks": lambda x: x["kind"] == "code", "tables": lambda x: x["kind"] == "table",
        "paragraphs": lambda x: x["kind"].isin("paragraph", "quote") & has_text(x),
    }
    return F.size(F.filter(b, tests[element])).cast("bigint")


def _elements(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    n = facts.add(1, element_counts(b, c["element"], c["level"], c["names"]))
    return _count_verdict(n, c["bounds"], c["element"].replace("_", " "), confidence=0.8 if c["element"] == "references" else 1.0)


def _first(b: Column, fits: Callable[[Column], Column]) -> Column:
    """The first heading that fits, else the first lone line."""
    heads = F.filter(b, lambda x: (x["kind"] == "heading") & fits(x))
    return F.try_element_at(F.concat(heads, F.filter(b, lambda x: x["candidate"] & fits(x))), F.lit(1))


def _sections(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    fold = not c["case"]
    first = []
    for group in c["groups"]:
        want = [heading_key(n, fold) for n in group]

        def fits(x: Column, want=want) -> Column:
            key = x["key"] if fold else heading_key_col(x["text"], False)
            tests = [key == w if c["exact"] else F.contains(key, F.lit(w)) for w in want]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out

        first.append(facts.add(1, _first(b, fits)))
    labels = [" / ".join(g) for g in c["groups"]]
    joined = lambda xs: F.array_join(F.array_compact(F.array(*xs)), ", ")
    hit = sum([F.when(x.isNotNull(), 1).otherwise(0) for x in first], F.lit(0))
    places = F.transform(F.array(*[x["position"] for x in first]), lambda p: p)
    every = c["require"] == "all"
    ok = hit == len(first) if every else hit > 0
    ranked = F.array_sort(F.array(*[F.struct(x["position"].alias("p"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (x, k) in enumerate(zip(first, labels, strict=True))]))
    wrong_order = (places != F.array_sort(places)) if c["ordered"] else F.lit(False)
    actual = (
        F.when(~ok, F.concat(F.lit("Missing: "), joined([F.when(x.isNull(), F.lit(k)) for x, k in zip(first, labels, strict=True)])))
        .when(wrong_order, F.concat(F.lit("Order found: "), F.array_join(F.transform(ranked, lambda r: r["k"]), ", ")))
        .otherwise(F.concat(F.lit("Found: "), joined([x["text"] for x in first])))
    )
    inferred = F.lit(False)
    for x in first:
        inferred = inferred | F.coalesce(x["candidate"], F.lit(False))
    expected = f"{'All' if every else 'Any'} of these headings: {', '.join(labels)}" + " (in this order)" * c["ordered"]
    return verdict(ok & ~wrong_order, expected, actual, hit, F.when(ok & ~wrong_order & inferred, 0.8).otherwise(1.0))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once a row, also where ``of`` uses it inside a lambda: a column that is used there alone would be inlined, and computed for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


#: Items up to which each is looked for by itself; of more, those of at least ``PARTS`` parts are looked for only where their middle occurs.
FEW_ITEMS, PARTS = 8, 5
#: What Java's Unicode-aware \s matches.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def preserved(b: Column, c: dict, facts: Facts) -> Column:
    """How many of the items appear unchanged, in a unit or across units. What is in a unit is in the whole text too, which holds every unit as it is.

    Where an item occurs, its parts between its first and last space are whole parts of the text between spaces. So many items are told by three parts from
    their middle: hashes of all runs of three parts of the text are looked up in one set, and only items whose middle was met are compared with the text.
    """

    def norm(text: Column) -> Column:
        if c["quotes"]:
            text = F.translate(text, "".join(map(chr, _STRAIGHT)), "".join(_STRAIGHT[k] if isinstance(_STRAIGHT[k], str) else chr(_STRAIGHT[k]) for k in _STRAIGHT))
        text = collapsed(text) if c["spaces"] else text
        return text if c["case"] else folded(text)

    def given(item: str) -> str:
        """As ``norm`` but for case, so that a plan of many items stays small."""
        item = item.translate(_STRAIGHT) if c["quotes"] else item
        return _SPACES.sub(" ", item).strip(" ") if c["spaces"] else item

    def cased(item: str) -> Column:
        return F.lit(item) if c["case"] else folded(F.lit(item))

    def middle(item: str) -> Column:
        parts = item.split(" ")
        at, h = (len(parts) - 3) // 2, 42
        if not c["case"]:
            return F.xxhash64(*[cased(x) for x in parts[at : at + 3]])
        for x in parts[at : at + 3]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        return F.lit(h - (h >> 63 << 64))

    items = [given(x) for x in c["items"]]
    long = [x for x in items if x.count(" ") >= PARTS - 1]
    if len(long) <= FEW_ITEMS:
        long = []
    short = [x for x in items if not long or x.count(" ") < PARTS - 1]
    middles = [middle(x) for x in long]

    def kept(text: Column) -> Column:
        out = F.size(F.filter(F.array(*map(cased, short)), lambda n: F.contains(text, n))) if short else F.lit(0)
        if not long:
            return out
        hashes = lambda parts: F.transform(parts, lambda _, i: F.xxhash64(*[F.get(parts, i + k) for k in range(3)]))
        runs = let(F.split(text, " ", -1), lambda parts: F.filter(hashes(parts), lambda h: h.isin(middles)))
        met = lambda hits: F.size(F.filter(F.array(*map(cased, long)), lambda n, i: F.array_contains(hits, F.get(F.array(*middles), i)) & F.contains(text, n)))
        return out + let(F.array_distinct(runs), lambda hits: F.when(F.size(hits) == 0, 0).otherwise(met(hits)))

    how, plain = repr({k: c[k] for k in ("case", "spaces", "quotes")}), facts.units(b)
    return let(facts.add(1, norm(F.array_join(F.transform(plain, lambda u: u["text"]), "\n\n")), f"whole {how}"), kept)


def _preserve(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    kept = facts.add(2, preserved(b, c, facts))
    n = len(c["items"])
    ok = kept == n
    expected = F.lit(c["items"][0] if n == 1 else f"{n} protected items")
    return verdict(ok, expected, F.when(ok, "Found exactly as given").otherwise(F.concat(F.lit("changed or missing: "), (F.lit(n) - kept).cast("string"))), F.lit(n) - kept)


def _spelling(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    """Words are runs of letters, looked up among the other variant's spellings; quoted spans are blanked first."""
    allowed = sorted({a.casefold() for a in c["allow"]})
    words = F.flatten(F.transform(facts.lines(b, c["scope"]), lambda x: F.regexp_extract_all(F.lower(F.regexp_replace(x, '"[^"\n]+"|“[^”\n]+”', '"')), F.lit("[a-z]+"), F.lit(0))))
    hits = F.filter(words, lambda w: w.isin(lexicon.other_words(c["variant"])))
    hits = F.filter(hits, lambda h: ~F.lower(h).isin(allowed)) if allowed else hits
    n = facts.add(1, F.size(hits).cast("bigint"))
    other, name = ("American", "British") if c["variant"] == "british" else ("British", "American")
    actual = F.when(n == 0, f"0 {other} spellings found").otherwise(counted_col(n, f"{other} spelling"))
    return verdict(n == 0, f"{name} spelling throughout", actual, n, F.when(n == 0, 0.75).otherwise(1.0))


def extension(path: Column, file_type: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(ext == "markdown", "md").when(ext == "text", "txt").when(ext == "", file_type).otherwise(ext)


def _file_type(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    have = extension(doc["path"], doc["file_type"])
    want = " or ".join(f".{a}" for a in c["shown"])
    return verdict(have.isin(c["allowed"]) | doc["file_type"].isin(c["allowed"]), f"Type: {want}", F.concat(F.lit("."), have), F.lit(0))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda s: s[name]


def _off(want: float, tolerance: float) -> Callable[[Column], Column]:
    return lambda have: F.abs(have - want) > tolerance


def _docx(b: Column, c: dict, doc: dict, facts: Facts) -> Column:
    sides = ("top", "bottom", "left", "right")
    meta = F.from_json(doc["meta"], "sections array<struct<" + ",".join(f"margin_{s}_cm:double" for s in sides) + ",orientation:string>>, default_font_name string, default_font_size_pt double, default_line_spacing double")
    sections = F.coalesce(meta["sections"], F.array().cast("array<struct<margin_top_cm:double,margin_bottom_cm:double,margin_left_cm:double,margin_right_cm:double,orientation:string>>"))
    wrong, unknown = [], []
    for side, want in c["margins"].items():
        margins = F.transform(sections, _field(f"margin_{side}_cm"))
        wrong.append(F.size(F.filter(margins, _off(want, c["tolerance"]))))
        unknown.append(F.size(F.filter(margins, lambda m: m.isNull())))
    if c["orientation"]:
        wrong.append(F.size(F.filter(sections, lambda s: ~s["orientation"].eqNullSafe(F.lit(c["orientation"])))))
    for have, want, differs in (
        (meta["default_font_name"], c["font"], lambda h, w: F.lower(h) != w.lower()), (meta["default_font_size_pt"], c["size"], lambda h, w: F.abs(h - w) > 0.01),
        (meta["default_line_spacing"], c["spacing"], lambda h, w: F.abs(h - w) > c["spacing_tolerance"]),
    ):
        if want:
            wrong.append(F.when(have.isNotNull() & differs(have, want), 1).otherwise(0))
            unknown.append(F.when(have.isNull(), 1).otherwise(0))
    bad, open_ = sum(wrong, F.lit(0)), sum(unknown, F.lit(0))
    status = F.when((doc["file_type"] != "docx") | ((bad == 0) & (open_ > 0)), "UNVERIFIED").when(bad > 0, "FAIL").otherwise("PASS")
    applies = doc["file_type"] == "docx"
    return verdict(F.lit(True), F.when(applies & (bad > 0), "See evidence"), F.lit(None).cast("string"), bad, F.when(applies & (bad == 0) & (open_ > 0), 0.5).otherwise(1.0)).withField("status", status)


_COMPILERS = {
    "word_count": _words, "forbidden_text": _forbidden, "required_text": _required, "forbidden_punctuation": _punctuation, "occurrences": _occurrences, "element_count": _elements,
    "required_section": _sections, "preserve_text": _preserve, "spelling_variant": _spelling, "file_type": _file_type, "docx_format": _docx,
}


def compile_rule(r: Requirement, doc: dict[str, Column], facts: Facts, base_dir: str | None = None) -> Column | None:
    """A VERDICT column over doc['blocks'], doc['path'], doc['file_type'], doc['meta'] and the facts, or None where Python is needed."""
    if r.verification_type != "deterministic":
        return F.struct(F.lit("UNVERIFIED").alias("status"), F.lit(None).alias("expected"), F.lit(untested(r)).alias("actual"), F.lit(0).alias("n"), F.lit(0.0).alias("confidence")).cast(VERDICT)
    if r.checker not in _COMPILERS:
        return None
    out = _COMPILERS[r.checker](doc["blocks"], config(r.checker, r.parameters, base_dir), doc, facts)
    if out is not None and r.severity == "info":
        out = out.withField("status", F.when(out["status"] == "FAIL", "WARNING").otherwise(out["status"]))
    return out
