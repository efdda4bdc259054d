"""Personal data by candidate gradient boosting, with DataFrame operations only.

Fixed patterns give the base spans.  High-recall generators propose candidates, which may
overlap each other and the base spans; features of a candidate's format and of the words
before it go through boosted trees, which the plan holds as nested CASE expressions; a
threshold for each generator, calibrated on labelled samples the trees have not seen,
selects spans.  Selected spans that touch no base span are added to those.  Everything
happens within a row, so there is no shuffle at all.

Repetitions in the patterns are possessive or bounded, and a run of name characters is
entered at its start only; places come from running sums over blocks of matches.  So time
is in proportion to the text, but for a small term of matches to the power 1.5.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no text makes them backtrack (same leftmost matches).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals: telephone numbers in any grouping, numbers of identity papers, bank accounts, written-out and dotless addresses.
GENERATORS = {
    "local_phone": r"(?<![0-9A-Za-z_.,/+-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,6}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,5}(?![0-9A-Za-z_]|[.,/-][0-9])",
    "identity": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "written_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{1,63}){1,4}",
}
#: What a text must hold for a pattern to match at all.
NEEDLES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "local_phone": r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}", "identity": r"[0-9]-[0-9]{2}-[0-9]", "account": r"[A-Z]{2}[0-9]{2}", "written_email": r"[(\[](?:at|AT)[)\]]"}
ALL_KINDS = (*KINDS, *GENERATORS)
#: Characters before a candidate in which context words are looked for.
CONTEXT = 40
#: Context words for and against (fixed values).
HINTS = r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|contact|ssn|social|passport|identity|iban|account|bank|mail|email|e-mail|reach|telefon|anruf|konto|teléfono|cuenta|téléphone|compte)\b"
AGAINST = r"(?i)\b(?:version|ver|isbn|issn|part|serial|page|pages|room|order|ratio|score|figure|table|section|line|build|release|price|total|date|between)\b"

FEATURES = ("digits", "letters", "length", "separators", "distinct_digits", "parenthesis", "dots", "hint", "against", "years", "bad_start", "checked", "groups", "longest", "shortest", "slashes", "plus", "date", "first_zero")
TREES, RATE, LEAST, RIDGE = 30, 0.3, 8, 1.0
SAMPLES = 3600
#: Share of a generator's selected samples that must be personal data.
PRECISION = 0.97


# --- features: the same in Python, for samples, and in SQL, for the corpus ----------------------


#: Three groups that may be a date, in either order (as a whole).
DATE = r"(?:(?:19|20)[0-9]{2}([./-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([./-])(?:0?[1-9]|[12][0-9]|3[01])\2(?:(?:19|20)[0-9]{2}|[0-9]{2}))"
_YEAR = r"(?:19|20)[0-9]{2}"


def python_features(span: str, before: str) -> list[float]:
    digits = re.sub(r"[^0-9]", "", span)
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    return [
        len(digits), len(re.sub(r"[^A-Za-z]", "", span)), len(span), len(re.sub(r"[A-Za-z0-9]", "", span)), len(set(digits)), float("(" in span), span.count("."),
        float(bool(re.search(HINTS, before))), float(bool(re.search(AGAINST, before))), float(any(re.fullmatch(_YEAR, g) for g in groups)),
        float(bool(re.match(r"(?:000|666|9[0-9]{2})-", span))), float(_mod97(span)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("/"), float(span.startswith("+")), float(bool(re.fullmatch(DATE, span))), float(bool(re.match(r"\(?0", span))),
    ]


def _mod97(span: str) -> bool:
    s = span.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", s):
        return False
    rest = 0
    for c in s[4:] + s[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def sql_features(span: Column, before: Column) -> Column:
    digits = F.regexp_replace(span, "[^0-9]", "")
    groups = F.filter(F.split(span, "[^0-9]+", -1), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    s = F.replace(span, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v.isNull(), a).otherwise(F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))))
    parts = [
        F.length(digits), F.length(F.regexp_replace(span, "[^A-Za-z]", "")), F.length(span), F.length(F.regexp_replace(span, "[A-Za-z0-9]", "")), F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda c: c != ""))),
        F.contains(span, F.lit("(")), F.length(F.regexp_replace(span, "[^.]", "")), before.rlike(HINTS), before.rlike(AGAINST), F.exists(groups, lambda g: g.rlike(f"^{_YEAR}$")),
        span.rlike(r"^(?:000|666|9[0-9]{2})-"), F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), rest == 1).otherwise(False), F.size(groups), F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)),
        F.length(F.regexp_replace(span, "[^/]", "")), span.startswith("+"), span.rlike(f"^{DATE}$"), span.rlike(r"^\(?0"),
    ]
    return F.array(*[p.cast("double") for p in parts])


# --- labelled samples and trees ------------------------------------------------------------------


def labelled_samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(generator, span, text before, label) drawn by rule, the same on every machine; as many of each label and generator."""
    r = random.Random(seed)

    def d(k: int, first: str = "123456789") -> str:
        return r.choice(first) + "".join(r.choices("0123456789", k=k - 1))

    def iban(valid: bool) -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), "".join(r.choices("0123456789", k=r.choice([14, 18, 20])))
        rest = int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        check = (98 - rest) if valid else (98 - rest + r.randint(1, 90)) % 97
        whole = f"{country}{check:02d}{body}"
        return whole if r.random() < 0.6 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def phone() -> str:
        sep = r.choice(" .-")
        pairs = lambda k: sep.join(d(2, "0123456789") for _ in range(k))
        return r.choice([
            lambda: f"({d(3, '23456789')}) {d(3, '23456789')}-{d(4, '0123456789')}", lambda: f"{d(3, '23456789')}{sep}{d(3, '23456789')}{sep}{d(4, '0123456789')}", lambda: f"0{r.choice('1234567')}{sep}{pairs(4)}",
            lambda: f"{r.choice('679')}{d(2, '0123456789')} {d(2, '0123456789')} {d(2, '0123456789')} {d(2, '0123456789')}", lambda: f"{r.choice('679')}{d(2, '0123456789')} {d(3, '0123456789')} {d(3, '0123456789')}",
            lambda: f"0{d(r.randint(2, 4))}{r.choice(['/', ' ', '-', ' / '])[:1]}{d(r.randint(5, 8))}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"+{r.choice(['49', '33', '34', '44', '1'])} {d(r.randint(2, 3))} {d(3)} {d(r.randint(3, 4))}",
        ])()

    def number() -> str:
        year, sep = r.randint(1900, 2030), r.choice("./-")
        return r.choice([
            lambda: f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28):02d}{sep}{r.randint(1, 12):02d}{sep}{year}", lambda: f"{year}-{year + r.randint(1, 20)}", lambda: f"{d(2)}.{d(2)}.{d(2)}",
            lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{r.randint(10, 99)} {r.randint(10, 99)}", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}/{d(2)}", lambda: f"{r.randint(978, 979)}-{d(1)}{d(2)}-{d(5)}-{d(2)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
            lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(2)}-{d(2)}", lambda: f"{year} {year}", lambda: f"{d(4)}.{d(2)}", lambda: f"{d(2)} {d(2)} {d(2)}",
        ])()

    good_words, bad_words, plain = ["phone", "call", "tel:", "contact", "mobile", "fax", "telefon", "téléphone"], ["version", "isbn", "part", "serial", "page", "order", "ratio", "total", "between"], ["the", "and", "with", "is", "der", "que", "les", "of"]
    own_words = {"identity": ["ssn", "social", "identity"], "account": ["iban", "account", "konto"], "written_email": ["mail", "contact", "reach"]}
    out = []
    for i in range(n):
        label, kind = i % 2, list(GENERATORS)[i // 2 % 4]
        before = r.choice(own_words.get(kind, good_words) if label and r.random() < 0.6 else bad_words if not label and r.random() < 0.5 else plain) + " "
        if kind == "local_phone":
            span = phone() if label else number()
        elif kind == "identity":
            span = f"{d(3, '1234578') if label else r.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}"
        elif kind == "account":
            span = iban(bool(label))
        else:
            span = f"{r.choice(['ann', 'j.doe', 'info', 'max'])}{r.choice(['(at)', '[at]', ' (at) '])}{r.choice(['mail', 'example', 'web'])}{r.choice(['.', '(dot)', ' [dot] '])}{r.choice(['com', 'org', 'de'])}" if label else f"{d(2)} (at) {d(2)}.{d(1)}"
        out.append((kind, span, before, label))
    return out


def split_samples(samples: list) -> tuple[list, list]:
    """(samples to fit on, samples to calibrate with): of each generator and label every third is kept for the latter."""
    fit, rest, seen = [], [], {}
    for row in samples:
        k = seen[row[0], row[3]] = seen.get((row[0], row[3]), 0) + 1
        (rest if k % 3 == 0 else fit).append(row)
    return fit, rest


Tree = tuple  # (feature, cut, below, above) or a number


def _grow(x: list[list[float]], g: list[float], h: list[float], rows: list[int], depth: int) -> Tree | float:
    gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
    best, found = 1e-6, None
    for j in range(len(FEATURES)) if depth else ():
        order = sorted(rows, key=lambda i: x[i][j])
        a = b = 0.0
        for k, i in enumerate(order[:-1], 1):
            a, b = a + g[i], b + h[i]
            if x[i][j] < x[order[k]][j] and LEAST <= k <= len(order) - LEAST:
                gain = a * a / (b + RIDGE) + (gs - a) ** 2 / (hs - b + RIDGE) - gs * gs / (hs + RIDGE)
                if gain > best:
                    best, found = gain, (j, (x[i][j] + x[order[k]][j]) / 2)
    if found is None:
        return round(RATE * gs / (hs + RIDGE), 6)
    j, cut = found
    return (j, cut, _grow(x, g, h, [i for i in rows if x[i][j] <= cut], depth - 1), _grow(x, g, h, [i for i in rows if x[i][j] > cut], depth - 1))


def _walk(tree: Tree | float, x: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=1)
def model() -> tuple[tuple, dict[str, float]]:
    """(trees, threshold of each generator), fitted and calibrated on different samples.

    A threshold is the least score at which at least PRECISION of the calibrating samples of
    the generator with that score or more are personal data; a generator without any selects nothing.
    """
    fit, rest = ([(k, python_features(s, b), y) for k, s, b, y in part] for part in split_samples(labelled_samples()))
    x, y = [r[1] for r in fit], [r[2] for r in fit]
    total, trees = [0.0] * len(fit), []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-t)) for t in total]
        tree = _grow(x, [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p], list(range(len(fit))), 2)
        trees.append(tree)
        total = [t + _walk(tree, v) for t, v in zip(total, x, strict=True)]
    cuts = {}
    for kind in GENERATORS:
        own = sorted(((round(sum(_walk(t, v) for t in trees), 6), y) for k, v, y in rest if k == kind), reverse=True)
        good, cut = 0, math.inf
        for n, (score, label) in enumerate(own, 1):
            good += label
            # equal scores stand or fall together
            if good / n >= PRECISION and (n == len(own) or own[n][0] < score):
                cut = score
        cuts[kind] = cut - 1e-6
    return tuple(trees), cuts


def score(features: Column, trees: tuple) -> Column:
    """The trees' sum for an array of features, as nested CASE expressions."""

    def case(tree: Tree | float) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(features[tree[0]] <= tree[1], case(tree[2])).otherwise(case(tree[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + case(t)
    return total


# --- spans -----------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, combine, kind: str) -> Column:
    """For each value what ``combine`` makes of all values before it, an array as long as ``values``.

    Blocks of about the square root of the length are summed first, so that no array is
    copied for every value of a long one.
    """

    def of(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
        step = lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x)))
        ahead = lambda b: F.aggregate(F.transform(b, lambda x: F.aggregate(x, zero, combine)), F.array(zero).cast(f"array<{kind}>"), lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x))))
        inside = lambda b: F.zip_with(b, F.slice(ahead(b), F.lit(1), F.size(b)), lambda x, before: F.aggregate(F.slice(x, F.lit(1), F.size(x) - 1), F.array(before).cast(f"array<{kind}>"), step))
        return F.flatten(let(blocks, inside))

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.array().cast(f"array<{kind}>"))


FOUND = "array<struct<start:int,end:int,said:string,before:string>>"


def matches(text: Column, pattern: str, needle: str | None = None) -> Column:
    """FOUND of a pattern's matches, in code points, with the text between a match and the one before it.

    The text's parts between matches and the matches themselves alternate, so running sums
    of their lengths give the places.
    """
    said, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(s: Column, p: Column) -> Column:
        pairs = F.zip_with(s, F.slice(p, F.lit(1), F.size(s)), lambda a, b: F.struct(a.alias("said"), b.alias("part"), (F.length(a) + F.length(b)).alias("n")))

        def with_places(x: Column) -> Column:
            before = running(F.transform(x, lambda y: y["n"]), F.lit(0), lambda a, b: a + b, "int")
            return F.zip_with(x, before, lambda y, at: F.struct((at + F.length(y["part"])).alias("start"), (at + y["n"]).alias("end"), y["said"], F.right(y["part"], F.lit(CONTEXT)).alias("before")))

        return let(pairs, with_places)

    found = let(said, lambda s: F.when(F.size(s) > 0, let(parts, lambda p: placed(s, p)))).cast(FOUND)
    return F.coalesce(F.when(text.rlike(needle or pattern), found), F.array().cast(FOUND))


def _luhn(said: Column) -> Column:
    digits = F.regexp_replace(said, "[^0-9]", "")
    n = F.length(digits)

    def worth(i: Column) -> Column:
        v = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, said: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(said, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(said)
    if kind == "phone":
        return F.length(F.regexp_replace(said, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Beyond every place in a text.
FAR = (1 << 31) - 1


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"], F.lit(ALL_KINDS.index(kind)).alias("rank"), m["end"], F.lit(kind).alias("kind"))).cast(SPAN)


def _checked(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: _valid(kind, m["said"]))


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates, spans by start, that touch no base span.

    Candidates and base spans go into one array by start; a candidate is apart where the
    greatest end of the base spans before it and the least start of those after it are.
    """
    kind = "struct<start:int,own:boolean,rank:int,end:int,kind:string>"
    mark = lambda own: lambda s: F.struct(s["start"], F.lit(own).alias("own"), s["rank"], s["end"], s["kind"])
    every = F.array_sort(F.concat(F.transform(base, mark(False)), F.transform(candidates, mark(True))).cast(f"array<{kind}>"))

    def kept(x: Column) -> Column:
        reach = running(F.transform(x, lambda s: F.when(s["own"], 0).otherwise(s["end"])), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        ahead = F.reverse(running(F.transform(F.reverse(x), lambda s: F.when(s["own"], FAR).otherwise(s["start"])), F.lit(FAR), lambda a, b: F.least(a, b), "int"))
        rows = F.zip_with(F.zip_with(x, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach"))), ahead, lambda p, a: F.struct(p["s"].alias("s"), ((p["reach"] <= p["s"]["start"]) & (a >= p["s"]["end"])).alias("free")))
        return F.transform(F.filter(rows, lambda p: p["s"]["own"] & p["free"]), lambda p: F.struct(p["s"]["start"], p["s"]["rank"], p["s"]["end"], p["s"]["kind"]))

    none = F.array().cast(SPAN)
    return F.when(F.size(candidates) == 0, none).when(F.size(base) == 0, candidates).otherwise(let(every, kept).cast(SPAN))


def _selected(kind: str, found: Column, trees: tuple, cut: float) -> Column:
    """The candidates of a generator that the trees take for personal data."""
    if math.isinf(cut):
        return F.array().cast(FOUND)
    described = F.transform(found, lambda m: F.struct(m["start"], m["end"], m["said"], m["before"], sql_features(m["said"], m["before"]).alias("x")))
    return F.transform(F.filter(described, lambda m: score(m["x"], trees) >= F.lit(float(cut))), lambda m: F.struct(m["start"], m["end"], m["said"], m["before"])).cast(FOUND)


def generated(text: Column, kind: str) -> Column:
    """The candidates of a generator; of telephone numbers those of 6 to 14 digits."""
    found = matches(text, GENERATORS[kind], NEEDLES[kind])
    return F.filter(found, lambda m: F.length(F.regexp_replace(m["said"], "[^0-9]", "")).between(6, 14)) if kind == "local_phone" else found


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, KINDS, base, added, n_candidates, n_selected): arrays of (start, rank, end, kind), each by start, then rank of its kind.

    ``n_candidates`` counts what the generators propose, ``n_selected`` what the trees take of
    it; a selected span that touches a base span is not added, and added spans may overlap
    each other.  Null and empty texts have empty arrays.  Ids may be null or repeated; each
    row stands for itself.  Texts of any length are read whole.  Other columns are not read.
    """
    trees, cuts = model()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("*", *[_spans(_checked(matches(text, PATTERNS[kind], NEEDLES[kind]), kind), kind).alias(kind) for kind in KINDS], *[generated(text, kind).alias(kind) for kind in GENERATORS])
    rows = rows.select("doc_id", "text", *KINDS, F.array_sort(F.concat(*KINDS)).alias("base"), *GENERATORS, *[_selected(kind, F.col(kind), trees, cuts[kind]).alias(f"{kind}_taken") for kind in GENERATORS])
    candidates = sum((F.size(k) for k in GENERATORS), F.lit(0)).cast("long")
    taken = sum((F.size(f"{k}_taken") for k in GENERATORS), F.lit(0)).cast("long")
    every = F.array_sort(F.concat(*[_spans(F.col(f"{k}_taken"), k) for k in GENERATORS]))
    return rows.select("doc_id", "text", *KINDS, "base", _apart(every, F.col("base")).alias("added"), candidates.alias("n_candidates"), taken.alias("n_selected"))


def redacted(spans: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    every = F.array_sort(F.concat("base", "added"))

    def shown(x: Column) -> Column:
        reach = running(F.transform(x, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        first = F.filter(F.zip_with(x, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach"))), lambda p: p["reach"] <= p["s"]["start"])
        return let(first, pieces)

    def pieces(x: Column) -> Column:
        # what stands before each span that is shown, its kind, and what is left after the last one
        parts = F.transform(x, lambda p: F.concat(F.substr(F.col("text"), p["reach"] + 1, p["s"]["start"] - p["reach"]), F.lit("["), p["s"]["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substr(F.col("text"), F.array_max(F.transform(every, lambda s: s["end"])) + 1, F.length("text")))

    return spans.select("doc_id", F.when(F.size(every) == 0, F.col("text")).otherwise(let(every, shown)).alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_spans(read_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, "n_candidates", "n_selected", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
