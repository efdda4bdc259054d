"""Secret scan: fixed patterns, and strings that a Markov model takes for random.

Two character models of second order are trained on labelled samples: strings drawn at
random from the alphabets of keys, and ordinary identifiers, words and their joins.  Of
every run of key characters the stretch with the greatest sum of log-likelihood ratios is
looked at, so a key that stands beside ordinary text, behind ``=``, ``/`` or ``_``, is met
as well as one alone; it is reported where the sum exceeds a threshold.  The threshold is
set on samples of both labels that were not trained on: the least sum that no more than a
share of the ordinary ones reaches.  A sum grows with length, so no length is ruled out but
that of the patterns' shortest secret.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Least characters of a run that the model looks at, and of a stretch of it: those of the shortest secret of the patterns.
LEAST = 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Ratio that each character of a stretch must outweigh, so that stretches end where random characters do.
MARGIN = 0.1
#: Share of ordinary strings, of those not trained on, that may be reported.
FALSE_SHARE = 0.0002
#: Odds that a stretch is random must be e to this at least, whatever the samples say.
LEAST_SUM = 2.0
#: Runs whose stretch a worker remembers.
REMEMBERED = 100_000

#: Words of which ordinary identifiers are made (fixed values).
WORDS = (
    "account action active add address admin align all any api app apply area args array async attribute auth back base begin block body bool border bottom box buffer "
    "build button byte cache call cancel card cart change char check child class clear click client close code color column command comment commit common config connect "
    "const content context control copy count create current cursor custom data date debug default delete depth detail device dialog disable display document domain done "
    "down draw drop edit element empty enable encode end engine entry error event example execute exit export extend factory false fetch field file filter find first flag "
    "float focus folder font form format frame from function get global graph grid group handle hash head header height help hide host icon image import index info init "
    "input insert inside install instance integer interface item iterator join json key label language last layer layout left length level library limit line link list "
    "listen load local lock log login logout long loop main make manager map mark mask match max memory menu merge message method middle min mode model module mouse move "
    "name network new next node notify null number object offset old open option order output owner package page panel parent parse part password path pattern payment "
    "plugin point policy position post prefix prepare print private process product profile project property proxy public push query queue random range read record "
    "refresh region register release remove render replace report request reset resize resolve resource response result return right role root route row rule run sample "
    "save scale schema scope screen script scroll search section select send sequence server service session set shape share shift show side sign size sort source space "
    "split stack start state status step stop storage store stream string style submit success suffix switch symbol sync system table target task template test text theme "
    "thread time title toggle token tool top total trace track transform tree trigger true type under undo union unique unit update upload url use user util valid value "
    "variable version video view visible wait warning watch widget width window word worker wrap write year zone"
).split()
#: Syllables of ordinary words in the languages of the corpus (fixed values).
SYLLABLES = "the ing and ion tio ent ati for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat und ein ich der sch die gen che ung ten ver ber keit lich heit eur que les ment des aux eau oir ait ant dre par ire ado cion dad que los las est ara ien mente ando aje une ai an vi ier elle le ou oi aux autre etre tre la pa pe eux air vre che wh th hen ly re er ble an na dha ha on and ed sh bly be pf ach ge zu tz erz schu lic de ein nach ist tzt kei aga aco os ja co mi ga ez se sa osa en zco arr bi su jo".split()
#: Alphabets of random strings (fixed values).
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789_-")
SAMPLES = 8000


def labelled_samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` random strings (1) and ``n`` ordinary ones (0), the same on every machine."""
    r = random.Random(seed)

    def ordinary() -> str:
        some = [r.choice(WORDS) for _ in range(r.randint(2, 6))]
        style = r.randrange(9)
        if style < 2:
            text = "_-"[style].join(some)
        elif style == 2:
            text = some[0] + "".join(w.title() for w in some[1:])
        elif style == 3:
            text = "_".join(some).upper()
        elif style == 4:
            text = "/".join(some) + r.choice(["", str(r.randint(0, 2030))])
        elif style == 5:
            text = "=".join(some[:2]) + r.choice(["=true", "=1", "/" + "/".join(some[2:]), f"={r.randint(0, 99999)}"])
        elif style == 6:
            text = r.choice(["-", "=", "_", "/", "+"]) * r.randint(12, 80)
        else:
            text = "".join(r.choice(SYLLABLES) for _ in range(r.randint(4, 14)))
            text = r.choice([text, text, text, text.title(), text.upper()])
        return text + (str(r.randint(0, 99)) if r.random() < 0.3 and style != 6 else "")

    out = []
    for _ in range(n):
        out.append(("".join(r.choices(r.choice(ALPHABETS), k=r.randint(16, 48))), 1))
        out.append((ordinary(), 0))
    return out


_CODES = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")}
_N = len(_CODES)


@dataclass
class MarkovRatio:
    """stretch(s): the part of a string that is most likely random, with its sum of log-likelihood ratios."""

    ratio: dict[str, float]
    threshold: float

    def stretch(self, s: str) -> tuple[float, int, int]:
        """(sum, start, end) of the best stretch of at least LEAST characters; of equals the first."""
        get, total = self.ratio.get, 0.0
        sums = [0.0, 0.0, 0.0]
        for i in range(2, len(s)):
            total += get(s[i - 2 : i + 1], 0.0) - MARGIN
            sums.append(total)
        # a stretch is worth the difference of the sums at its end and behind its first two characters
        best, found, low, begin = -math.inf, (0, 0), math.inf, 0
        for end in range(LEAST, len(s) + 1):
            if sums[end - LEAST + 2] < low:
                low, begin = sums[end - LEAST + 2], end - LEAST
            if sums[end] - low > best:
                best, found = sums[end] - low, (begin, end)
        return best, *found

    def is_random(self, s: str) -> bool:
        return self.stretch(s)[0] >= self.threshold


def parts_of(samples: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(samples to train on, samples to calibrate with): of each label every fourth is kept for the latter."""
    fit, rest, seen = [], [], [0, 0]
    for s, y in samples:
        (rest if seen[y] % 4 == 3 else fit).append((s, y))
        seen[y] += 1
    return fit, rest


def train(samples: list[tuple[str, int]]) -> MarkovRatio:
    """The models, and the least threshold that FALSE_SHARE of the ordinary samples not trained on reaches at most.

    A character given the two before it backs off to the character given one, and that to
    equal chances, by adding counts; so unseen contexts count little either way.  Without
    ordinary samples to calibrate with, nothing is random.
    """
    fit, rest = parts_of(samples)
    chance = []
    for label in (0, 1):
        two: dict[str, int] = {}
        one: dict[str, int] = {}
        three: dict[str, int] = {}
        single: dict[str, int] = {}
        for s, y in fit:
            if y == label:
                for i in range(len(s)):
                    single[s[i]] = single.get(s[i], 0) + 1
                    if i:
                        two[s[i - 1 : i + 1]] = two.get(s[i - 1 : i + 1], 0) + 1
                        one[s[i - 1]] = one.get(s[i - 1], 0) + 1
                    if i > 1:
                        three[s[i - 2 : i + 1]] = three.get(s[i - 2 : i + 1], 0) + 1
        context: dict[str, int] = {}
        for k, v in three.items():
            context[k[:2]] = context.get(k[:2], 0) + v

        def p(k: str, three=three, two=two, one=one, context=context) -> float:
            back = (two.get(k[1:], 0) + 1) / (one.get(k[1], 0) + _N)
            return (three.get(k, 0) + 8 * back) / (context.get(k[:2], 0) + 8)

        chance.append(p)
    ratio = {a + b + c: math.log(chance[1](a + b + c) / chance[0](a + b + c)) for a in _CODES for b in _CODES for c in _CODES}
    model = MarkovRatio(ratio, math.inf)
    ordinary = sorted((model.stretch(s)[0] for s, y in rest if y == 0), reverse=True)
    if ordinary:
        model.threshold = max(LEAST_SUM, ordinary[int(len(ordinary) * FALSE_SHARE)] + 1e-9)
    return model


def quality_of(model: MarkovRatio, samples: list[tuple[str, int]]) -> tuple[float, float]:
    """(share of random strings that are reported, share of ordinary ones)."""
    met = [[model.is_random(s) for s, y in samples if y == label] for label in (1, 0)]
    return tuple(sum(m) / max(1, len(m)) for m in met)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then in the order of KINDS."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def added_spans(text: str, base: list[tuple[int, int, str]], model: MarkovRatio, known: dict[str, tuple[float, int, int]] | None = None) -> tuple[list[tuple[int, int, str]], int]:
    """(spans of kind ``random`` outside the base spans, number of runs looked at).

    What a base span takes of a run is cut off, so the rest of it is looked at on its own.
    ``known`` remembers stretches of runs.
    """
    out, looked, k = [], 0, 0
    known = {} if known is None else known
    for m in _CANDIDATE.finditer(text):
        at, stop = m.span()
        while k < len(base) and base[k][1] <= at:
            k += 1
        j = k
        while at < stop:
            # up to the next base span, then after it
            while j < len(base) and base[j][1] <= at:
                j += 1
            cut, after = (base[j][0], base[j][1]) if j < len(base) and base[j][0] < stop else (stop, stop)
            if cut - at >= LEAST:
                looked += 1
                run = text[at:cut]
                got = known.get(run)
                if got is None:
                    got = model.stretch(run)
                    if len(known) < REMEMBERED and len(run) < 64:
                        known[run] = got
                if got[0] >= model.threshold:
                    out.append((at + got[1], at + got[2], "random"))
            at = max(after, cut)
    return out, looked


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, n_scored long"
#: A text with none of these has no match of the first pattern, the second, the third or a candidate.
_MAY = re.compile(r"[A-Za-z0-9+/_.=-]{12}")


def _scanned(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: MarkovRatio = held.value
        none, known = hashlib.sha256(b"").hexdigest(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for text in part.column(1):
                    text = text.as_py() or ""
                    if not _MAY.search(text):
                        rows.append((0, 0, 0, none, "", 0, 0))
                        continue
                    base = base_spans(text)
                    more, looked = added_spans(text, base, model, known)
                    of = [k for _, _, k in base]
                    spans = sorted([*base, *more], key=lambda x: (x[0], (*KINDS, "random").index(x[2])))
                    rows.append((*(of.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(more), looked))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def secrets(docs: DataFrame, samples: list[tuple[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its spans in code points, the end exclusive, and how many runs the model scored.

    Null and empty texts have no spans.  Ids may be null or repeated; each row stands for
    itself.  Other columns are not read.  Texts of any length are scanned whole, in time in
    proportion to them.  Spans that begin together stand in the order of their kinds; of
    equal stretches of a run the first is reported.  ``samples`` are labelled strings to train on.
    """
    model = train(samples if samples is not None else labelled_samples())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scanned(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read_table(spark, sf_dir, "documents"))
