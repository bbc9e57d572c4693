"""Personal information inside free text (problem 6): candidates, boosted trees on format and context, redaction.

Generators of high recall propose overlapping spans. Boosted trees score them by their
format, by what the corpus says of their words, and by how much the words around them
speak for the kind. They are fitted on labelled sentences (pii_training), whose labels
come from how the sentences were made; thresholds are calibrated on sentences of
templates that were held out. What the corpus says of words is counted over all texts.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import boosting
from mnemospark.llm.pii_training import FOLDS, KINDS, fold_of_template, labelled

TRAINING_TEXTS = 10_000  # labelled texts that the trees are fitted on
COUNT_TEXTS = 40_000  # word counts of larger inputs are stated for so many texts
SLOTS = 1 << 19  # size of the tables of word counts, whatever the corpus
FLUSH = 200_000

# --- candidates: high recall, overlapping ----------------------------------------------
_AT = r"(?:[ \t]?[@＠][ \t]?|[ \t]?[(\[{][ \t]?at[ \t]?[)\]}][ \t]?|[ \t]+at[ \t]+)"
_DOT = r"(?:\.|[ \t]?[(\[{][ \t]?dot[ \t]?[)\]}][ \t]?|[ \t]+dot[ \t]+)"
EMAIL = re.compile(rf"(?<![\w.+\-])[\w][\w.+%\-]*{_AT}[^\W_][\w\-]*(?:{_DOT}[^\W_][\w\-]*)+", re.IGNORECASE)
NUMBER = re.compile(r"(?<![\w@])(?:\+[ \t]?)?[(\d](?:[\d().\-/–]|[ \t](?=[\d(\-]))*\d(?:[ \t]?[A-Z](?!\w))?(?!\w)")
LETTER_ID = re.compile(r"(?<!\w)[A-Z]{1,3}[ \-]?\d{2}[ ]?\d{2}[ ]?\d{2}(?:[ ]?\d{0,4})(?:[ ]?[A-Z])?(?!\w)")
_WORD = r"[^\W\d_][\w'’\-]*"
_TOWN = r"[^\W\d_][\w'’\-]+"
#: What a postal address ends or goes on with: postcodes of several countries, with or without the town behind.
POSTCODE = re.compile(
    rf"(?<![\w\-.])(?:(?P<uk>[A-Z]{{1,2}}\d[A-Z\d]?[ ]?\d[A-Z]{{2}})|(?P<us>[A-Z]{{2}}[ ]\d{{5}}(?:-\d{{4}})?)|(?P<ca>[A-Z]\d[A-Z][ ]?\d[A-Z]\d)|(?P<five>(?:[A-Z]{{1,2}}-)?\d{{5}})(?P<town>[ ]{_TOWN})?(?P<more>[ ]{_TOWN})?)(?![\w])",
    re.IGNORECASE,
)
HOUSE = re.compile(rf"(?<![\w.\-])(?:\d{{1,5}}[ ]?(?:[a-z]|bis|ter)?(?![\w]),?[ ]|p\.?[ ]?o\.?[ ]?box[ ]\d|(?:box|postfach)[ ]\d)|(?<![\w.\-'’]){_WORD}(?=[ .,])", re.IGNORECASE)
STREET = frozenset("street road lane avenue ave drive boulevard blvd court close terrace square way place st rd ln dr rue chemin allée impasse calle c/ avenida avda plaza paseo via viale piazza rua laan straat".split())
STREET_TAIL = re.compile(r"(?:stra(?:ß|ss)e|str\.?|gasse|weg|platz|allee|ring|ufer|laan|straat)$", re.IGNORECASE)
ADDRESS_CHARS = 90
_SHORT = re.compile(r"(?:\b(?:st|ave|rd|dr|ln|blvd|apt|avda|[nsewpo])|str)\.\s?", re.IGNORECASE)
_BREAK = re.compile(r"[.!?:;|]\s")
_BOX = re.compile(r"(?:p\.?\s?o\.?\s?)?box\b|postfach\b", re.IGNORECASE)
_CAP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶŁŃŅŇŐŒŘŚŞŠŢŤŪŮŰŲŹŻŽ][\w'’\-]+"
# Particles between given name and family name.
PARTICLES = "van der|van den|van|von|zu|de la|de|del|della|di|da|dos|du|el|al|la|le|ten|ter|bin|ibn"
_PARTICLE = rf"(?:[ ](?i:{PARTICLES}))?"
PAIR = re.compile(rf"(?=(?<![\w@\-.])({_CAP})((?:[ ][A-ZÀ-Þ]\.)?{_PARTICLE}[ ]|,[ ])({_CAP})(?![\w@]))")
SMALL_PAIR = re.compile(rf"(?=(?<![\w@\-.])([^\W\d_][\w'’\-]+)((?:[ ][^\W\d_]\.)?{_PARTICLE}[ ]|,[ ])([^\W\d_][\w'’\-]+)(?![\w@]))")
# What stands before the first word of a sentence or line: capitals there tell nothing.
_STARTS = frozenset([*(c + " " for c in ".!?:;|>-"), *(c + "\n" for c in "\n.!?:;, )"), "", "  "])
ONE = re.compile(r"(?<![\w@.\-+'’])[^\W\d_][\w'’\-]+(?![\w@]|\.\w)")
_FOLLOWS = re.compile(rf"[ ]{_CAP}")
_PRECEDES = re.compile(rf"{_CAP}[ ]$")
_NUMBER_LINE = re.compile(r"\n[+(\d]")
_SENTENCE = re.compile(r"[.!?:\n]\s*$")
_ANY_WORD = re.compile(r"[^\W\d_][\w'’\-]+")
TITLE = re.compile(r"(?:^|\W)(?:dr|mr|mrs|ms|prof|herrn?|frau|monsieur|madame|mme|se[ñn]ora?|sig)\.?[ ]$", re.IGNORECASE)
DATE_LIKE = re.compile(r"^\(?(?:19|20)\d\d[\-./–](?:0?[1-9]|1[0-2])[\-./–]|^(?:0?[1-9]|[12]\d|3[01])[\-./](?:0?[1-9]|1[0-2])[\-./](?:19|20)\d\d")
_WHOLE_DATE = re.compile(r"\(?(?:(?:19|20)\d\d[\-./–](?:0?[1-9]|1[0-2])[\-./–]\d\d?|\d\d?[\-./](?:0?[1-9]|1[0-2])[\-./](?:19|20)\d\d)\)?(?:[ ]+\d{1,2})?(?: ?[A-Z])?")
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
NANP = re.compile(r"(?:\+?1[ .\-]?)?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")


# --- words of the corpus -----------------------------------------------------------------
@dataclass
class Lexicon:
    """Names of the given list, and tables over hashed words: how often a word is written small, how often with a capital inside a sentence, how often it is second in a pair with capitals, and after how many different words."""

    given: frozenset[str]
    family: frozenset[str]
    counts: np.ndarray  # (4, SLOTS): small, capital, second, variety
    _known: dict = field(default_factory=dict, repr=False)
    _rare: dict = field(default_factory=dict, repr=False)
    _pairs: dict = field(default_factory=dict, repr=False)

    def of(self, w: str) -> tuple[float, float, float, float]:
        got = self._known.get(w)
        if got is None:
            if len(self._known) > 100_000:
                self._known.clear()
            got = self._known[w] = tuple(self.counts[:, slot(w)].tolist())
        return got

    def rare(self, w: str) -> int:
        """Whether a word that is written small may be a name: 2 if it is listed or mostly written with a capital elsewhere, 1 if it is hardly known, 0 if it is an ordinary word."""
        got = self._rare.get(w)
        if got is None:
            if len(self._rare) > 100_000:
                self._rare.clear()
            small, capital, _, _ = self.of(w)
            known = w in self.given or w in self.family or len(w) > 2 and capital > 0.5 and small <= 0.5 * (small + capital) + 2
            got = self._rare[w] = 2 if known else int(len(w) > 2 and small <= 2)
        return got

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_rare": {}, "_pairs": {}}


def slot(w: str) -> int:
    return xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % SLOTS


def words_of(t: str) -> Iterator[tuple[str, str]]:
    """(second word, word before it) of every pair with capitals, and (word, one of 0 and 1) of every word written small or with a capital; in lower case."""
    for m in PAIR.finditer(t):
        if not m.group(2).startswith(","):
            yield m.group(3).lower(), m.group(1).lower()
    for m in ONE.finditer(t):
        w = m.group()
        if w[0].islower():
            yield w, "0"
        elif t[max(0, m.start() - 2) : m.start()] not in _STARTS:
            yield w.lower(), "1"


def _tables(rows: Iterator[tuple[int, int, float, float]]) -> np.ndarray:
    """From (slot, kind, n, variety) rows; kind is 0 for small, 1 for capital and 2 for second."""
    out = np.zeros((4, SLOTS), np.float32)
    for at, kind, n, variety in rows:
        out[kind, at] += n
        if kind == 2:
            out[3, at] += variety
    return out


def local_counts(texts: list[str]) -> np.ndarray:
    counts = Counter(x for t in texts for x in words_of(t))
    return _tables((slot(w), int(b) if b in "01" else 2, float(c), 1.0) for (w, b), c in counts.items())


def word_counts(df: DataFrame, text: str, n: int, base: int = COUNT_TEXTS) -> DataFrame:
    """(at, kind, n, variety): how often the words of a slot are written small, with a capital and second in a pair with capitals, and after how many different words, over all n texts.

    All are what `base` of the texts have on average, so they are alike at every size: a
    pair seen c times is in a share f of the texts with 1 - (1 - f) ** c. At most three
    rows per slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            pair = [int(b) if b in "01" else 2 + xxhash.xxh64_intdigest(w + " " + b) // 4 for w, b in counts]
            return pa.RecordBatch.from_arrays([pa.array([slot(w) for w, _ in counts], pa.int32()), pa.array(pair, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["at", "pair", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(words_of(t.as_py()))
                if len(counts) > FLUSH:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    f = min(1.0, base / max(1, n))
    pairs = df.filter(F.length(text) > 0).select(text).mapInArrow(run, "at int, pair bigint, c bigint").groupBy("at", "pair").agg(F.sum("c").alias("c"))
    seen = F.lit(1.0) if f == 1 else 1 - F.pow(F.lit(1 - f), F.col("c"))
    return pairs.groupBy("at", F.least("pair", F.lit(2)).cast("int").alias("kind")).agg((F.sum("c") * f).alias("n"), F.sum(seen).alias("variety")).filter("n > 0.5")


# --- spans and their formats -------------------------------------------------------------
@dataclass
class Span:
    kind: str
    start: int
    end: int
    format: list[float]


def _number_spans(text: str) -> Iterator[Span]:
    found = {m.span() for m in NUMBER.finditer(text)} | {m.span() for m in LETTER_ID.finditer(text)}
    # a letter that stands alone behind may begin the next sentence
    found |= {(a, a + len(text[a : b - 1].rstrip())) for a, b in found if text[b - 1].isalpha() and text[b - 2] in " \t"}
    for a, b in sorted(found):
        s = text[a:b]
        groups = [len(g) for g in re.findall(r"\d+", s)]
        n = sum(groups)
        if not 6 <= n <= 16 or _WHOLE_DATE.fullmatch(s):
            continue
        after = text[b : b + 3]
        f = [
            n, len(groups), groups[0], groups[1] if len(groups) > 1 else 0, groups[-1], max(groups), len(set(groups)) == 1, s.count(" "), s.count("-") + s.count("–"), s.count("."), s.count("/"), s.count("("), s[0] == "+", s[:2] == "00", s[0] == "0",
            sum(c.isalpha() for c in s[:3]), s[-1].isalpha(), s[-2:-1] == " " and s[-1].isalpha(), bool(DATE_LIKE.search(s)), bool(NANP.fullmatch(s)), len(set(s) & set(" -./(")), bool(_IP.fullmatch(s)), after[:1] == ":" or bool(re.match(r"[:,.]\d", after)), bool(re.search(r"\d[:,.]$", text[max(0, a - 2) : a])), len(s),
            after[:1] == " " and after[1:2].islower(), after[:1] == " " and after[1:2].isupper() and not after[2:].strip(),
        ]
        f = [float(x) for x in f]
        yield Span("phone", a, b, f)
        yield Span("id_number", a, b, f)


def _email_spans(text: str) -> Iterator[Span]:
    for m in EMAIL.finditer(text):
        a, b = m.span()
        while text[b - 1] in ".-_":
            b -= 1
        s = text[a:b]
        parts = re.split(r"[^\w\-+%]+", s)
        last = parts[-1]
        sign = re.search(r"[@＠]", s)
        local = s[: sign.start()] if sign else re.split(r"\W+at\W+", s, flags=re.IGNORECASE)[0]
        f = [
            bool(sign), "＠" in s, bool(re.search(r"[\[({]\s?at\s?[\])}]", s, re.I)), bool(re.search(r"[\[({]\s?dot\s?[\])}]", s, re.I)), bool(re.search(r"\sat\s", s, re.I)), bool(re.search(r"\sdot\s", s, re.I)), "." in s[len(local) :], last.isalpha(), len(last), len(parts),
            bool(re.search(r"\s[@＠]|[@＠]\s", s)), bool(re.search(r"[@＠]\s?\d", s)), any(c.isdigit() for c in last), s.count(" "), len(local), any(c in local for c in "._+-") or any(c.isdigit() for c in local), local.strip()[:1].isalpha(), text[b : b + 1] == ":",
            last.lower() in ("png", "jpg", "jpeg", "gif", "svg", "pdf", "txt"),
        ]
        yield Span("email", a, b, [float(x) for x in f])


def _street_like(ws: list[str]) -> tuple[int, int]:
    """(how many street words, place of the first one or -1)."""
    at = [i for i, w in enumerate(ws) if w.strip(".,").lower() in STREET or (STREET_TAIL.search(w.strip(",")) and len(w) > 4)]
    return len(at), at[0] if at else -1


def _address_spans(text: str, lex: Lexicon) -> Iterator[Span]:
    for code in POSTCODE.finditer(text):
        lo = max(0, code.start() - ADDRESS_CHARS)
        window = text[lo : code.start()]
        if not any(c.isdigit() for c in window):
            continue
        five = code.group("five") is not None
        # where it may end: behind the code, or the first or second word of a town behind it
        ends = [(code.end(g), n) for n, g in enumerate(("five", "town", "more")) if code.group(g) is not None] if five else [(code.end(), 0)]
        inside = []
        for m in HOUSE.finditer(window):
            a = lo + m.start()
            s = text[a : code.start()]
            numbers = re.findall(r"\d+", s)
            if not numbers or s.count("\n") > 1 or _BREAK.search(_SHORT.sub(" ", s)):
                continue
            ws = s.split()
            count, first = _street_like(ws)
            box = s[:1] in "pPbB" and bool(_BOX.match(s))
            if not count and not box and not s[0].isdigit() and not s.lower().startswith(("am ", "an der ", "im ")):
                continue
            names = [w for w in ws if w[0].isalpha()]
            lower = [w for w in names if w[0].islower() and w.strip(".,").lower() not in STREET]
            inside.append((a, [
                count, first, box, s[0].isdigit(), len(numbers), len(numbers[0]), len(ws), sum(w[0].isupper() for w in names) / max(1, len(names)), s.count(","), "\n" in s, " - " in s or " – " in s, bool(re.search(r"[,\n]\s*$|[-–]\s*$", s)), len(s),
                ws[0].strip(".,").lower() in STREET or bool(STREET_TAIL.search(ws[0].strip(",")) and len(ws[0]) > 4), ws[-1][-1:].isdigit(), s[0].isupper(), bool(re.search(r"\d\s?(?:bis|ter|[a-z])\b", s, re.I)), len(lower),
            ]))
        for end, n in ends:
            last = text[code.start() : end].split()[-1]
            small, capital, _, _ = lex.of(last.lower())
            after = text[end : end + 2]
            form = [code.group("uk") is not None, code.group("us") is not None, code.group("ca") is not None, five, n, _shape(last), math.log1p(small), small / (small + capital + 1), after[:1] in ("", ".", ",", "\n", ";", ")"), after[1:2].isupper(), after[1:2].islower(), code.group("us") is not None and code.group("us")[0].isupper()]
            for a, f in inside:
                yield Span("address", a, end, [float(x) for x in [*f, *form]])


def _shape(w: str) -> int:
    return 0 if w.islower() else 2 if w.isupper() else 1


def _name_format(first: str, mid: str, second: str, lex: Lexicon) -> list[float]:
    """What the words of a name tell by themselves and by the corpus."""
    x, y = first.lower(), second.lower()
    tail = y.rsplit("-", 1)[-1]
    comma = mid.startswith(",")
    g, fam = (y, x) if comma else (x, y)
    sx, bx, cx, vx = lex.of(x)
    sy, by, cy, vy = (max(p) for p in zip(lex.of(y), lex.of(tail))) if tail != y else lex.of(y)
    return [float(v) for v in (
        g in lex.given, fam in lex.family or any(p in lex.family for p in fam.split("-")), x in lex.family or y in lex.given and not comma, math.log1p(sx), math.log1p(sy), sx / (sx + bx + 1), sy / (sy + by + 1), math.log1p(bx), math.log1p(by), math.log1p(cx), math.log1p(cy), math.log1p(vx), math.log1p(vy),
        vy / (cy + 1), cy / (by + 1), comma, "." in mid, bool(re.search(rf" (?:{PARTICLES})\b", mid, re.I)), _shape(first), _shape(second), "-" in second, len(first), len(second),
    )]


def _name_spans(text: str, lex: Lexicon) -> Iterator[Span]:
    found = {(m.start(1), m.end(3)): m.group(1, 2, 3) for m in PAIR.finditer(text)}
    rare = lex.rare
    if any(rare(w) == 2 for w in _ANY_WORD.findall(text) if w[0].islower()):
        for m in SMALL_PAIR.finditer(text):
            x, y = m.group(1), m.group(3)
            if m.group(2)[0] == "," or x[0].isupper() and y[0].isupper():
                continue
            p, q = (2 if w[0].isupper() else rare(w) for w in (x, y))
            if not q and "-" in y:
                q = rare(y.rsplit("-", 1)[-1])
            if p and q and p + q > 2 and 2 in (p * x[0].islower(), q * y[0].islower()):
                found.setdefault((m.start(1), m.end(3)), m.group(1, 2, 3))
    for (a, b), words in found.items():
        form = lex._pairs.get(words)
        if form is None:
            if len(lex._pairs) > 50_000:
                lex._pairs.clear()
            form = lex._pairs[words] = _name_format(*words, lex)
        left, right = text[max(0, a - 12) : a], text[b : b + 16]
        begins, ends = a == 0 or text[a - 1] == "\n", b == len(text) or text[b] == "\n"
        place = [bool(_FOLLOWS.match(right)), bool(_PRECEDES.search(left)), left[-1:] == " " and bool(TITLE.search(left)), begins, ends, ends and bool(_NUMBER_LINE.match(right)), begins or bool(_SENTENCE.search(left))]
        yield Span("name", a, b, [*form, *(float(v) for v in place)])


def spans(text: str, lex: Lexicon) -> Iterator[Span]:
    yield from _number_spans(text)
    if "@" in text or "＠" in text or re.search(r"\bat\b", text, re.I):
        yield from _email_spans(text)
    yield from _address_spans(text, lex)
    yield from _name_spans(text, lex)


# --- what the words around and inside say -----------------------------------------------
def _plain(tokens: list[str]) -> list[str]:
    return ["0" if t[0].isdigit() else t.lower() for t in tokens]


def surroundings(text: str, s: Span) -> list[tuple[str, str]]:
    """(place, token) of up to four tokens on the left and three on the right, and for names of the words inside. Digits are all alike."""
    left = _plain(_TOKEN.findall(text[max(0, s.start - 36) : s.start])[-4:])
    right = _plain(_TOKEN.findall(text[s.end : s.end + 28])[:3])
    out = [("l1", left[-1] if left else "^"), ("r1", right[0] if right else "$")]
    if len(left) > 1:
        out.append(("l12", left[-2] + " " + left[-1]))
    out += [("l", t) for t in left[:-1]]
    out += [("r", t) for t in right[1:]]
    if s.kind == "name":
        inside = text[s.start : s.end].lower().split()
        out += [("w1", inside[0].strip(",")), ("w2", inside[-1])]
    return out


class Context:
    """Log-odds of tokens around items against those around other candidates of a kind, shrunk to 0 where they are rare and bounded."""

    def __init__(self, rows: list[tuple[list[tuple[str, str]], bool]], most: float = 3.0):
        good, bad = Counter(), Counter()
        for tokens, y in rows:
            (good if y else bad).update(tokens)
        n, m = sum(y for _, y in rows) + 1, sum(not y for _, y in rows) + 1
        self.weight = {}
        for t in good.keys() | bad.keys():
            a, b = good[t], bad[t]
            if a + b >= 4:
                w = math.log((a + 5 * n / (n + m)) / (b + 5 * m / (n + m))) - math.log(n / m)
                self.weight[t] = max(-most, min(most, w))

    def features(self, tokens: list[tuple[str, str]]) -> list[float]:
        by = {"l1": 0.0, "l12": 0.0, "l": 0.0, "r1": 0.0, "r": 0.0, "w1": 0.0, "w2": 0.0}
        get = self.weight.get
        for t in tokens:
            w = get(t)
            if w is not None:
                by[t[0]] += w
        return list(by.values())


# --- the detector ------------------------------------------------------------------------
@dataclass
class Detector:
    lexicon: Lexicon
    models: dict[str, boosting.Forest]
    contexts: dict[str, Context]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Per text the chosen items (start, end, kind, probability): those over their kind's threshold, the surest first where they overlap, longer ones before shorter."""
        got: dict[str, list[tuple[int, Span]]] = {k: [] for k in KINDS}
        for i, t in enumerate(texts):
            for s in spans(t, self.lexicon):
                got[s.kind].append((i, s))
        chosen: list[list[tuple[float, Span]]] = [[] for _ in texts]
        for kind, refs in got.items():
            if not refs:
                continue
            x = np.array([s.format + self.contexts[kind].features(surroundings(texts[i], s)) for i, s in refs])
            p = self.models[kind].probability(x)
            for k in np.flatnonzero(p >= self.models[kind].threshold):
                chosen[refs[k][0]].append((float(p[k]), refs[k][1]))
        out = []
        for cs in chosen:
            taken: list[tuple[int, int, str, float]] = []
            for q, s in sorted(cs, key=lambda x: (-round(20 * x[0]), -x[0] if x[1].kind == "address" else 0, -(x[1].end - x[1].start), x[1].start)):
                if all(s.end <= a or s.start >= b for a, b, _, _ in taken):
                    taken.append((s.start, s.end, s.kind, q))
            out.append(sorted(taken))
        return out


def _examples(n: int, seed: int, lex: Lexicon) -> dict[str, tuple[list, list, np.ndarray, np.ndarray]]:
    """Per kind: formats, surroundings, labels and template groups of all candidates of n labelled texts."""
    out: dict[str, list] = {k: [] for k in KINDS}
    for t in labelled(n, seed):
        want = set(t.items)
        for s in spans(t.text, lex):
            group = next((k for a, b, k in t.groups if a <= s.start < b), -1)
            out[s.kind].append((s.format, surroundings(t.text, s), (s.start, s.end, s.kind) in want, group))
    return {k: ([r[0] for r in v], [r[1] for r in v], np.array([r[2] for r in v], int), np.array([r[3] for r in v])) for k, v in out.items()}


def fold_of(groups: np.ndarray) -> np.ndarray:
    return np.array([fold_of_template(int(k)) if k >= 0 else 0 for k in groups], int)


@functools.lru_cache(4)
def fitted(n: int, names: tuple[tuple[str, str], ...], seed: int = 0) -> Detector:
    """The trees, fitted on n labelled texts. The known names stand for part of the names of those texts, as they do in real text.

    Surroundings are scored by log-odds from templates of other folds, so the trees see
    how much wording that is new to them tells. Calibration and thresholds are from a
    fold of templates that the trees haven't seen.
    """
    texts = [t.text for t in labelled(n, seed)]
    sides: tuple[set[str], set[str]] = set(), set()
    for t in labelled(n, seed):
        for a, b, k in t.items:
            ws = re.findall(r"[^\W\d_][\w'’\-]+", t.text[a:b].lower())
            if k == "name" and len(ws) > 1:
                given_last = "," in t.text[a:b]
                sides[given_last].add(ws[0])
                sides[not given_last].update(ws[-1].split("-"))
    rng = random.Random(seed + 1)
    # the list given may hold none of these names: a part of them is taken as listed
    given, family = (frozenset(w for w in sorted(x) if rng.random() < 0.45) for x in sides)
    made = Lexicon(given, family, local_counts(texts) * np.float32(COUNT_TEXTS / max(1, n)) ** np.float32(0.5))
    models, contexts = {}, {}
    for kind, (formats, tokens, y, groups) in _examples(n, seed, made).items():
        fold = fold_of(groups)
        rows = list(zip(tokens, y.astype(bool)))
        around = [None] * len(rows)
        for k in range(FOLDS):
            c = Context([r for r, f in zip(rows, fold) if f != k])
            for i in np.flatnonzero(fold == k):
                around[i] = c.features(tokens[i])
        x = np.array([a + b for a, b in zip(formats, around)], float)
        contexts[kind] = Context(rows)
        models[kind] = boosting.Forest.fit(x, y, fold, seed)
    return Detector(made, models, contexts)


def detector(counts: np.ndarray, names: list[tuple[str, str]], training: int = TRAINING_TEXTS) -> Detector:
    """The fitted trees with the words of a corpus: its counts together with those of the labelled texts."""
    base = fitted(training, ())
    given = frozenset(n.lower() for n, k in names if n and k == "given")
    family = frozenset(n.lower() for n, k in names if n and k == "family")
    lex = Lexicon(given or frozenset(), family or frozenset(), base.lexicon.counts + counts)
    return Detector(lex, base.models, base.contexts)


def train(df: DataFrame, names: DataFrame, text: str, training: int = TRAINING_TEXTS) -> Detector:
    """Count the words of all texts and put them beside the fitted trees. The driver gets at most two rows per slot."""
    n = df.filter(F.col(text).isNotNull()).count()
    listed = [(r[0], r[1]) for r in names.select("name_text", "name_kind").collect()]  # a small fixed table
    got = word_counts(df, text, n).toArrow()
    rows = zip(got.column("at").to_pylist(), got.column("kind").to_pylist(), got.column("n").to_pylist(), got.column("variety").to_pylist())
    return detector(_tables(rows), listed, training)


def find_items(df: DataFrame, names: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, kind, surface, start, probability) of every item in every text.

    Generators propose overlapping spans for email addresses, phone numbers, identity
    numbers, postal addresses and names; boosted trees on format and context score them;
    calibrated thresholds select. Nulls and empty texts have no items; repeated rows
    come out as often as they go in; other columns are dropped. `names` is a small fixed
    table. Finding is a narrow map; only word counts are shuffled.
    """
    model = train(df, names, text)
    kind_of_key = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                found = model.find(b.column(1)[lo : lo + 512].to_pylist())
                texts = b.column(1)[lo : lo + 512]
                at = [i for i, f in enumerate(found) for _ in f]
                flat = [x for f in found for x in f]
                surfaces = [texts[i].as_py()[x[0] : x[1]] for i, x in zip(at, flat)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo : lo + 512].take(pa.array(at, pa.int64())), pa.array([x[2] for x in flat], pa.string()), pa.array(surfaces, pa.string()), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[3] for x in flat], pa.float64())],
                    names=[key, "kind", "surface", "start", "probability"],
                )

    return df.filter(F.length(text) > 0).select(key, text).mapInArrow(run, f"`{key}` {kind_of_key}, kind string, surface string, start int, probability double")


def redact(df: DataFrame, names: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, text) of every row, each item replaced by its kind in brackets, such as [EMAIL]; the rest of the text unchanged, nulls null."""
    model = train(df, names, text)
    kind_of_key = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                texts = b.column(1)[lo : lo + 512].to_pylist()
                found = model.find([t or "" for t in texts])
                out = []
                for t, items in zip(texts, found):
                    for a, e, kind, _ in reversed(items):
                        t = f"{t[:a]}[{kind.upper()}]{t[e:]}"
                    out.append(t)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + 512], pa.array(out, pa.string())], names=[key, text])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind_of_key}, `{text}` string")
