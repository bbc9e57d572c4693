"""What makes two messages the same: wording but for slips, form and small additions, with equal numbers, dates and names."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

# Month names, in English and then in the other languages of the corpus, from January on.
MONTHS = [
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split(),
]
# Days of the week.
DAYS = (
    "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi "
    "dimanche lunes martes miércoles jueves viernes sábado domingo segunda terça quarta quinta sexta"
).split()
# Words that turn a statement round.
NEGATIONS = "not no never none nobody nothing cannot nicht kein keine nie niemand nichts pas jamais aucun rien nunca nadie nada ninguno não nenhum ninguém".split()

MONTH_NO = {name: i for names in MONTHS for i, name in enumerate(names)}
#: Words that are never a slip of one another, nor a small addition.
EXACT = frozenset([*MONTHS[0], *(m for names in MONTHS[2:] for m in names), *DAYS, *NEGATIONS])
_FIGURE = re.compile(r"\d+(?:[-.,:/‐-―]\d+)*(?:\s?[ap]\.?m\b\.?)?")
_ISO = re.compile(r"(\d{4})[-/.‐-―](\d\d?)[-/.‐-―](\d\d?)")
_TIME = re.compile(r"(\d\d?)(?::(\d\d))?(?::\d\d)?\s?([ap])\.?m\.?")
_THOUSANDS = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?")
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.:]\d+)*")
_ASCII_TOKEN = re.compile(r"[a-z]+|[0-9]+(?:[.:][0-9]+)*")
#: What may stand between the day and the month.
_BETWEEN = frozenset("st nd rd th of de the".split())


def _figure(m: re.Match) -> str:
    """One spelling of a date, a time of day or a number with commas; other figures as they are."""
    t = m[0]
    if t.isdigit():
        return t
    if (d := _ISO.fullmatch(t)) and 1 <= int(d[2]) <= 12:
        return f" {int(d[3])} {MONTHS[0][int(d[2]) - 1]} {d[1]} "
    if h := _TIME.fullmatch(t):
        return f" {int(h[1]) % 12 + 12 * (h[3] == 'p'):02d}:{h[2] or '00'} "
    return t.replace(",", "") if _THOUSANDS.fullmatch(t) else t


def _number(t: str) -> str:
    whole, dot, part = t.partition(".")
    if not dot or not part.isdigit() or len(part) == 3 or ":" in whole:  # three digits may be thousands
        return t
    part = part.rstrip("0")
    return f"{whole}.{part}" if part else whole


def _spell_dates(ws: list[str]) -> list[str]:
    """Day and month with one spelling each: the month in English, the day without a zero before it or an ending behind it."""
    out = list(ws)
    drop = set()
    for i, w in enumerate(ws):
        no = MONTH_NO.get(w)
        if no is None:
            continue
        before, after = i - 1, i + 1
        while before >= 0 and ws[before] in _BETWEEN:
            before -= 1
        for day in (before, after):
            if 0 <= day < len(ws) and ws[day].isdigit() and len(ws[day]) <= 2:
                out[i], out[day] = MONTHS[0][no], str(int(ws[day]))
                drop.update(range(day + 1, i) if day < i else ())
                if day + 1 < len(ws) and ws[day + 1] in ("st", "nd", "rd", "th"):
                    drop.add(day + 1)
                break
    return [w for i, w in enumerate(out) if i not in drop] if drop else out


def words(text: str) -> list[str]:
    """Words and numbers without case, form and punctuation. Dates come out as day, month and year, times of day as hours and minutes, and numbers without commas between thousands and zeros at the end."""
    plain = text.isascii()
    s = _FIGURE.sub(_figure, (text if plain else unicodedata.normalize("NFKC", text)).casefold())
    ws = (_ASCII_TOKEN if plain else _TOKEN).findall(s)
    if "." in s:
        ws = [_number(t) if "." in t else t for t in ws]
    return ws if MONTH_NO.keys().isdisjoint(ws) else _spell_dates(ws)


def numbers(ws: list[str]) -> str:
    """The multiset of the numbers, as text: messages with other numbers are never the same."""
    return " ".join(sorted(w for w in ws if w[0].isdigit()))


@functools.lru_cache(100_000)
def close(a: str, b: str) -> bool:
    """One slip apart, two in words of six letters: a letter lost, added, changed, or two exchanged."""
    short, long = sorted((len(a), len(b)))
    most = 2 if long >= 6 and short >= 5 else 1
    if long - short > most or short < 2:
        return False
    lead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), short)
    a, b = a[lead:], b[lead:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    far = most + 1  # cells further from the diagonal than `most` are of no use
    before2: dict[int, int] = {}
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[0] = i
                continue
            y = b[j - 1]
            d = min(before.get(j, far) + 1, row.get(j - 1, far) + 1, before.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2.get(j - 2, far) + 1)
            row[j] = d
        if min(row.values(), default=far) > most and min(before.values(), default=far) > most:
            return False
        before2, before = before, row
    return before.get(len(b), far) <= most


def _written(w: str, x: str) -> bool:
    """Whether w is x but for a slip or a short form such as 've for have."""
    if w in EXACT and x in EXACT:
        return False
    if min(len(w), len(x)) >= 5 and w[0] == x[0] and abs(len(w) - len(x)) <= 1:
        a, b = Counter(w), Counter(x)
        if sum((a - b).values()) + sum((b - a).values()) <= 1:  # the same letters but one, in whatever order
            return True
    return close(w, x) or (len(w) <= 2 and x.endswith(w)) or (len(x) <= 2 and w.endswith(x))


def _pair_off(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    """What is left of both after slips, and words broken in two or run together, are taken as equal. A slip keeps the first or the last letter."""
    rest: list[str] = []
    by: dict[str, list[int]] = {}
    for i, x in enumerate(right):
        by.setdefault("^" + x[0], []).append(i)
        by.setdefault("$" + x[-1], []).append(i)
    used: set[int] = set()
    for w in left:
        hit = next((i for i in [*by.get("^" + w[0], ()), *by.get("$" + w[-1], ())] if i not in used and _written(w, right[i])), None)
        if hit is None:
            rest.append(w)
        else:
            used.add(hit)
    right = [x for i, x in enumerate(right) if i not in used]
    for one, two in ((rest, right), (right, rest)):
        for w in [w for w in one if len(w) > 3]:
            parts = next(((x, y) for x in two for y in two if x is not y and x + y == w), None)
            if parts:
                one.remove(w)
                for p in parts:
                    two.remove(p)
    return rest, right


def _runs(ws: list[str], rest: list[str]) -> list[tuple[list[str], str, str]]:
    """Runs of words of `rest` in ws, each with the words before and after it."""
    left, out, run = Counter(rest), [], []
    for i, w in enumerate([*ws, ""]):
        if w and left[w] > 0:
            left[w] -= 1
            run.append(w)
        elif run:
            at = i - len(run)
            out.append((run, ws[at - 1] if at else "", w))
            run = []
    return out


def _set_off(run: list[str], before: str, after: str, text: str) -> bool:
    """Whether a run at the start or end of a text is parted from the rest by punctuation, as a greeting or a signature is."""
    near = 40 + 3 * sum(map(len, run)) + 8 * len(run)
    p = r"\W{1,8}".join(map(re.escape, run))
    if not before:
        return re.match(rf"\W{{0,8}}{p}\W{{0,8}}?[:,;)\]\-–—.!]", text[:near], re.IGNORECASE) is not None
    return not after and re.search(rf"[.!?\-–—(:;,]\W{{0,8}}{p}\W{{0,8}}$", text[-near:], re.IGNORECASE) is not None


def _names(ws: list[str], text: str) -> bool:
    """Whether some of the words are written as names inside a sentence of the text."""
    if text.upper() == text:
        return False
    return any(len(w) > 2 and re.search(rf"(?<=[^\W\d_] ){re.escape(w[:1].upper())}{re.escape(w[1:])}\b", text) for w in ws)


def same_message(a: str, b: str, wa: list[str] | None = None, wb: list[str] | None = None) -> bool:
    """The same wording but for slips, form, order of parts and small additions or losses; the same numbers, dates and names.

    Words that only one text has are small additions up to four, or a fifth of the text,
    unless they are months, days or negations, or names. Other words in the same place,
    between equal neighbours, make another message.
    """
    wa, wb = wa or words(a), wb or words(b)
    ca, cb = Counter(wa), Counter(wb)
    left, right = list((ca - cb).elements()), list((cb - ca).elements())
    if not left and not right:
        return True
    shorter = min(len(wa), len(wb))
    if any(w[0].isdigit() for w in left + right) or 3 * (len(left) + len(right)) > 2 * shorter + 8:
        return False
    rest, right = _pair_off(left, right)
    extra = rest + right
    if len(extra) > max(4, shorter // 5) or any(w in EXACT for w in extra):
        return False
    if rest and right:
        inside = [[r for r in _runs(ws, x) if not _set_off(*r, t)] for ws, x, t in ((wa, rest, a), (wb, right, b))]
        for _, p, n in inside[0]:
            for _, q, m in inside[1]:
                if (p == q or close(p, q)) and (n == m or close(n, m)):
                    return False
    return not (len(extra) > 1 and (_names(rest, a) or _names(right, b)))
