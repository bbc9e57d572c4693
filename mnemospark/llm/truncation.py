"""Texts cut off by field limits or broken transfers (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
BITS = 5
LANGS = ("en", "de", "fr", "es", "pt", "zh", "other")
# Classes of characters; letters of other scripts, symbols and controls have classes of their own.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\xa0", "\n\r", ".。", ",;:，、；：", "!?！？", "-–—", "(", ")（）", "[", "]", "{", "}", "\\", "$", "&", "%", "~", "^", "_", "=+<>|/*#@", "'\"`’”“"]
WIDE, LATIN, OTHER = len(CLASSES), 0, len(CLASSES) + 1
# Where a paragraph, item, entry or section of a text ends.
UNIT_END = re.compile(r"\n[ \t]*(?:\r?\n|\\(?:end\{(?:abstract|itemize|enumerate|document|thebibliography|proof|theorem|lemma)\}|section|subsection|paragraph|item\b|bibitem|bibliography))", re.IGNORECASE)
BLOCK_CHARS = 400_000
# What a cut leaves behind it.
MARK = re.compile(r"(?:\ufffd+|…|\.\.\.+|\[(?:\.\.\.|…|truncated|cut|snip)\]|<(?:cut|truncated|snip)>|\((?:truncated|cut)\))$", re.IGNORECASE)
MARK_COMMENT = re.compile(r"transfer|abort|truncat|interrupt|connection|cut off|limit reached|timed? ?out", re.IGNORECASE)
COMMENT = re.compile(r"(?:^|\n)[ \t]*%[^\n]*$")
CLOSER = re.compile(r"\\(?:end\{(?:document|thebibliography|abstract|itemize|enumerate|proof|theorem|lemma)\}|endinput|bibliographystyle\{[^{}]*\}|bibliography\{[^{}]*\})$", re.IGNORECASE)
INNER = re.compile(r"\\(begin|end)\s*\{([A-Za-z]+)\*?\}", re.IGNORECASE)
FORMULA = frozenset("equation align gather multline eqnarray displaymath math tabular array split cases matrix pmatrix bmatrix aligned alignat flalign tabularx longtable".split())
LINE_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
STUB_CHARS = 40


def clean_tail(text: str) -> tuple[str, bool, bool]:
    """The text without what follows its last content; whether a mark of a cut and whether closing commands were there."""
    s, marked, closed = text.rstrip(), False, False
    while s:
        line = max(s.rfind("\n"), s.rfind("\r")) + 1
        last = s[line:].lstrip()
        if last.startswith("%"):
            marked |= bool(MARK_COMMENT.search(last))
            s = s[:line].rstrip()
            continue
        m = MARK.search(s, max(0, len(s) - 60))
        if m:
            if m.group().startswith(".") and s[: m.start()].rstrip().lower().endswith("etc"):
                return s, marked, closed
            marked, s = True, s[: m.start()].rstrip()
            continue
        m = CLOSER.search(s, max(0, len(s) - 400))
        if m:
            closed, s = True, s[: m.start()].rstrip()
            continue
        break
    return s, marked, closed


def _environments(s: str) -> list[tuple[int, str, bool]]:
    """(where it ends, name, whether it begins) of every \\begin and \\end, in any case."""
    return [(m.end(), m.group(2).lower(), m.group(1).lower() == "begin") for m in INNER.finditer(s)] if "\\" in s else []


def open_parts(s: str, environments: list[tuple[int, str, bool]] | None = None) -> tuple[bool, bool]:
    """Whether a formula or table, and whether a brace group or command is open at the end of s: all environments around that place count."""
    stack: list[str] = []
    for end, name, begins in _environments(s) if environments is None else environments:
        if end > len(s):
            break
        if begins:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    last = s[max(s.rfind("\n\n"), s.rfind("\n\r\n"), 0) :]
    last = re.sub(r"\\[\\%&#_$]", "", LINE_COMMENT.sub("", last))
    depth = last.count("{") - last.count("}")
    depth -= last.count("\\{") - last.count("\\}")
    formula = any(name in FORMULA for name in stack) or last.count("$") % 2 == 1 or last.count("\\(") > last.count("\\)") or last.count("\\[") > last.count("\\]")
    return formula, depth > 0


ENTRY = re.compile(r"\\bibitem", re.IGNORECASE)
_RUN = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.DOTALL)
_RANGE = re.compile(r"(\d+)\s*[-–—]+\s*(\d+)\W*$")
_RANGE_START = re.compile(r"(\d+)\s*[-–—]+\s*$")


def entry_shape(s: str) -> str | None:
    """How the bibliography entry that s ends with ends: the kinds of its last runs of characters, and whether two numbers joined by a dash ascend. None outside of entries."""
    at = max((m.start() for m in ENTRY.finditer(s, max(0, len(s) - 3_000))), default=-1)
    entry = s[at:]
    if at < 0 or "\n\n" in entry or "\\end{" in entry.lower():
        return None
    runs = ["9" if r[0].isdigit() else "a" if r[0].isalpha() else " " if r[0].isspace() else r for r in _RUN.findall(entry[-48:])]
    m = _RANGE.search(entry)
    return "".join(runs[-5:]) + (("<" if int(m.group(2)[:12]) >= int(m.group(1)[:12]) else ">") if m else "")


#: What besides contexts is counted at ends of units and at other places: open formulas, open groups, shapes of entries.
FORMULAS, GROUPS, SHAPES = 100, 101, 102
_MARKS = np.zeros(128, np.uint8)
_MARKS[[ord(c) for c in "\\{}$()[]"]] = range(1, 9)
_PARAGRAPH = re.compile(r"\n\r?\n\s*(?=\S)")
_END = re.compile(r"\\end\{", re.IGNORECASE)


def open_steps(s: str, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`open_parts` of s at all places below `upto` (s[:place] without space at its end), as (places where it may change, formula from there on, group from there on)."""
    kind = _MARKS[np.minimum(np.frombuffer(s[:upto].encode("utf-32-le", "surrogatepass"), np.uint32), 127)]
    at = np.flatnonzero(kind)
    comments = [m.span() for m in LINE_COMMENT.finditer(s, 0, upto)]
    if comments:
        lo, hi = np.array(comments).T
        i = np.searchsorted(lo, at, side="right") - 1
        at = at[(i < 0) | (at >= hi[np.maximum(i, 0)])]
    kind = kind[at]
    # a mark is escaped behind an odd number of backslashes
    slash = kind == 1
    behind = np.zeros(len(at), bool)
    behind[1:] = slash[:-1] & (at[1:] == at[:-1] + 1)
    first = np.maximum.accumulate(np.where(behind & slash, 0, np.arange(len(at)))) if len(at) else at
    odd = (np.arange(len(at)) - first) % 2 == 0
    escaped = np.zeros(len(at), bool)
    escaped[1:] = behind[1:] & odd[:-1]

    def sums(opens: int, closes: int, esc: bool) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(((kind == opens).astype(np.int64) - (kind == closes)) * (escaped == esc))])

    paragraphs = np.array([m.end() for m in _PARAGRAPH.finditer(s, 0, upto)], np.int64)
    steps, inside, stack = [0], [False], []
    for end, name, begins in _environments(s):
        if begins:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
        steps.append(end)
        inside.append(any(x in FORMULA for x in stack))
    places = np.unique(np.concatenate([at + 1, paragraphs + 1, steps]))
    places = places[places < max(upto, 1)]
    upto_here = np.searchsorted(at, places)
    p = np.searchsorted(paragraphs, places)
    since = np.where(p > 0, np.searchsorted(at, np.concatenate([[0], paragraphs])[p]), 0)
    held = lambda c: c[upto_here] - c[since]
    formula = np.array(inside)[np.searchsorted(steps, places, side="right") - 1] | (held(sums(4, 0, False)) % 2 == 1) | (held(sums(5, 6, True)) > 0) | (held(sums(7, 8, True)) > 0)
    return places, formula, held(sums(2, 3, False)) > 0


def entry_shapes(s: str, lo: int, hi: int) -> tuple[dict[str, int], str | None]:
    """`entry_shape` at all places inside the entry s[lo:hi] behind its command, with the number of places, and at its end."""
    e = s[lo : min(hi, lo + 3_000)]
    n, last = len(e), min(len(e), hi - lo - 1)
    blank, closed = re.search(r"\n\n\s*(?=\S)", e), _END.search(e)
    n = min(n, blank.end() if blank else n, closed.end() - 1 if closed else n)
    last = min(last, n)
    found: dict[str, int] = {}
    kinds: list[str] = []
    ends: list[int] = []
    shape, flag = "", ""

    def add(shape: str, a: int, z: int) -> None:
        k = (z if z < last else last) - (a if a > 7 else 7)
        if k > 0:
            found[shape] = found.get(shape, 0) + k

    for m in _RUN.finditer(e, 0, n):
        a, z = m.span()
        c = e[a]
        kinds.append("9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c)
        ends.append(z)
        if kinds[-1] == " ":
            add(shape, a, z)
            continue
        first = max(0, len(kinds) - 5)
        before = None
        if c == "_" or c.isalnum():
            flag = ""
            if c.isdecimal():
                before = _RANGE_START.search(e, 0, a) if kinds[-2] in " -–—" else None
        if before is None and z - ends[first] < 48:
            shape = "".join(kinds[first:]) + flag
            add(shape, a, z)
            continue
        for k in range(a + 1, z + 1):
            while ends[first] <= k - 48:
                first += 1
            if before:
                flag = "<" if int(e[a:k][:12]) >= int(before.group(1)[:12]) else ">"
            shape = "".join(kinds[first:]) + flag
            add(shape, k - 1, k)
    return found, shape if n == hi - lo and shape else None


def structure(s: str, ends: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(what, value, how often at ends of units, how often at other places): all ends but the last and all places before it, and for entries all ends but the last and all places inside."""
    places, *opened = open_steps(s, ends[-1])
    width = np.diff(np.append(places, max(ends[-1], 1)))
    here = np.searchsorted(places, ends[:-1], side="right") - 1
    for what, is_open in zip((FORMULAS, GROUPS), opened):
        e, n = int(is_open[here].sum()), int(width[is_open].sum())
        yield what, 1, e, n
        yield what, 0, len(here) - e, ends[-1] - n
    starts = [m.start() for m in ENTRY.finditer(s)]
    total: dict[str, list[int]] = {}
    for lo, hi in zip(starts, starts[1:]):
        inside, end = entry_shapes(s, lo, hi)
        for shape, n in inside.items():
            total.setdefault(shape, [0, 0])[1] += n
        if end is not None:
            total.setdefault(end, [0, 0])[0] += 1
    for shape, (e, n) in total.items():
        yield SHAPES, xxhash.xxh64_intdigest(shape) >> 1, e, n


def _table() -> np.ndarray:
    t = np.full(0x3000, OTHER, np.uint8)
    t[0xC0:0x250] = LATIN
    for k, cs in enumerate(CLASSES):
        for c in cs:
            if ord(c) < 0x3000:
                t[ord(c)] = k
    return t


_TABLE = _table()
_WIDE = {ord(c): k for k, cs in enumerate(CLASSES) for c in cs if ord(c) >= 0x3000}


def contexts(s: str) -> np.ndarray:
    """Per character the classes of the ORDER characters that end with it, the last one in the lowest bits."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _TABLE[np.minimum(c, 0x2FFF)].astype(np.int32)
    wide = np.flatnonzero(c >= 0x3000)
    if len(wide):
        k[wide] = [_WIDE.get(x, WIDE) for x in c[wide].tolist()]
    h = k.copy()
    for j in range(1, ORDER):
        h[j:] |= k[:-j] << (BITS * j)
    return h


def language(lang: str | None) -> int:
    base = (lang or "").strip().lower().split("-")[0]
    return LANGS.index(base) if base in LANGS else len(LANGS) - 1


def context_counts(docs: DataFrame, text: str, lang: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: contexts, how often each ends a unit, and how often it occurs, over all texts whole; under FORMULAS, GROUPS and SHAPES what `structure` finds at all places of each of them.

    The last unit of a text is left out, for it may be cut. A task adds up its own texts;
    the driver gets a few ten thousand contexts per language after the second sum.
    """
    size = 1 << (BITS * ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        other: dict[tuple[int, int], list[int]] = {}
        held: dict[int, list] = {}
        chars = dict.fromkeys(range(len(LANGS)), 0)

        def flush(lg: int) -> None:
            got = total.setdefault(lg, np.zeros((2, size), np.int64))
            got[0] += np.bincount(np.concatenate([x[0] for x in held[lg]]), minlength=size)
            got[1] += np.bincount(np.concatenate([x[1] for x in held[lg]]), minlength=size)
            held[lg], chars[lg] = [], 0

        for b in batches:
            for t, name in zip(b.column(0), b.column(1).to_pylist()):
                s, lg = t.as_py(), language(name)
                ends = [m.start() for m in UNIT_END.finditer(s)]
                if not ends:
                    continue
                for what, value, e, n in structure(s, ends):
                    got = other.setdefault((what, value), [0, 0])
                    got[0] += e
                    got[1] += n
                h = contexts(s[: ends[-1]])
                at = np.array([e - 1 if s[e - 1] not in " \t\r" else len(s[:e].rstrip(" \t\r")) - 1 for e in ends])
                at = at[at >= 0]
                at = at[h[at] & ((1 << BITS) - 1) != 4]
                held.setdefault(lg, []).append((h[at], h))
                chars[lg] += len(h)
                if chars[lg] > BLOCK_CHARS:
                    flush(lg)
        for lg in [k for k, v in held.items() if v]:
            flush(lg)
        if other:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in other], pa.int64()), pa.array([k[1] for k in other], pa.int64()), pa.array([v[0] for v in other.values()], pa.int64()), pa.array([v[1] for v in other.values()], pa.int64())], names=["lang", "ctx", "ends", "n"])
        for lg, v in total.items():
            i = np.flatnonzero(v[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), lg, np.int64)), pa.array(i), pa.array(v[0][i]), pa.array(v[1][i])], names=["lang", "ctx", "ends", "n"])

    schema = "lang bigint, ctx bigint, ends bigint, n bigint"
    rows = docs.filter(F.length(text) > 0).select(text, lang).mapInArrow(run, schema).groupBy("lang", "ctx").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    got = rows.orderBy("lang", "ctx").toArrow().to_pandas()
    return {int(lg): (g.ctx.to_numpy(), g.ends.to_numpy(), g.n.to_numpy()) for lg, g in got.groupby("lang")}


class EndModel:
    """Log-odds that a text may end where it does.

    Contexts give the probability that a unit ends behind them: longer contexts correct
    shorter ones by their counts, and a language all languages. An open formula or
    group, and the shape of the end of a bibliography entry, add how much rarer or more
    frequent they are at ends of units than elsewhere in the corpus. The threshold of a
    language is what all but `quantile` of its unit ends reach by their contexts.
    """

    def __init__(self, counts: dict, quantile: float):
        size = 1 << (BITS * ORDER)
        every = np.zeros((2, size))
        self.odds: list[np.ndarray] = []
        for lg, (i, e, n) in counts.items():
            if lg < FORMULAS:
                every[0][i] += e
                every[1][i] += n
        self.thresholds = np.full(len(LANGS), -np.inf)
        for lg in range(len(LANGS)):
            own = 0.1 * every
            if lg in counts:
                i, e, n = counts[lg]
                own[0][i] += e
                own[1][i] += n
            p = np.full(size, 0.01)
            for k in range(1, ORDER + 1):
                low = size >> (BITS * (ORDER - k))
                e, n = (own[j].reshape(-1, low).sum(axis=0) for j in (0, 1))
                p = (np.tile(e, size // low) + 3 * p) / (np.tile(n, size // low) + 3)
            odds = np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))
            order = np.argsort(odds)
            weight = own[0][order].cumsum()
            if weight[-1] > 0:
                self.thresholds[lg] = odds[order][np.searchsorted(weight, quantile * weight[-1])]
            self.odds.append(odds.astype(np.float32))
        self.open = [self._ratio(counts, what).get(1, -4.0) for what in (FORMULAS, GROUPS)]
        self.shapes = self._ratio(counts, SHAPES)

    @staticmethod
    def _ratio(counts: dict, what: int) -> dict[int, float]:
        """Log of how much more frequent each value is at ends than elsewhere, shrunk to 0 by half an end and as many other places as there are to half an end."""
        if what not in counts:
            return {}
        i, e, n = counts[what]
        per_end = max(n.sum(), 1) / max(e.sum(), 1)
        return dict(zip(i.tolist(), np.log((e + 0.5) / (n / per_end + 0.5)).tolist()))

    def structure(self, s: str) -> float:
        formula, group = open_parts(s)
        out = self.open[0] * formula + self.open[1] * group
        shape = entry_shape(s)
        if shape is not None:
            # unknown shapes tell nothing, but for a range of pages that descends
            out += min(self.shapes.get(xxhash.xxh64_intdigest(shape) >> 1, 0.0), -4.0 if shape[-1] == ">" else np.inf)
        return float(out)

    def __call__(self, s: str, lang: int) -> float:
        return float(self.odds[lang][contexts(s[-ORDER:])[-1]]) + self.structure(s)


_WRITTEN_DOTS = re.compile(r"\\(?:l?dots)(?:\{\})?$")


def judge(text: str, lang: int, model: EndModel) -> tuple[bool, float]:
    """Whether the text is cut off, and the log-odds of its end."""
    s, marked, closed = clean_tail(text)
    if not s or len(s) < STUB_CHARS and not marked and not closed:
        return False, 0.0
    # dots that the author wrote may end a text anywhere: contexts tell nothing then
    written = _WRITTEN_DOTS.search(s, max(0, len(s) - 12)) or s[-6:].lower() == "etc..."
    odds = max(model.thresholds[lang], 0.0) + model.structure(s) if written else model(s, lang)
    return bool(odds < model.thresholds[lang]), float(odds)


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", quantile: float = 0.002) -> DataFrame:
    """(key, source, cut, log_odds) of every row.

    A backward character model gives, per language, the odds that a text may end where
    it does: the classes of the last 4 characters are compared with those before all
    unit ends and all other places of the corpus. The threshold of a language is the
    log-odds that all but `quantile` of its unit ends reach. Marks of a cut, comments and
    closing commands behind the end are taken off first. An open formula, table or brace
    group and the way a bibliography entry ends count by their log-odds in the corpus. Null, empty and blank texts and stubs
    are no cases. Rows keep their number; other columns are dropped.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    counts = context_counts(rows, "_text", "_lang")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = EndModel(counts, quantile)
        for b in batches:
            got = [judge(t, language(lg), model) if t and t.strip() else (False, None) for t, lg in zip(map(lambda x: x.as_py(), b.column(1)), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.float64())], names=[key, "source", "cut", "log_odds"])

    return rows.select("_key", "_text", "_lang", "_source").mapInArrow(run, f"`{key}` {kind}, source string, cut boolean, log_odds double")


def rates(judged: DataFrame) -> DataFrame:
    """(source, texts, cut, rate); a null source is a source of its own."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut")).withColumn("rate", F.col("cut") / F.col("texts"))
