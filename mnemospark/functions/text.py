"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import lexicon as L

WORD_BREAK = r"[^\p{L}\p{N}_]+"
NUMBER_WITH_UNIT = r"(?:^|[^A-Za-z0-9_.])([0-9]+(?:\.[0-9]+)?(?:\s?(?:percent|%|ms|MB|GB|TB|k|M|B)(?![A-Za-z0-9_]))?)"
# Repeated groups are possessive, for Java recurses once per repetition of others: a name of thousands of parts overflows its stack.
PROPER_NOUN = r"(?<![\p{L}\p{N}_])([A-Z][a-z]++(?![\p{L}\p{N}_])(?:\s++[A-Z][a-z]++(?![\p{L}\p{N}_]))*+)"
SNAKE_CASE = r"^[a-z]++(?:_[a-z]++)++$"
CAMEL_CASE = r"^[a-z]++(?:[A-Z][a-z]++)++$"


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def count_of(toks: Column, terms: Iterable[str], phrases: Iterable[str] = ()) -> Column:
    """How many tokens are one of the terms, plus occurrences of the phrases."""
    total = F.size(F.filter(toks, lambda t: t.isin(list(terms))))
    padded = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    for p in phrases:
        total = total + ((F.length(padded) - F.length(F.replace(padded, F.lit(f" {p} "), F.lit(" ")))) / (len(p) + 1)).cast("int")
    return total


def has_any(toks: Column, phrases: Iterable[str]) -> Column:
    """Whether one of the words or phrases occurs as a whole."""
    padded = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(padded, F.lit(f" {p} "))
    return out


def proper_nouns(text: Column) -> Column:
    """Runs of capitalised ASCII words, in order of appearance."""
    return F.regexp_extract_all(text, F.lit(PROPER_NOUN), 1)


def token_count(text: Column) -> Column:
    """The heuristic token count: four tokens for three words, one at least."""
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * 4 / 3).cast("int"))


def sentences(text: Column) -> Column:
    """Split behind . ! ? and white space where an ASCII capital follows; blank parts go."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def windows(items: Column, size: int = 3, overlap: int = 1) -> Column:
    """Windows of `size` items that overlap by `overlap`; the last one ends with the last item."""
    step = max(1, size - overlap)
    n = F.size(items)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step) * step).cast("int"), F.lit(step)))
    return F.transform(starts, lambda s: F.array_join(F.slice(items, s + 1, F.lit(size)), " "))


def distinctive_tokens(text: Column) -> Column:
    """Sorted set of what makes a text distinct: proper nouns, numbers with decimals and units, acronyms, snake_case and camelCase names, known technology."""
    whole = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    found = F.concat(
        proper_nouns(text),
        F.regexp_extract_all(text, F.lit(NUMBER_WITH_UNIT), 1),
        F.filter(whole, lambda w: w.rlike(r"^[A-Z]{2,}$") | w.rlike(SNAKE_CASE) | w.rlike(CAMEL_CASE) | F.lower(w).isin(L.TECH_WORDS)),
    )
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.lower(F.regexp_replace(w, r"\s+", " ")))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def text_signals(text: Column) -> tuple[Column, Column, Column]:
    """(density, length, low value), each in [0, 1]."""
    toks = tokens(text)
    n = F.greatest(F.size(words(text)), F.lit(1))
    density = F.least(F.lit(1.0), F.size(proper_nouns(text)) / n * 5)
    facts = sum((F.when(has_any(toks, p), 1).otherwise(0) for p in L.FACT_PHRASES), F.lit(0))
    low = sum((F.when(has_any(toks, p), 1).otherwise(0) for p in L.LOW_VALUE_PHRASES), F.lit(0))
    return density * 0.6 + F.least(F.lit(1.0), facts / 3) * 0.4, F.least(F.lit(1.0), n / 15), F.least(F.lit(1.0), low / 2)


def importance(text: Column, novelty: Column) -> Column:
    """0.35 density + 0.30 novelty + 0.15 length + 0.20 (1 - low value), within [0.1, 1]."""
    density, length, low = text_signals(text)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), density * 0.35 + novelty * 0.30 + length * 0.15 + (F.lit(1.0) - low) * 0.20))


def normalize_name(name: Column) -> Column:
    """Without outer space, a final possessive and a leading article; inner space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"'s$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(?:[Tt][Hh][Ee]|[Aa]|[Aa][Nn])\s+", ""), r"\s+", " ")


def behavioral_signals(text: Column) -> dict[str, Column]:
    """One signal in [0, 1] per profile dimension."""
    n = F.size(words(text))
    tech = count_of(tokens(text), L.PROFILE_TECH)
    contractions = F.regexp_count(text, F.lit(r"(?U)\w+'\w+"))
    ends = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    one = F.lit(1.0)
    return {
        "response_depth": F.least(one, n / 200 * 0.5 + tech / 5 * 0.5),
        "formality": F.least(one, F.greatest(F.lit(0.0), n / ends / 25 * 0.5 - contractions / 3 * 0.3 + 0.3)),
        "domain_expertise": F.least(one, tech / F.greatest(n, F.lit(1)) * 10),
        "verbosity_preference": F.least(one, n / 300),
    }


def intent_weights(query: Column) -> dict[str, Column]:
    """Weights of similarity, time, reinforcement and importance from the words of a query; none is negative, they add up to one."""
    t = tokens(query)
    r, p, b = count_of(t, L.RECENCY, L.RECENCY_PHRASES), count_of(t, L.PRECISION, L.PRECISION_PHRASES), count_of(t, L.BREADTH, L.BREADTH_PHRASES)
    up, exact = F.least(F.lit(0.30), r * 0.15), F.least(F.lit(0.15), p * 0.08)
    wide = b > 0
    raw = {
        "similarity": F.when(wide, 0.5).otherwise(F.lit(0.75) - up + exact),
        "temporal": F.when(wide, 0.2).otherwise(F.lit(0.15) + up - exact * 0.5),
        "reinforcement": F.when(wide, 0.15).otherwise(0.05),
        "importance": F.when(wide, 0.15).otherwise(F.greatest(F.lit(0.0), F.lit(0.05) - exact * 0.5)),
    }
    total = raw["similarity"] + raw["temporal"] + raw["reinforcement"] + raw["importance"]
    return {k: v / total for k, v in raw.items()}


def predicate_form(predicate: Column) -> Column:
    """Lower case, trimmed, words joined by an underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(predicate, r"^\s+|\s+$", "")), r"[\s_\-]+", "_")


def status_form(status: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(status, r"^\s+|\s+$", "")), F.lit("active"))
