"""Pieces of SQL that the twins of several queries share, in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Iterable

from mnemospark.functions import lexicon as L

TEXTS = "t AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id)"
TURNS = """turns AS (SELECT chunk_id, any_value(text) AS text, any_value(timestamp) AS ts, any_value(conversation_id) AS conversation_id FROM chunks
  WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND timestamp IS NOT NULL AND coalesce(conversation_id, '') <> '' GROUP BY chunk_id)"""


def quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


def padded(c: str) -> str:
    return f"(' ' || array_to_string({tokens(c)}, ' ') || ' ')"


def any_of(p: str, phrases: Iterable[str]) -> str:
    return "(CASE WHEN " + " OR ".join(f"contains({p}, ' {x} ')" for x in phrases) + " THEN 1 ELSE 0 END)"


def count_of(c: str, terms: Iterable[str], phrases: Iterable[str] = ()) -> str:
    out = f"len(list_filter({tokens(c)}, lambda w: w IN ({quoted(terms)})))"
    for p in phrases:
        out += f" + CAST((length({padded(c)}) - length(replace({padded(c)}, ' {p} ', ' '))) / {len(p) + 1} AS INTEGER)"
    return f"({out})"


def proper(c: str) -> str:
    """Every character that ends a word is doubled, for the pattern uses one up on each side."""
    return rf"regexp_extract_all(regexp_replace({c}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:$|[^\p{{L}}\p{{N}}_])', 1)"


def sentences(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def numbers(c: str) -> str:
    """Numbers with decimals and units. RE2 looks at nothing behind a match, so a unit takes what follows with it, which is cut off again."""
    found = rf"regexp_extract_all({c}, '(?:^|[^A-Za-z0-9_.])([0-9]+(?:\.[0-9]+)?(?:\s?(?:percent|%|ms|MB|GB|TB|k|M|B)(?:$|[^A-Za-z0-9_]))?)', 1)"
    return rf"list_transform({found}, lambda x: regexp_replace(x, '(percent|%|ms|MB|GB|TB|k|M|B)[^A-Za-z0-9_]$', '\1'))"


def distinctive(c: str) -> str:
    whole = rf"list_filter(regexp_split_to_array({c}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '' AND (regexp_full_match(w, '[A-Z]{{2,}}') OR regexp_full_match(w, '[a-z]+(?:_[a-z]+)+') OR regexp_full_match(w, '[a-z]+(?:[A-Z][a-z]+)+') OR lower(w) IN ({quoted(L.TECH_WORDS)})))"
    return rf"list_sort(list_distinct(list_transform(list_concat(list_concat({proper(c)}, {numbers(c)}), {whole}), lambda w: lower(regexp_replace(w, '\s+', ' ', 'g')))))"
