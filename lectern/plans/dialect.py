"""The engine's text expressions in the SQL of a second engine, for comparison. Its patterns are RE2: no lookaround, and
classes are ASCII, so Unicode ones are spelled out."""

from __future__ import annotations

SPACE = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def replaced(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', {by}, 'g')"


def strip(c: str) -> str:
    return replaced(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "''")


def sanitize(c: str) -> str:
    c = replaced(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{ad}\x{200b}-\x{200f}\x{feff}\x{a0}]", "''")
    c = replaced(c, r"\r\n|[\r\x{85}\x{2028}\x{2029}]", "chr(10)")
    # no lookahead: the line break is part of the match and put back
    c = replaced(c, r"[\t \x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+\n", "chr(10)")
    c = replaced(c, r"[\t \x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+\z", "''")
    return strip(replaced(c, r"\n{4,}", "chr(10) || chr(10) || chr(10)"))


def normalize(c: str) -> str:
    marks = "‘’‚“”„–—― "
    return f"replace(replace(translate(nfc_normalize({c}), '{marks}', '''''''\"\"\"--- '), '﻿', ''), '…', '...')"


def base_name(c: str) -> str:
    name = f"regexp_extract({replaced(c, '/+$', chr(39) * 2)}, '[^/]*$')"
    return f"CASE WHEN {name} = '' THEN 'unknown' ELSE {name} END"


def whole(c: str) -> str:
    return f"coalesce(CASE WHEN regexp_full_match({strip(c)}, '[+-]?[0-9]+') THEN TRY_CAST({strip(c)} AS INTEGER) END, 0)"


def enriched(names: str) -> str:
    words = f"len(regexp_extract_all(t, '[^{SPACE}]+'))"
    ratio = f"(length(t)::DOUBLE / greatest({words}, 1))"
    made = {
        "word_count": f"{words}::INTEGER",
        "char_count": "length(t)::INTEGER",
        "estimated_read_time_seconds": f"greatest(1, round_even({words} / 4.0, 0))::INTEGER",
        "has_numbers": r"regexp_matches(t, '\p{Nd}{3,}')",
        "has_tables": rf"regexp_matches(t, '\|[{SPACE}\-]+\|')",
        "content_density": f"CASE WHEN {words} = 0 OR {ratio} < 4 THEN 'sparse' WHEN {ratio} > 8 THEN 'dense' ELSE 'normal' END",
    }
    return ", ".join(f"{made[n]} AS {n}" for n in names.split(", "))


def redacted(source: str, patterns: list[tuple[str, str, str]]) -> str:
    """``WITH``-clauses ending in ``redacted(id, t, pii_count, pii_entities)``."""
    steps, before = [f"WITH r0 AS (SELECT id, t, 0 AS n, [] :: VARCHAR[] AS found FROM ({source}))"], "r0"
    for k, (label, pattern, placeholder) in enumerate(patterns, 1):
        p = pattern.replace("(?iuU)", "(?i)").replace("(?U)", "").replace("[^\\s", f"[^{SPACE}").replace("[\\s", f"[{SPACE}").replace("\\s+", f"[{SPACE}]+").replace("\\s*", f"[{SPACE}]*").replace("'", "''")
        hits = f"coalesce(len(regexp_extract_all(t, '{p}')), 0)"
        steps.append(f"r{k} AS (SELECT id, regexp_replace(t, '{p}', '{placeholder}', 'g') AS t, n + {hits} AS n, CASE WHEN {hits} > 0 THEN list_append(found, '{label}') ELSE found END AS found FROM {before})")
        before = f"r{k}"
    steps.append(f"redacted AS (SELECT id, t, n::INTEGER AS pii_count, array_to_string(found, ',') AS pii_entities FROM {before})")
    return ", ".join(steps)


def clean(c: str) -> str:
    word = r"[\p{L}\p{M}\p{N}\p{Pc}\x{200c}\x{200d}]"
    tokens = f"regexp_extract_all({c}, '{word}+|[^{word[1:-1]}]+')"
    joined = f"array_to_string(list_transform({tokens}, lambda x, i: CASE WHEN x = ' ' AND i > 1 AND i < len({tokens}) AND length({tokens}[i - 1]) = 1 AND length({tokens}[i + 1]) = 1 THEN '' ELSE x END), '')"
    joined = f"CASE WHEN {c} IS NOT NULL THEN {joined} END"
    return strip(replaced(replaced(joined, r"\n{3,}", "chr(10) || chr(10)"), r"[ \t]{2,}", "' '"))


def tidy(c: str) -> str:
    return strip(replaced(replaced(strip(c), r"[ \t]{2,}", "' '"), r"\n{3,}", "chr(10) || chr(10)"))
