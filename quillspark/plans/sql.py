"""DuckDB expressions that mirror the Column functions, to write oracle SQL with."""

from __future__ import annotations

from ..functions.text import KEYWORDS, spaced

WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def normalized(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[{WS}]+', ' ', 'g'))"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {quoted(spaced(pattern, WS))}, {group})"


def pieces(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def masked(x: str) -> str:
    """Letters beyond ASCII made underscores, so that a word boundary counts them as letters."""
    return f"regexp_replace({x}, '[\\x{{aa}}\\x{{b5}}\\x{{ba}}\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{2ff}}\\x{{370}}-\\x{{1fff}}\\x{{ff10}}-\\x{{ff19}}\\x{{ff21}}-\\x{{ff3a}}\\x{{ff41}}-\\x{{ff5a}}]', '_', 'g')"


def kept(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {trimmed('p')}), lambda p: p <> '')"


def paragraphs(x: str) -> str:
    parts = kept(f"string_split_regex({x}, '\\n[{WS}]*\\n')")
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{x}] END"


def chunks(x: str, marks: str) -> str:
    return kept(f"string_split_regex(regexp_replace({x}, '([{marks}])[{WS}]+', '\\1' || chr(10), 'g'), '\\n+')")


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def trigram_list(n: str) -> str:
    c = f"string_split({n}, '')"
    return f"CASE WHEN length({n}) >= 3 THEN list_distinct(list_transform(range(1, length({n}) - 1), lambda i: list_element({c}, i) || list_element({c}, i + 1) || list_element({c}, i + 2))) WHEN {n} = '' THEN [] ELSE [{n}] END"


def category(x: str, money: str, date: str) -> str:
    n = normalized(x)
    whens = " ".join(f"WHEN {contains_any(n, words)} THEN {quoted(name)}" for name, words in KEYWORDS.items())
    return f"CASE {whens} WHEN regexp_matches({n}, {quoted(money)}) THEN 'payment' WHEN regexp_matches({n}, {quoted(date)}) THEN 'effective_date' ELSE 'general' END"


def decimal_text(x: str) -> str:
    y = f"regexp_replace({x}, '[ _]', '', 'g')"
    both = f"(contains({y}, ',') AND contains({y}, '.'))"
    comma = f"(instr(reverse({y}), ',') < instr(reverse({y}), '.'))"
    z = f"CASE WHEN {both} AND {comma} THEN replace(replace({y}, '.', ''), ',', '.') WHEN {both} THEN replace({y}, ',', '') ELSE replace({y}, ',', '.') END"
    return f"CASE WHEN regexp_full_match({z}, '\\d+(\\.\\d+)?') THEN regexp_replace({z}, '^0+([0-9])', '\\1') END"


def distinct_sorted(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def amounts(x: str, pattern: str) -> str:
    return distinct_sorted(f"list_filter(list_transform({every(x, pattern, 1)}, lambda v: {decimal_text('v')}), lambda v: v IS NOT NULL)")


def joined(x: str, sep: str = "|") -> str:
    """A list as text, so that both engines hash it alike; null for null."""
    return f"array_to_string({x}, {quoted(sep)})"
