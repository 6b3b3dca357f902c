"""Scalar building blocks of the business checks, as SQL expression text."""

from __future__ import annotations

from tamis.functions.text import quote


def words_array(words: list[str]) -> str:
    return f"array({', '.join(quote(w) for w in words)})"


def contains_any(expr: str, words: list[str]) -> str:
    """True when the text holds any of the words; `contains` stays inside generated code."""
    return "(" + " OR ".join(f"contains({expr}, {quote(w)})" for w in words) + ")"


def first_contained(expr: str, words: list[str]) -> str:
    """The first word, in list order, that the text holds; NULL if none."""
    whens = " ".join(f"WHEN contains({expr}, {quote(w)}) THEN {quote(w)}" for w in words)
    return f"(CASE {whens} END)"


def all_contained(expr: str, words: list[str], missing: bool = False) -> str:
    """All words the text holds (or lacks), in list order, joined with ', '."""
    sign = "NOT " if missing else ""
    items = ", ".join(f"if({sign}contains({expr}, {quote(w)}), {quote(w)}, NULL)" for w in words)
    return f"concat_ws(', ', {items})"


def count_contained(expr: str, words: list[str], missing: bool = False) -> str:
    sign = "NOT " if missing else ""
    return "(" + " + ".join(f"if({sign}contains({expr}, {quote(w)}), 1, 0)" for w in words) + ")"


class WordBits:
    """The words that a model's checks look for in one text. A row's text is searched once for each word, whatever the number of
    checks and messages that name it; the result is a number, shared by the checks as ``$:name``, with a bit per word."""

    def __init__(self, name: str, text: str, *lists: list[str] | tuple[str, ...]):
        words = list(dict.fromkeys(w for ws in lists for w in ws))
        if len(words) > 62:
            raise ValueError(f"{len(words)} words do not fit into the bits of one number; use several sets")
        self.ref = f"$:{name}"
        self.bits = {w: 1 << (len(words) - 1 - i) for i, w in enumerate(words)}
        # the text is bound by a lambda, so that its expression is evaluated once
        search = f"aggregate({words_array(words)}, 0L, (m, w) -> 2L * m + if(contains(t, w), 1L, 0L))"
        self.let = {name: f"transform(array({text}), t -> {search})[0]"}

    def _test(self, words: list[str] | tuple[str, ...]) -> str:
        return f"({self.ref} & {sum({self.bits[w] for w in words})}L) != 0"

    def any(self, words: list[str] | tuple[str, ...]) -> str:
        """True when the text holds any of the words."""
        return f"({self._test(words)})"

    def first(self, words: list[str] | tuple[str, ...]) -> str:
        """The first word, in list order, that the text holds; NULL if none."""
        return f"(CASE {' '.join(f'WHEN {self._test([w])} THEN {quote(w)}' for w in words)} END)"

    def all(self, words: list[str] | tuple[str, ...], missing: bool = False) -> str:
        """All words the text holds (or lacks), in list order, joined with ', '."""
        sign = "NOT " if missing else ""
        return f"concat_ws(', ', {', '.join(f'if({sign}({self._test([w])}), {quote(w)}, NULL)' for w in words)})"

    def count(self, words: list[str] | tuple[str, ...], missing: bool = False) -> str:
        held = f"bit_count({self.ref} & {sum({self.bits[w] for w in words})}L)"
        return f"({len(set(words))} - {held})" if missing else held


def occurrences(expr: str, word: str) -> str:
    """Non-overlapping occurrences of a literal word."""
    return f"((char_length({expr}) - char_length(replace({expr}, {quote(word)}, ''))) div {len(word)})"


def word_count(expr: str) -> str:
    """Words separated by Unicode blanks."""
    # fixed values: the blank characters that separate words
    blanks = r"[\\t\\n\\x0B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
    return f"size(filter(split({expr}, '{blanks}'), w -> w != ''))"


def has_prefix(expr: str, prefix: str) -> str:
    return f"startswith(lower({expr}), {quote(prefix)})"


def media_type(expr: str) -> str:
    """The part before the first ';', trimmed."""
    return f"trim(BOTH ' \\t\\n\\r' FROM split_part({expr}, ';', 1))"


def seconds_between(earlier: str, later: str) -> str:
    """Elapsed seconds; saturates like a 64-bit nanosecond counter (about 292 years)."""
    return f"least((unix_micros({later}) - unix_micros({earlier})) / 1000000D, 9223372036.854776D)"


def hours_between(earlier: str, later: str) -> str:
    return f"({seconds_between(earlier, later)} / 3600D)"


def ratio(part: str, whole: str) -> str:
    """Floating-point ratio; NULL when the whole is zero."""
    return f"try_divide(cast({part} AS DOUBLE), cast({whole} AS DOUBLE))"


def has_key(expr: str, key: str) -> str:
    return f"coalesce(map_contains_key({expr}, {quote(key)}), false)"


def sorted_keys(expr: str) -> str:
    return f"array_sort(coalesce(map_keys({expr}), cast(array() AS ARRAY<STRING>)))"


def duration_text(ns: str) -> str:
    """Nanoseconds as text such as ``6s``, ``1m30.5s``, ``250ms``, ``2h0m0s``."""
    a = f"abs({ns})"
    sign = f"if({ns} < 0, '-', '')"

    def scaled(value: str, unit: str) -> str:
        # at most nine decimals, without trailing zeros
        number = f"regexp_replace(cast(cast({value} AS DECIMAL(28, 9)) AS STRING), '[.]?0+$', '')"
        return f"concat({number}, '{unit}')"

    secs = scaled(f"cast({a} % 60000000000L AS DECIMAL(20, 0)) / 1000000000", "s")
    secs = f"if({a} % 60000000000L = 0, '0s', {secs})"
    mins = f"concat(({a} div 60000000000L) % 60, 'm', {secs})"
    return (
        f"CASE WHEN {ns} = 0 THEN '0s'"
        f" WHEN {a} < 1000L THEN concat({ns}, 'ns')"
        f" WHEN {a} < 1000000L THEN concat({sign}, " + scaled(f"cast({a} AS DECIMAL(20, 0)) / 1000", "µs") + ")"
        f" WHEN {a} < 1000000000L THEN concat({sign}, " + scaled(f"cast({a} AS DECIMAL(20, 0)) / 1000000", "ms") + ")"
        f" WHEN {a} < 60000000000L THEN concat({sign}, {secs})"
        f" WHEN {a} < 3600000000000L THEN concat({sign}, {mins})"
        f" ELSE concat({sign}, {a} div 3600000000000L, 'h', {mins}) END"
    )


def number_text(expr: str) -> str:
    """A JSON number as text: plain up to six integer digits, otherwise with an exponent (``1.5e+06``)."""
    s = f"cast(abs(cast({expr} AS DOUBLE)) AS STRING)"  # shortest form: 123.45 or 1.2345E7
    mantissa = f"split_part({s}, 'E', 1)"
    digits = f"regexp_replace(regexp_replace(replace({mantissa}, '.', ''), '^0+', ''), '0+$', '')"
    exponent = f"cast(floor(log10(abs(cast({expr} AS DOUBLE)))) AS INT)"
    sign = f"if(cast({expr} AS DOUBLE) < 0, '-', '')"
    tail = f"if(char_length({digits}) > 1, concat('.', substr({digits}, 2)), '')"
    power = f"concat('e', if({exponent} < 0, '-', '+'), lpad(cast(abs({exponent}) AS STRING), 2, '0'))"
    plain = f"regexp_replace(cast(try_cast({expr} AS DECIMAL(38, 18)) AS STRING), '[.]?0+$', '')"
    return (
        f"CASE WHEN cast({expr} AS DOUBLE) = 0 THEN '0'"
        f" WHEN {exponent} < -4 OR {exponent} >= 6 THEN concat({sign}, substr({digits}, 1, 1), {tail}, {power})"
        f" ELSE {plain} END"
    )


def json_text_sql(v: str) -> str:
    """A VARIANT value as text: strings as they are, numbers as in ``number_text``, the rest as JSON."""
    kind = f"schema_of_variant({v})"
    return (
        f"CASE WHEN {v} IS NULL THEN NULL"
        f" WHEN {kind} = 'STRING' THEN try_variant_get({v}, '$', 'string')"
        f" WHEN {kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL')"
        f" THEN {number_text(f"try_variant_get({v}, '$', 'double')")}"
        f" ELSE to_json({v}) END"
    )
