"""Rule predicates: for each rule name, SQL text that is true when a value breaks the rule.

Every function takes the zero-filled value expression, the field kind and the rule parameter. Java's
``$`` also matches before a final line feed, so patterns end in ``\\z``.
"""

from __future__ import annotations

from collections.abc import Callable

from tamis.functions.text import count_of, quote

# Kinds whose size is the number of elements, and kinds measured in code points.
COLLECTIONS = {"texts", "values", "records", "text_map", "value_map"}
TEXTUAL = {"text"}

# ---- fixed values: patterns that decide whether a text is well formed -------------------------
PATTERNS = {
    "hexadecimal": r"^(0[xX])?[0-9a-fA-F]+\z",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "numeric": r"^[-+]?[0-9]+(\.[0-9]+)?\z",
    "alpha": r"^[a-zA-Z]+\z",
    "alphanum": r"^[a-zA-Z0-9]+\z",
    # a letter first, no empty part, alphanumeric last
    "hostname": r"^[a-zA-Z](?!\.)(?![a-zA-Z0-9.-]*\.\.)[a-zA-Z0-9.-]*[a-zA-Z0-9]\z",
    "hexcolor": r"^#?[0-9a-fA-F]{6}\z",
    "github_username": r"^(?=.{1,39}\z)(?!.*--)[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\z",
    # MAJOR.MINOR.PATCH[-PRERELEASE][+BUILD]; no empty identifiers, no leading zeros
    "semver": (
        r"^(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)"
        r"(?:-(?!\.)(?![0-9A-Za-z.-]*\.(?:\.|\+|\z))(?!(?:[0-9A-Za-z.-]*\.)?0\d+(?:\.|\+|\z))[0-9A-Za-z.-]+)?"
        r"(?:\+(?!\.)(?![0-9A-Za-z.-]*\.(?:\.|\z))[0-9A-Za-z.-]+)?\z"
    ),
    "loose_semver": (
        r"^[0-9]+\.[0-9]+\.[0-9]+"
        r"(?:-(?!\.)(?![0-9A-Za-z.-]*\.(?:\.|\+|\z))[0-9A-Za-z.-]+)?"
        r"(?:\+(?!\.)(?![0-9A-Za-z.-]*\.(?:\.|\z))[0-9A-Za-z.-]+)?\z"
    ),
    "deployment_name": r"^[a-zA-Z][a-zA-Z0-9-]*[a-zA-Z0-9]\z",
    "hostname_rfc1123": r"^(?!.*[.-]\.)(?!.*\.-)[a-zA-Z0-9](?:[a-zA-Z0-9.-]*[a-zA-Z0-9])?\z",
    # v1, 1.2, 1.2.3, 1.2.3-x, 2023-01-01, 20230101
    "api_version": (
        r"^(v?[0-9]+(\.[0-9]+(\.[0-9]+(-[a-zA-Z0-9.-]+)?)?)?|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})\z"
    ),
    "media_type": r"^[a-zA-Z][a-zA-Z0-9][a-zA-Z0-9!#$&^-]*/[a-zA-Z0-9][a-zA-Z0-9!#$&^-]*\z",
    "incident_id": r"^INC-\d{8}-\d{4}\z",
}
# fixed values: media types that need no pattern
MEDIA_TYPES = (
    "application/json", "application/xml", "application/x-www-form-urlencoded", "multipart/form-data", "text/plain",
    "text/html", "text/csv", "application/pdf", "application/octet-stream", "image/jpeg", "image/png", "image/gif",
    "video/mp4", "audio/mpeg",
)
# fixed values: named priority levels
PRIORITY_LEVELS = ("low", "normal", "high", "urgent", "critical")
# fixed values: texts that read as a truth value
BOOLEAN_TEXTS = ("1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False")

# ---- formats built from parts ------------------------------------------------------------------
# Repetition is written over character classes only, never over groups, because Java's matcher
# recurses once per repeated group and a long text would overflow the task's stack.
_HEX = "[0-9a-fA-F]"
_HOST_CLASS = r"a-zA-Z0-9_.~!$&'()*+,;=\[\]<>\"%\x{80}-\x{10FFFF}-"
_HOST = rf"(?:\[[{_HOST_CLASS}:]*\](?::[0-9]*)?|(?!\[)[{_HOST_CLASS}:]*:[0-9]*|(?!\[)[{_HOST_CLASS}]+)"
_USERINFO = r"(?:[a-zA-Z0-9._:~!$&'()*+,;=@%-]*@)?"
_NO_CONTROL = r"\x00-\x1F\x7F"
_QUERY = rf"(?:\?[^#{_NO_CONTROL}]*+)?"
_BAD_ESCAPE = rf"%(?!{_HEX}{{2}})"
_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*+:"

# A plain web address is by far the most common value and comes first.
_PLAIN = r"https?://[a-zA-Z0-9.-]+(?::[0-9]+)?(?:/[a-zA-Z0-9._~/-]*+)?"
# scheme://authority/path?query#fragment with a host, every escape outside the query well formed
_WITH_HOST = (
    rf"(?!{_SCHEME}//[^?#]*{_BAD_ESCAPE})(?!{_SCHEME}//(?:[^/?#]*@)?[^/?#@]*%(?!25|[89a-fA-F]))"
    rf"{_SCHEME}//{_USERINFO}{_HOST}(?:/[^?#{_NO_CONTROL}]*+)?{_QUERY}(?:#[\s\S]*+)?"
)
# scheme:opaque, such as mailto:a@b.c
_OPAQUE = rf"{_SCHEME}[^/?#{_NO_CONTROL}][^?#{_NO_CONTROL}]*+{_QUERY}(?:#[\s\S]*+)?"
# neither host nor opaque part: only a non-empty fragment makes it a URL
_FRAGMENT_ONLY = (
    rf"(?!{_SCHEME}[^?#]*{_BAD_ESCAPE})"
    rf"{_SCHEME}(?://{_USERINFO})?(?:/(?!/)[^?#{_NO_CONTROL}]*+)?{_QUERY}#[\s\S]++"
)
_FILE = (
    rf"(?![^?]*{_BAD_ESCAPE})(?i:file):(?=/)(?://{_USERINFO}{_HOST}?)?"
    rf"(?:/[^?{_NO_CONTROL}]*+)?(?:\?[^{_NO_CONTROL}]*+)?"
)
URL_PATTERN = (
    rf"^(?:{_PLAIN}|(?![^#]*#[\s\S]*{_BAD_ESCAPE})(?:{_WITH_HOST}|{_OPAQUE}|{_FRAGMENT_ONLY})|{_FILE})\z"
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^(?:{_OCTET}\.){{3}}{_OCTET}\z"


def _ipv6_pattern() -> str:
    group = "[0-9a-fA-F]{1,4}"
    dotted = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{dotted}"]
    for before in range(8):  # '::' after `before` groups stands for at least one group of zeros
        head = rf"{group}(?::{group}){{{before - 1}}}" if before else ""
        tails = []
        if before <= 6:
            tails.append(rf"(?:{group}:){{0,{6 - before}}}{group}")
        if before <= 5:
            tails.append(rf"(?:{group}:){{0,{5 - before}}}{dotted}")
        forms.append(f"{head}::(?:{'|'.join(tails)})?" if tails else f"{head}::")
    return "^(?:" + "|".join(forms) + r")\z"


IPV6_PATTERN = _ipv6_pattern()

_WIDE = r"\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}"
_ATEXT = rf"a-zA-Z0-9!#$%&'*+/=?^_`{{|}}~{_WIDE}"
_ALNUM = rf"[a-zA-Z0-9{_WIDE}]"
_LETTER = rf"[a-zA-Z{_WIDE}]"
_INNER = rf"[a-zA-Z0-9.~{_WIDE}-]"
# in quotes, most characters may stand as they are, others behind a backslash; a line break only before a blank (the group is
# possessive, which the matcher repeats in a loop)
_QUOTED = rf"\"(?:[\x01-\x09\x0B\x0C\x0E-\x21\x23-\x5B\x5D-\x7F{_WIDE}]|\\[\x01-\x09\x0B-\x7F{_WIDE}]|\r\n(?=[ \t]))*+\""
EMAIL_PATTERN = (
    rf"^(?:(?!\.)(?![^@]*\.[.@])[{_ATEXT}.-]+|{_QUOTED})@"
    rf"{_ALNUM}(?:{_INNER}*{_ALNUM})?\.{_LETTER}(?:{_INNER}*{_LETTER})?\z"
)


def matches(expr: str, pattern: str) -> str:
    return f"{expr} RLIKE {quote(pattern)}"


def mismatch(pattern: str) -> Callable[[str, str, object], str]:
    return lambda v, kind, param: f"NOT ({matches(v, pattern)})"


def magnitude(v: str, kind: str) -> str:
    if kind in TEXTUAL:
        return f"char_length({v})"
    if kind in COLLECTIONS:
        return count_of(v)
    return v


def _compare(op: str) -> Callable[[str, str, object], str]:
    def broken(v: str, kind: str, param: object) -> str:
        test = f"{magnitude(v, kind)} {op} {param}"
        if kind in TEXTUAL and op != "!=":
            # a code point takes one to four bytes: characters are counted only where the number of bytes, which is known, leaves it open
            least = f"octet_length({v}) {op} {param}" if op == ">" else f"octet_length({v}) {op} 4 * {param}"
            return f"({least} AND {test})"
        return test

    return broken


def one_of(v: str, kind: str, param: object) -> str:
    return f"{v} NOT IN ({', '.join(quote(w) for w in str(param).split())})"


def not_ip(v: str, kind: str, param: object) -> str:
    return f"NOT ({matches(v, IPV4_PATTERN)} OR {matches(v, IPV6_PATTERN)})"


def not_boolean(v: str, kind: str, param: object) -> str:
    if kind == "flag":
        return "false"
    return f"{v} NOT IN ({', '.join(quote(w) for w in BOOLEAN_TEXTS)})"


def not_deployment_name(v: str, kind: str, param: object) -> str:
    return f"NOT ({matches(v, PATTERNS['deployment_name'])} OR octet_length({v}) = 1)"


def not_priority_level(v: str, kind: str, param: object) -> str:
    names = ", ".join(quote(w) for w in PRIORITY_LEVELS)
    return f"NOT ({v} = '' OR lower({v}) IN ({names}) OR {matches(v, '^[1-5]' + chr(92) + 'z')})"


def not_content_type(v: str, kind: str, param: object) -> str:
    names = ", ".join(quote(w) for w in MEDIA_TYPES)
    main = f"trim(BOTH ' \\t\\n\\r' FROM split_part({v}, ';', 1))"
    return f"NOT ({v} = '' OR {v} IN ({names}) OR (contains({v}, ';') AND {main} IN ({names})) OR {matches(v, PATTERNS['media_type'])})"


def not_api_version(v: str, kind: str, param: object) -> str:
    return f"NOT ({v} = '' OR {matches(v, PATTERNS['api_version'])})"


def not_semver(v: str, kind: str, param: object) -> str:
    return f"NOT ({v} = '' OR {matches(v, PATTERNS['semver'])})"


def not_hostname_rfc1123(v: str, kind: str, param: object) -> str:
    return f"NOT (octet_length({v}) BETWEEN 1 AND 253 AND {matches(v, PATTERNS['hostname_rfc1123'])})"


# Rules by name. `required`, `required_if` and `gtefield` need the field's siblings and are compiled
# in plans/compiler.py.
RULES: dict[str, Callable[[str, str, object], str]] = {
    "min": _compare("<"),
    "max": _compare(">"),
    "len": _compare("!="),
    "gt": _compare("<="),
    "gte": _compare("<"),
    "lte": _compare(">"),
    "eq": _compare("!="),
    "oneof": one_of,
    "url": mismatch(URL_PATTERN),
    "email": mismatch(EMAIL_PATTERN),
    "ip": not_ip,
    "hostname": mismatch(PATTERNS["hostname"]),
    "hexadecimal": mismatch(PATTERNS["hexadecimal"]),
    "boolean": not_boolean,
    "uuid": mismatch(PATTERNS["uuid"]),
    "numeric": mismatch(PATTERNS["numeric"]),
    "alpha": mismatch(PATTERNS["alpha"]),
    "alphanum": mismatch(PATTERNS["alphanum"]),
    "semver": not_semver,
    "loose_semver": mismatch(PATTERNS["loose_semver"]),
    "deployment_name": not_deployment_name,
    "priority_level": not_priority_level,
    "api_content_type": not_content_type,
    "api_version": not_api_version,
    "hostname_rfc1123": not_hostname_rfc1123,
    "github_username": mismatch(PATTERNS["github_username"]),
    "hexcolor": mismatch(PATTERNS["hexcolor"]),
}


def register_rule(name: str, breaks: str | Callable[[str, str, object], str]) -> None:
    """Add a named rule.

    ``breaks`` is SQL text that is true for a bad value, with ``{value}`` and ``{param}`` as place
    holders, or a function returning such text. A registered (pandas) UDF may be called in the text
    when built-in functions cannot express the rule.
    """
    if isinstance(breaks, str):
        text = breaks
        breaks = lambda v, kind, param: "(" + text.replace("{value}", v).replace("{param}", str(param)) + ")"
    RULES[name] = breaks


def breaks(name: str, value: str, kind: str = "text", param: object = None) -> str:
    """SQL text that is true when ``value`` breaks the named rule."""
    if name not in RULES:
        raise KeyError(f"unknown rule '{name}'; add it with register_rule")
    return RULES[name](value, kind, param)
