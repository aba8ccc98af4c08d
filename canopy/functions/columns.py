"""The function library as Column expressions (JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def text(value: Column) -> Column:
    """An empty sequence is an empty string."""
    return F.coalesce(value, F.lit(""))


# --- strings ---


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """XPath substring: 1-based, arguments rounded half up, NaN selects nothing."""
    first = F.floor(start.cast("double") + 0.5)
    if length is None:
        begin = F.greatest(first, F.lit(1).cast("long")).cast("int")
        return F.when(F.isnan(start.cast("double")), "").otherwise(F.substring(text(s), begin, F.char_length(text(s)) + 1))
    end = first + F.floor(length.cast("double") + 0.5)
    begin = F.greatest(first, F.lit(1).cast("long"))
    size = F.greatest(end - begin, F.lit(0).cast("long")).cast("int")
    return F.when(F.isnan(start.cast("double")) | F.isnan(length.cast("double")), "").otherwise(F.substring(text(s), begin.cast("int"), size))


def substring_before(s: Column, needle: Column) -> Column:
    return F.when(F.contains(text(s), needle), F.left(s, F.call_function("locate", needle, s) - 1)).otherwise("")


def substring_after(s: Column, needle: Column) -> Column:
    at = F.call_function("locate", needle, s)
    return F.when(F.contains(text(s), needle), F.call_function("substring", s, at + F.char_length(needle))).otherwise("")


def normalize_space(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(s), "[ \t\r\n]+", " "), "^ | $", "")


def tokenize(s: Column, pattern: str | None = None) -> Column:
    """One argument splits at white space; a pattern keeps empty tokens."""
    if pattern is None:
        return F.filter(F.split(text(s), "[ \t\r\n]+"), lambda x: x != "")
    return F.split(s, translate_regex(pattern))


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


# --- numbers ---


def number(s: Column) -> Column:
    return F.coalesce(s.try_cast("double"), F.lit(NAN))


def xround(x: Column) -> Column:
    """Half towards positive infinity; not-a-number and infinities stay."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(F.floor(x + 0.5).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """div on doubles, with infinities and NaN where SQL has errors or nulls."""
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))


def idiv(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def number_to_string(x: Column) -> Column:
    """No exponent, no fraction for whole numbers, NaN and Infinity by name."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,15)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(x), "NaN").when(x == INF, "Infinity").when(x == -INF, "-Infinity").otherwise(plain)


def sequence(lo: Column, hi: Column) -> Column:
    """``lo to hi``: empty when lo > hi."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


# --- dates ---


def day_in_week(ts: Column) -> Column:
    """Sunday is 1."""
    return F.dayofweek(ts)


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def month_name(ts: Column) -> Column:
    return F.date_format(ts, "MMMM")


def leap_year(ts: Column) -> Column:
    y = F.year(ts)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def day_of_week_in_month(ts: Column) -> Column:
    return F.call_function("div", F.dayofmonth(ts) - 1, F.lit(7)) + 1


def add_duration(ts: Column, months: Column, micros: Column) -> Column:
    """Months first, clamped to the month's end, then the rest."""
    moved = F.add_months(ts, months).cast("timestamp") + (ts - F.date_trunc("day", ts))
    return F.timestamp_micros(F.unix_micros(moved) + micros)


def duration_seconds(months: Column, micros: Column) -> Column:
    """date:seconds of a duration: a month counts 30.4368 days."""
    return months * 30.4368 * 86400 + micros / 1e6


# --- EXSLT strings, sets of strings and regular expressions ---


def padding(n: Column, chars: str = " ") -> Column:
    return F.when(n > 0, F.call_function("rpad", F.lit(""), n.cast("int"), F.lit(chars))).otherwise("")


def align(s: Column, pad: Column, how: str = "left") -> Column:
    """s over the padding string, cut to its length."""
    width, size = F.char_length(pad), F.char_length(s)
    left = F.call_function("div", width - size, F.lit(2)).cast("int") if how == "center" else (width - size if how == "right" else F.lit(0))
    made = F.concat(F.call_function("substring", pad, F.lit(1), left), s, F.call_function("substring", pad, left + size + 1))
    return F.when(size >= width, F.call_function("substring", s, F.lit(1), width)).otherwise(made)


def str_tokenize(s: Column, delimiters: str = "\t\r\n ") -> Column:
    """str:tokenize: any of the characters delimits, empty tokens go."""
    return F.filter(F.split(s, "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", delimiters) + "]"), lambda x: x != "")


def str_split(s: Column, separator: str = " ") -> Column:
    """str:split: a literal separator; an empty one gives the characters."""
    return F.split(s, re.escape(separator)) if separator else F.split(s, "")


def regexp_test(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(("(?i)" if "i" in flags else "") + pattern)


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    """With g all matches, otherwise the first with its groups."""
    wrapped = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_extract_all(s, F.lit(wrapped), F.lit(0))
    groups = re.compile(pattern).groups
    return F.when(s.rlike(wrapped), F.array(*[F.regexp_extract(s, wrapped, i) for i in range(groups + 1)])).otherwise(F.array().cast("array<string>"))


def regexp_replace(s: Column, pattern: str, flags: str, with_text: str) -> Column:
    """With g all matches, otherwise the first."""
    wrapped = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(s, wrapped, with_text)
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{wrapped})", "$1" + with_text)


def translate_regex(pattern: str, anchored: bool = False) -> str:
    """A pattern of the XSD and XPath dialects for java.util.regex: subtraction, \\i, \\c and blocks."""
    start, part = r"\p{L}\p{Nl}_:", r"\p{L}\p{Nl}\p{M}\p{N}_:.\-·"
    out, depth, i = "", 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in ("\\i", "\\c", "\\I", "\\C"):
            chars = start if two[1] in "iI" else part
            out += (chars if two[1].islower() else f"&&[^{chars}]") if depth else f"[{'^' if two[1].isupper() else ''}{chars}]"
            i += 2
        elif two in (r"\p", r"\P") and (m := re.match(r"\\([pP])\{Is([A-Z][A-Za-z0-9-]{3,})\}", pattern[i:])):
            out += f"\\{m[1]}{{In{m[2]}}}"
            i += m.end()
        elif two[0] == "\\":
            out += two
            i += 2
        elif two == "-[" and depth:
            inner, i = _class(pattern, i + 1)
            out += f"&&[^{translate_regex(inner[1:-1])}]" if not inner.startswith("[^") else f"&&[{translate_regex(inner[2:-1])}]"
        else:
            depth += (two[0] == "[") - (two[0] == "]")
            out += two[0]
            i += 1
    return f"^(?:{out})$" if anchored else out


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The bracket expression at an offset and its end."""
    depth, i = 0, at
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        depth += (pattern[i] == "[") - (pattern[i] == "]")
        i += 1
        if not depth:
            break
    return pattern[at:i], i


# --- XSD facets ---


def facet(kind: str, value: Column, limit) -> Column:
    """Whether a lexical value meets a constraining facet."""
    length = F.size(value) if kind.startswith("list-") else F.char_length(value)
    kind = kind.removeprefix("list-")
    number_ = value.try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(value, r"^[+-]?0*", ""), r"(\.[0-9]*?)0*$", "$1")
    made = {
        "length": lambda: length == limit, "minLength": lambda: length >= limit, "maxLength": lambda: length <= limit,
        "pattern": lambda: value.rlike(translate_regex(limit, True)), "enumeration": lambda: value.isin(*limit),
        "minInclusive": lambda: number_ >= limit, "maxInclusive": lambda: number_ <= limit, "minExclusive": lambda: number_ > limit, "maxExclusive": lambda: number_ < limit,
        "totalDigits": lambda: F.char_length(F.replace(digits, F.lit("."), F.lit(""))) <= limit, "fractionDigits": lambda: F.char_length(F.regexp_extract(digits, r"\.([0-9]*)$", 1)) <= limit,
        "explicitTimezone": lambda: value.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") if limit == "required" else ~value.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"),
        "whiteSpace": lambda: F.lit(True),
    }[kind]
    return F.coalesce(made(), F.lit(False))


#: Lexical forms of built-in simple types, as patterns; ranges are checked by ``castable``.
LEXICAL = {
    "boolean": r"true|false|1|0", "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", "integer": r"[+-]?[0-9]+", "double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN",
    "date": r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?", "dateTime": r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "time": r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?", "hexBinary": r"([0-9a-fA-F]{2})*", "base64Binary": r"([A-Za-z0-9+/ ]{4})*([A-Za-z0-9+/ ]{2}==|[A-Za-z0-9+/ ]{3}=)?",
    "duration": r"-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?", "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*", "NMTOKEN": r"\c+", "Name": r"\i\c*", "NCName": r"[\i-[:]][\c-[:]]*",
}
RANGES = {"byte": (-128, 127), "short": (-32768, 32767), "int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1), "unsignedByte": (0, 255), "unsignedShort": (0, 65535), "unsignedInt": (0, (1 << 32) - 1), "unsignedLong": (0, (1 << 64) - 1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1)}


def castable(value: Column, kind: str) -> Column:
    """Whether a text is in the lexical and value space of a built-in type."""
    kind = kind.removeprefix("xs:")
    s = F.regexp_replace(value, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    if kind in ("string", "normalizedString", "token", "anyURI"):
        return value.isNotNull()
    if kind in RANGES:
        low, high = RANGES[kind]
        n = s.try_cast("decimal(38,0)")
        found = s.rlike(f"^(?:{LEXICAL['integer']})$") & n.isNotNull()
        return F.coalesce(found & (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True)), F.lit(False))
    found = s.rlike(translate_regex(LEXICAL.get(kind, LEXICAL["double"] if kind == "float" else ".*"), True))
    if kind == "date":
        found = found & F.substring(s, 1, 10).try_cast("date").isNotNull()
    return F.coalesce(found, F.lit(False))
