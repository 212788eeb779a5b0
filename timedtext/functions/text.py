"""Column builders for comment text: normalisation, marks, entities, widths, colours, times, addresses."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped from the end, and the width table, source and target in step.
ENDING = ".。,，/?？!！…~～@^、+=-_♂♀ "
WIDTH_FROM = "　１２３４５６７８９０!＠＃＄％＾＆＊（）－＝＿＋［］｛｝;＇:＂,．／＜＞?＼｜｀～ｑｗｅｒｔｙｕｉｏｐａｓｄｆｇｈｊｋｌｚｘｃｖｂｎｍＱＷＥＲＴＹＵＩＯＰＡＳＤＦＧＨＪＫＬＺＸＣＶＢＮＭ"
WIDTH_TO = " 1234567890！@#$%^&*()-=_+[]{}；'：\"，./<>？\\|`~qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXCVBNM"
FORCED = (("^23{2,}$", "23333"), ("^6{3,}$", "66666"))
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
CJK = r"　-鿿＀-￯"


def _ending_class() -> str:
    return "[" + "".join("\\" + c if c in "./?^+=-_~@" else c for c in ENDING) + "]"


def trim_ending(text: Column) -> Column:
    """Without the run of ending marks; a text of nothing else stays."""
    cls = _ending_class()
    return F.when(text.rlike(rf"(?s)\A{cls}*\z"), text).otherwise(F.regexp_replace(text, rf"{cls}+\z", ""))


def fold_width(text: Column) -> Column:
    return F.translate(text, WIDTH_FROM, WIDTH_TO)


def fold_spaces(text: Column) -> Column:
    """Runs of blanks become one, or none between two CJK characters."""
    inner = F.regexp_replace(text, rf"(?<=[{CJK}&&[^　]])[ 　]+(?=[{CJK}&&[^　]])", "")
    return F.regexp_replace(inner, r"[ 　]+", " ")


def force(text: Column, rules=FORCED, strict_reference: bool = False, once: bool = False) -> Column:
    """Ordered replacements by regular expression. Quantifiers keep their upper bounds; with ``strict_reference`` ``{n,m}``
    has none. ``once``: only the first match of each rule is replaced."""

    def one(t: Column, rule: tuple[str, str]) -> Column:
        pattern = re.sub(r"\{(\d+),\d+\}", r"{\1,}", rule[0]) if strict_reference else rule[0]
        pattern = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern
        return F.regexp_replace(t, rf"(?s)\A(.*?){pattern}" if once else pattern, f"$1{rule[1]}" if once else rule[1])

    return reduce(one, rules, text)


def normalize(text: Column, ending: bool = True, width: bool = True, spaces: bool = True, rules=FORCED) -> Column:
    out = F.coalesce(text, F.lit(""))
    out = trim_ending(out) if ending else out
    out = fold_width(out) if width else out
    out = fold_spaces(out) if spaces else out
    return force(out, rules) if rules else out


def chars(text: Column) -> Column:
    """The code points of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def abbreviate(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(tail))).otherwise(text)


def display_width(text: Column, font_size: Column | float = 2.0) -> Column:
    """Half the font size for each ASCII character, the whole for any other."""
    size = font_size if isinstance(font_size, Column) else F.lit(float(font_size))
    ascii_ = F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (2 * F.char_length(text) - ascii_) * size / 2


def unescape_xml(text: Column) -> Column:
    for name, ch in (("quot", '"'), ("apos", "'"), ("gt", ">"), ("lt", "<"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(ch))
    return text


def escape_xml(text: Column) -> Column:
    for ch, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(ch), F.lit(f"&{name};"))
    return text


def _code_point(n: Column) -> Column:
    """A character from its number, through its UTF-8 bytes."""
    b = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda shift: F.expr("128") + (F.shiftright(n, shift).bitwiseAND(F.lit(63)))
    octets = (
        F.when(n < 128, b(n))
        .when(n < 2048, F.concat(b(F.shiftright(n, 6) + 192), b(tail(0))))
        .when(n < 65536, F.concat(b(F.shiftright(n, 12) + 224), b(tail(6)), b(tail(0))))
        .otherwise(F.concat(b(F.shiftright(n, 18) + 240), b(tail(12)), b(tail(6)), b(tail(0))))
    )
    return F.decode(F.unhex(octets), "UTF-8")


def unescape_numeric(text: Column) -> Column:
    """``&#x41;`` and ``&#65;`` as characters, hexadecimal ones first."""
    pieces = F.split(text, r"&#x[0-9A-Fa-f]+;|&#[0-9]+;", -1)
    found = F.regexp_extract_all(text, F.lit(r"&#x[0-9A-Fa-f]+;|&#[0-9]+;"), F.lit(0))
    number = lambda r: F.when(F.substring(r, 3, 1) == "x", F.conv(F.regexp_extract(r, "x([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).try_cast("bigint")
    made = F.transform(found, lambda r: F.when(number(r) <= 1114111, _code_point(number(r))).otherwise(r))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(made, i), F.lit("")))), ""))


def ass_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def convert_script(text: Column, table: dict[str, str]) -> Column:
    """Character by character through a table given by the caller."""
    keys = [k for k in table if len(k) == 1 and len(table[k]) == 1]
    return F.translate(text, "".join(keys), "".join(table[k] for k in keys)) if keys else text


def convert_by_mode(text: Column, mode: Column, to_simple: dict[str, str], to_full: dict[str, str]) -> Column:
    """Mode 1 by the first table, mode 2 by the second, any other not at all."""
    return F.when(mode == 1, convert_script(text, to_simple)).when(mode == 2, convert_script(text, to_full)).otherwise(text)


# --- merge marks ---------------------------------------------------------------------------------------------------


def mark(count: Column, subscript: bool = False, threshold: int = 1, where: str = "suffix") -> Column:
    n = count.cast("string")
    body = F.concat(F.lit("₍"), F.translate(n, "0123456789", SUBSCRIPTS), F.lit("₎")) if subscript else F.concat(F.lit("("), n, F.lit(")"))
    return F.lit("") if where == "off" else F.when(count > threshold, body).otherwise("")


def with_mark(text: Column, tag: Column, where: str = "suffix") -> Column:
    return F.concat(tag, text) if where == "prefix" else F.concat(text, tag)


def parse_mark(text: Column) -> tuple[Column, Column]:
    """(count, mark) of a text that carries one, else nulls; the suffix forms come first."""
    forms = [r"\([0-9]+\)\z", r"\[x[0-9]+\]\z", rf"(?<!₍[^₍]{{0,64}})₍[{SUBSCRIPTS}]+₎\z", r"\A\([0-9]+\)", r"\A\[x[0-9]+\]", rf"\A₍[{SUBSCRIPTS}]+₎"]
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, f, 0), F.lit("")) for f in forms))
    digits = F.regexp_extract(F.translate(found, SUBSCRIPTS, "0123456789"), "([0-9]+)", 1)
    return digits.try_cast("bigint"), found


def enlarge(count: Column, base: float = 5, least: int = 5, most: float = 2.0, on: bool = True) -> Column:
    if not on:
        return F.lit(1.0)
    return F.when(count <= least, F.lit(1.0)).otherwise(F.greatest(F.least(F.ln(count) / F.ln(F.lit(float(base))), F.lit(float(most))), F.lit(1.0)))


def merged_font_size(base: int, count: Column, growth: int = 8, largest: int = 100) -> Column:
    return F.least(F.lit(max(base, largest)), F.lit(base) + F.floor(F.lit(float(growth)) * F.ln(F.greatest(count, F.lit(1))) + 0.5))


# --- colours -------------------------------------------------------------------------------------------------------


def hex_colour(text: Column) -> Column:
    """``#RRGGBB`` as a number; anything else is white."""
    digits = F.substring(text, 2, 1000)
    return F.when(digits.rlike(r"\A[0-9A-Fa-f]{6}\z"), F.conv(digits, 16, 10).cast("int")).otherwise(F.lit(16777215))


def bgr_tag(colour: Column) -> Column:
    c = F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.coalesce(colour, F.lit(16777215)), F.lit(16777215)))), 6, "0")
    return F.concat(F.lit("&H"), F.substring(c, 5, 2), F.substring(c, 3, 2), F.substring(c, 1, 2), F.lit("&"))


def colour_distance(a: Column, b: Column) -> Column:
    part = lambda c, s: F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("double")
    return F.sqrt(sum((F.pow(part(a, s) - part(b, s), F.lit(2.0)) for s in (16, 8, 0)), F.lit(0.0)))


# --- times and numbers ----------------------------------------------------------------------------------------------


def clock(seconds: Column) -> Column:
    """H:MM:SS.cc"""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(whole / 3600).cast("bigint"), F.floor(whole % 3600 / 60).cast("bigint"), whole % 60, F.floor((seconds - whole) * 100).cast("bigint"))


def clock_seconds(text: Column) -> Column:
    p = r"([0-9]+):([0-9]+):([0-9.]+)"
    g = lambda k: F.regexp_extract(text, p, k).try_cast("double")
    return g(1) * 3600 + g(2) * 60 + g(3)


def length_seconds(text: Column) -> Column:
    """A duration written as a number, H:M:S or M:S; anything else is 0."""
    t = F.trim(text)
    three, two = r"\A([0-9]+):([0-9]+):([0-9.]+)\z", r"\A([0-9]+):([0-9.]+)\z"
    g = lambda p, k: F.regexp_extract(t, p, k).try_cast("double")
    return F.coalesce(F.when(t.rlike(r"\A-?[0-9]+(\.[0-9]*)?\z"), t.try_cast("double")), F.when(t.rlike(three), g(three, 1) * 3600 + g(three, 2) * 60 + g(three, 3)), F.when(t.rlike(two), g(two, 1) * 60 + g(two, 2)), F.lit(0.0))


def delay_seconds(text: Column) -> Column:
    """``XmYs`` (the sign of the minutes holds for both) or a plain number; anything else is null."""
    t = F.regexp_replace(text, r"\s+", "")
    p = r"\A(-?[0-9]+)m([0-9]+)s\z"
    m, s = F.regexp_extract(t, p, 1).try_cast("double"), F.regexp_extract(t, p, 2).try_cast("double")
    return F.when(t.rlike(p), m * 60 + F.when(m < 0, -s).otherwise(s)).when(t.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), t.try_cast("double"))


def plain_number(x: Column) -> Column:
    """A double without a trailing ``.0``."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def positive_integer(x: Column, fallback: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(x.try_cast("double"), F.lit(float(fallback)))).cast("bigint"))


# --- addresses and names ---------------------------------------------------------------------------------------------


def is_protocol(path: Column) -> Column:
    return F.coalesce(path.rlike(r"\A[A-Za-z][\w.+-]*?:(//|\?)"), F.lit(False))


def url_decode_name(url: Column) -> Column:
    """Without scheme and query, percent signs and plus signs decoded."""
    bare = F.regexp_replace(F.regexp_replace(url, r"\A[A-Za-z][A-Za-z0-9_-]+://", ""), r"\?.+\z", "")
    return F.coalesce(F.try_url_decode(bare), bare)


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*\z", "")


def safe_filename(name: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(name, r'[/\\:*?"<>|]', "_"))
    return F.when(name.isNull() | (cleaned == ""), "danmaku").otherwise(cleaned)


def is_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[䀀-鿿]"), F.lit(False))


def lines(text: Column) -> Column:
    """Lines by any line end; a final empty one is none."""
    parts = F.split(text, r"\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def version_greater(a: Column, b: Column) -> Column:
    numbers = lambda v: F.transform(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return numbers(a) > numbers(b)
