"""Titles: file names to title, season and episode; Chinese numerals; title similarity and scores."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERALS = "零一二三四五六七八九"
_CN = "[一二三四五六七八九十]+"

# The file name patterns in order; the first that matches decides. The template names groups.
FILE_NAMES = (
    (r"^(.*?)\s*[_\-.\s]\s*第\s*(\d+)\s*[季部]+\s*[_\-.\s]\s*第\s*(\d+[.v]?\d*)\s*[话集回]", "1 S2 E3"),
    (rf"^(.*?)\s*[_\-.\s]\s*第({_CN})[季部]+\s*[_\-.\s]\s*第\s*(\d+[.v]?\d*)\s*[话集回]", "1 C2 E3"),
    (r"^(.*?)\s*[_\-.\s]\s*第\s*(\d+)\s*[季部]+\s*[_\-.\s]\s*[^\ddD][eEpP]+(\d+[.v]?\d*)", "1 S2 E3"),
    (rf"^(.*?)\s*[_\-.\s]\s*第({_CN})[季部]+\s*[_\-.\s]\s*[^\ddD][eEpP]+(\d+[.v]?\d*)", "1 C2 E3"),
    (r"^(.*?)\s*[_.\s]\s*(\d{4})[_.\s]\d\d[_.\s]\d\d\s*[_.\s]?(.*?)\s*[_.\s]\d+[pPkKxXbBfF]", "1 T3 Y2"),
    (r"^(.*?)\s*[_.\s]\s*(\d{4})\s*[_.\s]\s*[sS](\d+)[.\-\s:]?[eE](\d+\.?\d*)", "1 Y2 S3 E4"),
    (r"^(.*?)\s*[_.\s]\s*(\d{4})\s*[_.\s]\s*[^\ddD][eEpP]+(\d+\.?\d*)", "1 Y2 E3"),
    (r"^(.*?)\s*[_\-.\s]\s*[sS](\d+)[.\-\s:]?[eE](\d+[.v]?\d*)\s*[_.\s]\s*(\d{4})[^\dhHxXvVpPkKxXbBfF]", "1 Y4 S2 E3"),
    (r"^(.*?)\s*[_\-.\s]\s*[sS](\d+)[.\-\s:]?[eE](\d+\.?\d*)", "1 S2 E3"),
    (r"^(.*?)\s*[_.\s]\s*(\d+)[nrdsth]+[_.\s]\s*[sS]eason[_.\s]\s*\[(\d+[.v]?\d*)\]", "1 S2 E3"),
    (r"^(.*?)\s*[^\ddD][eEpP]+(\d+[.v]?\d*)[_.\s]\s*(\d{4})[^\dhHxXvVpPkKxXbBfF]", "1 Y3 E2"),
    (r"^(.*?)\s*[^\ddD][eEpP]+(\d+\.?\d*)", "1 E2"),
    (r"^(.*?)\s*第\s*(\d+[.v]?\d*)\s*[话集回]", "1 E2"),
    (r"^(.*?)\s*\[(\d+[.v]?\d*)\]", "1 E2"),
    (r"^(.*?)\s*\[(\d+[.v]?\d*)\([A-Za-z]+\)\]", "1 E2"),
    (r"^(.*?)\s*[\-#]\s*(\d+\.?\d*)\s*", "1 E2"),
    (r"^(.*?)\s*[\[(]([OVADSPs]+)[\])]", "1 K2"),
    (r"^(.*?)\s*[_\-.\s]\s*(\d?\d)x(\d\d?\d?\d?)[^\dhHxXvVpPkKxXbBfF]", "1 S2 E3"),
    (r"^\((\d{4})\.?\d?\d?\.?\d?\d?\)\s*(.*?)\s*[(\[]", "2 Y1"),
    (r"^(.*?)\s*[_.\s]\s*(\d{4})[^\dhHxXvVpPkKxXbBfF]", "1 Y2"),
    (r"^\[.*?\]\s*\[?(.*?)\]?\s*[(\[]", "1"),
)
# Cleaning steps for a name.
_CLEAN = (
    (r"^\[.*?\]", " "), (r"^\(.*?\)", " "), (r"[_.\[\]]", " "), (r"第\s*\d+\s*季", ""), (r"第\s*\d+\s*部", ""),
    (rf"第{_CN}季", ""), (rf"第{_CN}部", ""), (r"^\s+|\s+$", ""), (r"[!@#.?+\-%&*_=,/~`]+$", ""),
)


def clean_name(name: Column) -> Column:
    return reduce(lambda n, step: F.regexp_replace(n, step[0], step[1]), _CLEAN, name)


def chinese_to_number(text: Column) -> Column:
    """Read from the right; of two units in a row only the left one counts."""
    value = lambda c: F.when(F.instr(F.lit("零一二三四五六七八九"), c) > 0, F.instr(F.lit(NUMERALS), c) - 1).when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000).when(c == "万", 10000)
    digits = F.reverse(F.filter(F.split(text, ""), lambda c: c.rlike("[零一二三四五六七八九十百千万]")))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("unit"))

    def step(a, c):
        v = value(c).cast("bigint")
        return F.when(v >= 10, F.struct(a["total"].alias("total"), F.greatest(a["num"], F.lit(1)).cast("bigint").alias("num"), v.alias("unit"))).otherwise(
            F.struct((a["total"] + v * a["unit"]).alias("total"), F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("unit"))
        )

    end = lambda a: F.when(a["unit"] > 1, F.struct((a["total"] + a["num"] * a["unit"]).alias("t"), a["num"].alias("n"))).otherwise(F.struct(a["total"].alias("t"), a["num"].alias("n")))
    out = F.aggregate(digits, start, step, end)
    return F.when(out["t"] > 0, out["t"]).otherwise(out["n"])


def number_to_chinese(n: Column) -> Column:
    """Groups of four digits; a leading one before ten is dropped, trailing zeros too."""
    s = n.cast("string")
    size = F.char_length(s)
    at = F.sequence(F.lit(1), size)
    digit = lambda i: F.substring(s, i, F.lit(1)).cast("int")
    place = lambda i: size - i + 1
    unit = lambda i: F.element_at(F.array(*map(F.lit, ("", "十", "百", "千"))), (place(i) - 1) % 4 + 1)
    big = lambda i: F.when((place(i) % 4 == 1) & (place(i) > 1), F.element_at(F.array(*map(F.lit, ("", "万", "亿"))), F.floor((place(i) - 1) / 4).cast("int") + 1)).otherwise("")
    before_zero = lambda i: (i > 1) & (F.when(i > 1, F.substring(s, i - 1, F.lit(1))).otherwise("1") == "0")
    one = lambda i: F.concat(
        F.when(digit(i) == 0, "").otherwise(
            F.concat(
                F.when(before_zero(i), "零").otherwise(""),
                F.when((digit(i) == 1) & ((place(i) - 1) % 4 == 1) & (i == 1), "").otherwise(F.element_at(F.array(*map(F.lit, NUMERALS)), digit(i) + 1)),
                unit(i),
            )
        ),
        big(i),
    )
    return F.when(n == 0, "零").otherwise(F.regexp_replace(F.array_join(F.transform(at, one), ""), "零+$", ""))


def format_file_name(name: Column) -> Column:
    """``Title (year) SxEy`` and its shorter forms, or null when no pattern matches."""
    out = F.lit(None).cast("string")
    for pattern, template in reversed(FILE_NAMES):
        parts = []
        for item in template.split():
            group = F.regexp_extract(name, pattern, int(item[-1]))
            kind = item[:-1]
            if kind == "":
                parts.append(clean_name(group))
            elif kind == "T":
                parts.append(F.concat(F.lit(": "), F.trim(F.regexp_replace(group, r"\.", " "))))
            elif kind == "Y":
                parts.append(F.concat(F.lit(" ("), group, F.lit(")")))
            elif kind in "SC":
                parts.append(F.concat(F.lit(" S"), chinese_to_number(group).cast("string") if kind == "C" else group))
            elif kind == "E":
                lead = "" if any(x[0] in "SC" for x in template.split()) else " "
                parts.append(F.concat(F.lit(f"{lead}E"), F.regexp_replace(group, r"v\d+$", "") if "v" in pattern else group))
            else:
                parts.append(F.concat(F.lit(" ["), group, F.lit("]")))
        out = F.when(name.rlike(pattern), F.concat(*parts)).otherwise(out)
    return out


def title_season_episode(formatted: Column) -> tuple[Column, Column, Column]:
    """The parts of a formatted name; season or episode null where absent."""
    both, one = r"^(.*?)\s*[sS](\d+)[eE](\d+)", r"^(.*?)\s*[eE](\d+)"
    title = F.when(formatted.rlike(both), F.regexp_extract(formatted, both, 1)).when(formatted.rlike(one), F.regexp_extract(formatted, one, 1)).otherwise(formatted)
    season = F.when(formatted.rlike(both), F.regexp_extract(formatted, both, 2).cast("int"))
    episode = F.when(formatted.rlike(both), F.regexp_extract(formatted, both, 3).cast("int")).when(formatted.rlike(one), F.regexp_extract(formatted, one, 2).cast("int"))
    return title, season, episode


def parent_title(path: Column) -> Column:
    """The folder's name as a title; a season folder gives way to the one above."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")
    last, above = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
    season = r"(?i)^\s*seasons?\s*\d+\s*$|^\s*specials?\s*$|^\s*第.*?[季部]+\s*$"
    name = F.when(last.rlike(season) | last.rlike(r"^\s*SPs?\s*$|^\s*O[VAD]+s?\s*$"), above).otherwise(last)
    for pattern, by in (("\u2009", " "), (r"\[.*?\]", ""), (r"^\s*\(\d+.?\d*.?\d*\)", ""), (r"\(\d+.?\d*.?\d*\)\s*$", ""), (r"[._]", " ")):
        name = F.regexp_replace(name, pattern, by)
    return F.trim(name)


def differing_episode(previous: Column, current: Column) -> Column:
    """The number in ``current`` at the first place where the numbers of two names differ and the text around agrees."""
    pieces = lambda s: F.regexp_extract_all(s, F.lit(r"[^0-9]*[0-9]+[^0-9]*?"), F.lit(0))
    number = lambda p: F.regexp_extract(p, "([0-9]+)", 1).try_cast("bigint")
    text = lambda p: F.regexp_extract(p, r"^([^0-9]*)", 1)
    pairs = F.zip_with(pieces(previous), pieces(current), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    full = F.filter(pairs, lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    first = F.get(F.filter(full, lambda z: (text(z["a"]) != text(z["b"])) | (number(z["a"]) != number(z["b"]))), F.lit(0))
    return F.when(text(first["a"]) == text(first["b"]), number(first["b"]))


# --- similarity of titles ---------------------------------------------------------------------------------------------


def jaro_winkler(a: str, b: str, phantom: bool = True) -> float:
    """Jaro-Winkler similarity. With ``phantom`` each text has an extra slot before its first character that equals the
    other's: it counts as a match and as a common first character but not as length, so scores may pass 1."""
    if not a and not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = ([None, *a], [None, *b]) if phantom else (list(a), list(b))
    la, lb = len(a), len(b)
    reach = max(la, lb) // 2 - 1
    free = [True] * len(y)
    pairs_x = []
    for i, c in enumerate(x):
        lo, hi = max(0, i - reach), min(i + reach + 1, len(y) - 1)
        for k in range(lo, hi + 1 if phantom else min(i + reach + 1, len(y))):
            if free[k] and y[k] == c:
                free[k] = False
                pairs_x.append(c)
                break
    m = len(pairs_x)
    pairs_y = [c for c, f in zip(y, free) if not f]
    swaps = sum(p != q for p, q in zip(pairs_x, pairs_y)) / 2
    share = lambda n: m / n if n else float("inf")
    jaro = (share(la) + share(lb) + (m - swaps) / m) / 3 if m else 0.0
    prefix = 0
    while prefix < 4 and prefix < max(len(x), len(y)) and (x[prefix] if prefix < len(x) else 0) == (y[prefix] if prefix < len(y) else 1):
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def jaro_winkler_udf(phantom: bool = True):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x or "", y or "", phantom) for x, y in zip(a, b)], dtype=float)

    return score


# What the kind of an entry, and noise words in its title, add to its score.
KIND_SCORES = (("动漫", 40), ("番剧", 40), ("电影", -35), ("剧场版", -35), ("真人", -30), ("电视剧", -20))
NOISE_SCORES = (
    ("countdown", -40), ("特番", -40), ("特别篇", -30), ("特别节目", -30), ("总集篇", -30), ("预告", -30), ("花絮", -30), ("生放送", -30), ("演唱会", -25), ("舞台", -20), ("声优", -20),
)


def score_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s!-/:-@\[-`{-~]+", "")


def title_score(query: Column, title: Column, hint: Column, phantom: bool = True) -> Column:
    a, b = score_form(query), score_form(title)
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(hint, F.lit("")))
    words = sum((F.when(F.contains(both, F.lit(w)), n).otherwise(0) for w, n in KIND_SCORES), F.lit(0))
    noise = sum((F.when(F.contains(F.lower(title), F.lit(w)), n).otherwise(0) for w, n in NOISE_SCORES), F.lit(0))
    extra = F.least(F.greatest(F.char_length(b) - F.char_length(a), F.lit(0)), F.lit(40)) * 0.8
    return jaro_winkler_udf(phantom)(a, b) * 100 + F.when((a == b) & (a != ""), 30).otherwise(0) + words + noise - extra
