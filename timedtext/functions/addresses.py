"""Identifiers in addresses, query syntax, server lists, title rules, and short messages about failed requests."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from timedtext.functions.luapattern import BadPattern, replacement_to_java, to_java
from timedtext.functions.text import is_protocol, url_decode_name


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def third_field(text: Column) -> Column:
    """What stands between the second and the third colon."""
    return _part(text, r"\A[^:]*:[^:]*:([^:]*):")


def video_and_page(url: Column) -> tuple[Column, Column, Column]:
    """(text id, number id, page), the page 1 by default."""
    name = F.coalesce(_part(url, "/video/(BV[A-Za-z0-9]+)"), _part(url, "[?&]bvid=(BV[A-Za-z0-9]+)"))
    return name, _part(url, "/video/av([0-9]+)"), F.coalesce(_part(url, "[?&]p=([0-9]+)").try_cast("int"), F.lit(1))


def segments(url: Column) -> Column:
    return F.regexp_extract_all(url, F.lit("/([^/?#]+)"), F.lit(1))


def video_parameter(url: Column) -> Column:
    """The ``vid`` of the query, else the last path segment without its ending."""
    return F.coalesce(_part(url, "[?&]vid=([^&?#]+)"), _part(F.try_element_at(segments(url), F.lit(-1)), r"\A([^.]+)"))


def collection_and_video(path: Column) -> tuple[Column, Column]:
    """``/b/<collection>/<video>.html``, else the last two segments; the video without its ending."""
    direct = r"/b/([0-9]+)/([A-Za-z0-9._-]+)\.html"
    parts = F.regexp_extract_all(path, F.lit("/([^/]+)"), F.lit(1))
    two = F.size(parts) >= 2
    bare = lambda x: _part(x, r"([^.]+)")
    first = F.coalesce(_part(path, direct, 1), F.when(two, F.try_element_at(parts, F.lit(-2))))
    return first, bare(F.coalesce(_part(path, direct, 2), F.when(two, F.try_element_at(parts, F.lit(-1)))))


def query_parts(query: Column) -> tuple[Column, Column, Column]:
    """(name, class, server note) of ``name | class`` or ``name @note``."""
    piped = r"(?s)\A(.*?)\s*\|\s*(.*?)\s*\z"
    noted = r"(?s)\A(.*?)\s*@([^@]*)\z"
    name = F.when(query.rlike(piped), F.regexp_extract(query, piped, 1)).when(query.rlike(noted), F.regexp_extract(query, noted, 1)).otherwise(query)
    note = F.when(~query.rlike(piped) & query.rlike(noted), F.nullif(F.trim(F.regexp_extract(query, noted, 2)), F.lit("")))
    return name, _part(query, piped, 2), note


def servers(text: Column) -> Column:
    """Array of struct(url, note) of a comma-separated list; a note follows the first ``|`` or ``#``."""
    parts = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.struct(F.trim(F.regexp_extract(s, r"\A([^|#]*)", 1)).alias("url"), F.when(s.rlike("[|#]"), F.trim(F.regexp_extract(s, r"[|#](.*)\z", 1))).alias("note")),
    )


def media_name(path: Column, media_title: Column, file_name: Column) -> Column:
    """For an address its decoded title without the class after a pipe, else the file name."""
    decoded = url_decode_name(media_title)
    return F.when(is_protocol(path) & (F.coalesce(media_title, F.lit("")) != ""), F.coalesce(_part(decoded, r"(?s)\A(.*?)\s*\|", 1), decoded)).otherwise(file_name)


def title_rules(text: str) -> list[tuple[str, str]]:
    """(regular expression, replacement) of a JSON list of ``{"rules": [{pattern: replacement}]}``; invalid ones go."""
    try:
        found = json.loads(text)
    except ValueError:
        return []
    found = [found] if isinstance(found, dict) else found if isinstance(found, list) else []
    out = []
    for group in found:
        for rule in group.get("rules", []) if isinstance(group, dict) else []:
            for pattern, by in rule.items():
                try:
                    out.append((to_java(pattern), replacement_to_java(by)))
                except BadPattern:
                    continue
    return out


def replace_title(title: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules in order, with a clean-up after each."""
    for pattern, by in rules:
        title = F.regexp_replace(title, pattern, by)
        title = F.regexp_replace(F.trim(F.regexp_replace(title, "[_.]", " ")), r"[@#.+\-%&*_=,/~`]+\z", "")
    return title


# What the exit codes of the request program mean.
EXITS = {
    1: "curl 用法错误", 3: "URL 格式错误", 5: "代理解析失败", 6: "域名解析失败", 7: "连不上服务器", 22: "HTTP 返回错误状态码", 28: "请求超时", 35: "TLS 握手失败",
    51: "证书校验失败", 52: "服务器无响应", 56: "接收数据失败", 60: "证书不受信任", -3: "子进程没起来（可能缺 curl）",
}
NO_DETAIL = "无详细信息"


def brief(error: Column, most: int = 80) -> Column:
    """One line, shortened by bytes over ``most`` to that many characters."""
    line = F.trim(F.regexp_replace(F.coalesce(error, F.lit("")), r"\s+", " "))
    return F.when(line == "", NO_DETAIL).when(F.octet_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def failure_hint(error: Column) -> Column:
    """Exit code with its meaning, and the first 18 characters of the detail."""
    code = _part(error, r"Exit code:\s*(-?[0-9]+)").try_cast("int")
    table = F.create_map(*(x for k, v in EXITS.items() for x in (F.lit(k), F.lit(v))))
    head = F.when(code.isNotNull(), F.concat_ws(" ", F.lit("exit"), code.cast("string"), F.try_element_at(table, code)))
    detail = F.nullif(F.substring(F.regexp_replace(F.coalesce(_part(error, r"(?s)Error:\s*(.*?)\s*\z"), F.lit("")), r"\s+", " "), 1, 18), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("：", head, detail), F.lit("")), F.lit(NO_DETAIL))


def base64(data: Column) -> Column:
    """Base64 in one line."""
    return F.translate(F.base64(data), "\r\n", "")


#: Files are known by this many bytes at their start; shorter ones have no hash.
HEAD_BYTES = 16 * 1024 * 1024


def head_hash(content: Column) -> Column:
    """MD5 of the first 16 MiB of a file's bytes, null for a shorter file."""
    return F.when(F.octet_length(content) >= HEAD_BYTES, F.md5(F.substring(content, 1, HEAD_BYTES)))


def aes_encrypt(data: Column, key: Column, mode: str = "ECB", iv: Column | None = None) -> Column:
    """AES in ECB or CBC mode with PKCS padding; in CBC the initial vector is not part of the result."""
    if mode == "ECB":
        return F.aes_encrypt(data, key, F.lit(mode), F.lit("PKCS"))
    return F.substr(F.aes_encrypt(data, key, F.lit(mode), F.lit("PKCS"), iv), F.lit(17))


def aes_decrypt(data: Column, key: Column, mode: str = "ECB", iv: Column | None = None) -> Column:
    return F.aes_decrypt(data if mode == "ECB" else F.concat(iv, data), key, F.lit(mode), F.lit("PKCS"))


def times33(data: Column) -> Column:
    """Fingerprint of the bytes: h = (h * 33 + byte) mod 2^32 from 5381, as eight hexadecimal digits."""
    codes = F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("bigint"))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, b: (h * 33 + b) % 4294967296)), 8, "0"))
