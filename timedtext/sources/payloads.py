"""Readers of comment payloads. Each takes a DataFrame with a text column and gives one row for each comment, with its
position in the payload: pos, time, type, size, color, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.functions.text import hex_colour, unescape_xml

WHITE = 16777215
_NUMBER = r"\A\s*-?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+|0x[0-9A-Fa-f]+)\s*\z"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _field(csv: Column, k: int) -> Column:
    """Entry k of a comma-separated text; empty entries do not count."""
    return F.get(F.filter(F.split(csv, ","), lambda x: x != ""), F.lit(k))


def _rows(payloads: DataFrame, keep: list[str], items: Column, time, kind, size, colour, text, valid=None) -> DataFrame:
    each = payloads.select(*keep, F.posexplode(items).alias("pos", "x"))
    x = F.col("x")
    if valid is not None:
        each = each.where(valid(x))
    return each.select(*keep, "pos", time(x).cast("double").alias("time"), kind(x).cast("int").alias("type"), size(x).cast("int").alias("size"), colour(x).cast("int").alias("color"), text(x).alias("text"))


_one = lambda _: F.lit(1)
_size = lambda _: F.lit(25)


def xml_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """``<d p="time,type,size,color,...">text</d>`` anywhere; rows whose first four entries are not all numbers go."""
    tag = r'<d\s+(?:[^>]*\s)?p="([^"]+)"[^>]*>([^<]+)</d>'
    both = F.arrays_zip(F.regexp_extract_all(column, F.lit(tag), F.lit(1)).alias("p"), F.regexp_extract_all(column, F.lit(tag), F.lit(2)).alias("t"))
    num = lambda k: lambda x: _number(_field(x["p"], k))
    return _rows(
        payloads, list(keep), both, num(0), num(1), num(2), num(3), lambda x: unescape_xml(x["t"]), lambda x: num(0)(x).isNotNull() & num(1)(x).isNotNull() & num(2)(x).isNotNull() & num(3)(x).isNotNull()
    )


def c_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """``[{"c": "time,color,type,size,...", "m": text}]``, a byte order mark allowed."""
    items = F.from_json(F.regexp_replace(column, "\\A\ufeff", ""), "array<struct<c:string,m:string>>")
    num = lambda k: lambda x: _number(_field(x["c"], k))
    return _rows(payloads, list(keep), items, num(0), num(2), num(3), num(1), lambda x: x["m"], lambda x: num(0)(x).isNotNull() & num(1)(x).isNotNull() & num(2)(x).isNotNull() & num(3)(x).isNotNull())


def p_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """``{"comments": [{"p": "time,type,color,...", "m": text, "shift": s}]}``; control characters, backslashes and
    double quotes leave the text."""
    items = F.from_json(column, "struct<comments:array<struct<p:string,m:string,shift:double>>>")["comments"]
    return _rows(
        payloads,
        list(keep),
        items,
        lambda x: F.coalesce(_number(_field(x["p"], 0)), F.lit(0.0)) + F.coalesce(x["shift"], F.lit(0.0)),
        lambda x: _number(_field(x["p"], 1)),
        _size,
        lambda x: F.coalesce(_number(_field(x["p"], 2)), F.lit(float(WHITE))),
        lambda x: F.regexp_replace(x["m"], r'[\x00-\x1f\\"]', ""),
        lambda x: x["p"].isNotNull(),
    )


def array_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """``{"danmuku": [[time, "right"|"top"|"bottom", "#hex"|number, _, text]]}``. Top gives type 4 and bottom type 5, the
    other way round than on screen, as the format has it; times keep two decimals."""
    items = F.from_json(column, "struct<danmuku:array<array<string>>>")["danmuku"]
    colour = lambda x: F.coalesce(F.when(F.get(x, F.lit(2)).rlike(r"\A[0-9]+\z"), F.get(x, F.lit(2)).try_cast("int")), hex_colour(F.coalesce(F.get(x, F.lit(2)), F.lit(""))))
    return _rows(
        payloads,
        list(keep),
        items,
        lambda x: F.round(F.coalesce(F.get(x, F.lit(0)).try_cast("double"), F.lit(0.0)), 2),
        lambda x: F.when(F.get(x, F.lit(1)) == "top", 4).when(F.get(x, F.lit(1)) == "bottom", 5).otherwise(1),
        _size,
        colour,
        lambda x: F.coalesce(F.get(x, F.lit(4)), F.get(x, F.lit(3)), F.lit("")),
    )


def position_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """``[{"time": tenths, "color": "#hex", "position": 0|1|2, "text": text}]``."""
    items = F.from_json(column, "array<struct<time:double,color:string,position:int,text:string>>")
    return _rows(payloads, list(keep), items, lambda x: x["time"] / 10, lambda x: F.when(x["position"] == 0, 1).when(x["position"] == 1, 4).otherwise(5), _size, lambda x: hex_colour(x["color"]), lambda x: x["text"])


def tagged_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """Tags ``content``, ``showTime`` and ``color`` zipped by their order."""
    tag = lambda t: F.regexp_extract_all(column, F.lit(f"(?s)<{t}>(.*?)</{t}>"), F.lit(1))
    items = F.transform(tag("content"), lambda c, i: F.struct(c.alias("m"), F.get(tag("showTime"), i).alias("t"), F.get(tag("color"), i).alias("c")))
    colour = lambda x: F.when(x["c"].rlike(r"\A[0-9A-Fa-f]+\z"), F.conv(x["c"], 16, 10).try_cast("int")).otherwise(WHITE)
    return _rows(payloads, list(keep), items, lambda x: F.coalesce(_number(x["t"]), F.lit(0.0)), _one, _size, lambda x: F.coalesce(colour(x), F.lit(WHITE)), lambda x: x["m"])


def item_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """``{"data": {"items": [{"time": ms, "content": text}]}}``; white, rolling, two decimals."""
    items = F.from_json(column, "struct<data:struct<items:array<struct<time:double,content:string>>>>")["data"]["items"]
    return _rows(payloads, list(keep), items, lambda x: F.round(F.coalesce(x["time"], F.lit(0.0)) / 1000, 2), _one, _size, lambda _: F.lit(WHITE), lambda x: F.coalesce(x["content"], F.lit("")))


def barrage_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """``{"barrage_list": [{"time_offset": ms, "content": text, "content_style": {"color": "#hex"}}]}``."""
    items = F.from_json(column, "struct<barrage_list:array<struct<time_offset:string,content:string,content_style:struct<color:string>>>>")["barrage_list"]
    colour = lambda x: F.when(x["content_style"]["color"].startswith("#"), hex_colour(x["content_style"]["color"])).otherwise(WHITE)
    return _rows(payloads, list(keep), items, lambda x: F.coalesce(x["time_offset"].try_cast("double") / 1000, F.lit(0.0)), _one, _size, colour, lambda x: F.coalesce(x["content"], F.lit("")))


def nested_comments(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """Rows ``{"playat": ms, "content": text, "propertis": "{\\"color\\": n}"}`` under data.result or result, either of
    which may itself be JSON written as a string."""
    row = "array<struct<playat:string,content:string,propertis:string>>"
    text = F.col(column)
    data = F.get_json_object(text, "$.data")
    inner = F.coalesce(F.get_json_object(data, "$.result"), data, F.get_json_object(text, "$.result"))
    unwrapped = F.coalesce(F.get_json_object(inner, "$.data.result"), F.get_json_object(inner, "$.result"), inner)
    code = F.coalesce(F.get_json_object(inner, "$.code"), F.get_json_object(text, "$.code"))
    items = F.when(F.coalesce(code, F.lit("")) != "-1", F.from_json(unwrapped, row))
    return _rows(
        payloads,
        list(keep),
        items,
        lambda x: F.coalesce(x["playat"].try_cast("double") / 1000, F.lit(0.0)),
        _one,
        _size,
        lambda x: F.coalesce(F.get_json_object(x["propertis"], "$.color").try_cast("int"), F.lit(WHITE)),
        lambda x: F.coalesce(x["content"], F.lit("")),
    )


READERS = {
    "xml": xml_comments, "c": c_comments, "p": p_comments, "array": array_comments, "position": position_comments, "tagged": tagged_comments,
    "items": item_comments, "barrage": barrage_comments, "nested": nested_comments,
}


def read_files(spark: SparkSession, path: str, shape: str | None = None) -> DataFrame:
    """Comments of the files under ``path``, each file's name in ``source``, its stage in ``stage``; ``.xml`` and
    ``.json`` choose the reader unless ``shape`` does."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("payload"))
    whole = whole.withColumn("stage", stage_tag(F.col("payload"))).where(F.col("payload") != "")
    keep = ("source", "stage")
    if shape:
        return READERS[shape](whole, keep=keep)
    lower = F.lower("source")
    return xml_comments(whole.where(lower.endswith(".xml")), keep=keep).unionByName(c_comments(whole.where(lower.endswith(".json")), keep=keep))


#: What a stage comment begins with in files that this engine writes.
STAGE_PREFIX = "timedtext:stage="


def stage_tag(content: Column, prefix: str = STAGE_PREFIX) -> Column:
    """The stage named in the first 512 bytes, or null; the prefix is a parameter, since writers differ."""
    head = F.decode(F.substring(F.encode(content, "UTF-8"), 1, 512), "UTF-8")
    found = F.lower(F.regexp_extract(head, rf"<!--\s*\Q{prefix}\E([A-Za-z]+)\s*-->", 1))
    return F.when(found.isin("raw", "filtered", "merged"), found)


def rules(payloads: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """The enabled patterns of a rule file (xml, json or txt), in order: pos, pattern."""
    if kind == "xml":
        tag = r'<item\s+enabled="([^"]*)"\s*>t=(.*?)</item>'
        found = F.arrays_zip(F.regexp_extract_all(column, F.lit(tag), F.lit(1)).alias("e"), F.regexp_extract_all(column, F.lit(tag), F.lit(2)).alias("p"))
        each = payloads.select(F.posexplode(found).alias("pos", "x")).where(F.col("x.e") == "true")
        return each.select("pos", F.col("x.p").alias("pattern"))
    if kind == "json":
        items = F.from_json(column, "array<struct<type:int,filter:string,opened:boolean>>")
        each = payloads.select(F.posexplode(items).alias("pos", "x")).where((F.col("x.type") == 0) & F.col("x.opened") & F.col("x.filter").isNotNull())
        return each.select("pos", F.col("x.filter").alias("pattern"))
    if kind == "txt":
        each = payloads.select(F.posexplode(F.split(column, r"\r\n|\r|\n")).alias("pos", "x"))
        return each.select("pos", F.regexp_replace("x", r"^\s+|\s+$", "").alias("pattern")).where("pattern <> ''")
    return payloads.sparkSession.createDataFrame([], "pos int, pattern string")


def catalogue(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Titles of ``{"animes": [{animeTitle, bangumiId, type, typeDescription}]}``."""
    items = F.from_json(column, "struct<animes:array<struct<animeTitle:string,bangumiId:string,type:string,typeDescription:string>>>")["animes"]
    return payloads.select(F.posexplode(items).alias("pos", "x")).select("pos", F.col("x.animeTitle").alias("title"), F.col("x.bangumiId").alias("id"), F.col("x.type").alias("type"), F.col("x.typeDescription").alias("hint"))


def episodes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Episodes of ``{"bangumi": {"episodes": [{episodeId, episodeTitle, episodeNumber}]}}``."""
    items = F.from_json(column, "struct<bangumi:struct<episodes:array<struct<episodeId:string,episodeTitle:string,episodeNumber:string>>>>")["bangumi"]["episodes"]
    return payloads.select(F.posexplode(items).alias("pos", "x")).select("pos", F.col("x.episodeId").alias("episode_id"), F.col("x.episodeTitle").alias("title"), F.col("x.episodeNumber").alias("hint"))


def linked_rows(payloads: DataFrame, sites: dict[str, str], column: str = "payload") -> DataFrame:
    """Rows of an extra catalogue, one for each known site that has a link: title, site, link, hint. ``sites`` has the
    name of each site by its key in the payload."""
    row = "struct<titleTxt:string,cat_name:string,year:string,en_id:string,playlinks:map<string,string>>"
    items = F.from_json(column, f"struct<data:struct<longData:struct<rows:array<{row}>>>>")["data"]["longData"]["rows"]
    named = F.create_map(*(x for k, v in sites.items() for x in (F.lit(k), F.lit(v))))
    each = payloads.select(F.explode(items).alias("x")).select("x", F.explode("x.playlinks").alias("key", "link"))
    known = each.withColumn("site", F.try_element_at(named, F.col("key"))).where(F.col("site").isNotNull())
    hint = F.concat_ws(" | ", "x.cat_name", "x.year", F.concat(F.lit("来源："), "site"))
    return known.select(F.col("x.titleTxt").alias("title"), F.col("x.en_id").alias("id"), "site", "link", hint.alias("hint"))


def mixed_list(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A JSON list whose entries are addresses or objects with one: pos, url (null when empty)."""
    texts = F.from_json(column, "array<string>")
    address = lambda x: F.nullif(F.when(x.startswith("{"), F.get_json_object(x, "$.url")).otherwise(x), F.lit(""))
    return payloads.select(F.posexplode(texts).alias("pos", "x")).select("pos", address(F.col("x")).alias("url"))


def history_sources(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Source records of a history document ``{path: {"sources": {url: {from, blocked, delay_segments}}}}``; older records
    are strings ``-src<from>{{delay}}``, the minus for blocked."""
    outer = F.from_json(column, "map<string,string>")
    paths = payloads.select(F.explode(outer).alias("path", "doc")).select("path", F.from_json(F.get_json_object("doc", "$.sources"), "map<string,string>").alias("sources"), F.get_json_object("doc", "$.sources").alias("raw"))
    modern = paths.where(~F.coalesce(F.col("raw").startswith("["), F.lit(False))).select("path", F.explode("sources").alias("url", "x"))
    new = modern.select("path", "url", F.get_json_object("x", "$.from").alias("origin"), F.coalesce(F.get_json_object("x", "$.blocked").try_cast("boolean"), F.lit(False)).alias("blocked"), F.lit(None).cast("double").alias("delay"))
    old = paths.where(F.col("raw").startswith("[")).select("path", F.explode(F.from_json("raw", "array<string>")).alias("x"))
    past = old.select("path", F.regexp_extract("x", r"^-?(.*?)(?:<|\{\{|$)", 1).alias("url"), F.nullif(F.regexp_extract("x", "<([^>]*)>", 1), F.lit("")).alias("origin"), F.col("x").startswith("-").alias("blocked"), F.regexp_extract("x", r"\{\{(-?[0-9.]+)\}\}", 1).try_cast("double").alias("delay"))
    return new.unionByName(past)
