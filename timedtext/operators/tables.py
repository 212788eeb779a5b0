"""Operators on small tables: latest rows, first of each key, rankings, histories, catalogue entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions.names import jaro_winkler_udf, number_to_chinese


def first_of(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_k(rows: DataFrame, score: str, k: int, ties: list[str]) -> DataFrame:
    """The k best rows with their rank; ties by ``ties``."""
    best = rows.orderBy(F.desc(score), *ties).limit(k)
    return best.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc(score), *ties)))  # k rows


def recent(history: DataFrame, size: int, key: str = "keyword", time: str = "time") -> DataFrame:
    """The ``size`` keys used last, each with its last time; all of them when size is below 1."""
    trimmed = history.withColumn(key, F.trim(key)).where(F.col(key) != "")
    last = trimmed.groupBy(key).agg(F.max(time).alias(time))
    return last.orderBy(F.desc(time), key).limit(size) if size >= 1 else last


def upsert(table: DataFrame, changes: DataFrame, key: str, deletes: DataFrame | None = None, ties: list[str] | None = None) -> DataFrame:
    """The table with changed rows in place of those of the same key, and without deleted keys. Of several changes to a key
    the one with the greatest ``version`` holds, then the first by ``ties``."""
    last = first_of(changes, [key], [F.desc("version"), *(ties or [])]).drop("version")
    out = table.join(last.select(key), key, "left_anti").unionByName(last)
    return out.join(deletes.select(key), key, "left_anti") if deletes is not None else out


def by_server(rows: DataFrame, servers: list[str], server: str = "server") -> DataFrame:
    """Adds ``server_rank``, the place of the row's server in the list."""
    return rows.withColumn("server_rank", F.array_position(F.array(*map(F.lit, servers)), F.col(server)).cast("int"))


def entry_key(id_: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(id_, F.lit("")), F.regexp_replace(title, r"\s+", ""))


def split_stage(rows: DataFrame, sources: DataFrame, policy: str = "auto") -> DataFrame:
    """Adds ``bucket``: settled for rows of sources already merged, else pending."""
    if policy == "ignore":
        return rows.withColumn("bucket", F.lit("pending"))
    stages = sources.select("source", F.lower("stage").alias("__stage"))
    return rows.join(stages, "source", "left").withColumn("bucket", F.when(F.col("__stage") == "merged", "settled").otherwise("pending")).drop("__stage")


def rejoin(settled: DataFrame, pending: DataFrame) -> DataFrame:
    """Both parts of a split together again, columns that only one has as nulls."""
    return settled.unionByName(pending, allowMissingColumns=True)


def extrapolate(old_id: Column, history_number: Column, playing: Column) -> Column:
    """The id of the episode being played, from the one watched last and both numbers."""
    return old_id + playing - history_number


def episode_number(episode_id: Column) -> Column:
    return episode_id % 1000


def batches(total: Column, size: int = 200) -> Column:
    """Array of struct(first, last): the numbers 1 to ``total`` in requests of ``size``."""
    starts = F.when(total > 0, F.sequence(F.lit(1).cast("bigint"), total, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda a: F.struct(a.alias("first"), F.least(a + (size - 1), total).alias("last")))


def bare_title(title: Column) -> Column:
    """A catalogue title without a last part in round brackets and what follows a part in square ones."""
    return F.regexp_replace(F.regexp_replace(F.trim(title), r"\s*\(.*?\)\s*\z", ""), r"(?s)\s*【.*?】.*\z", "")


def match_title(candidates: DataFrame, key: str, pos: str, least: float = 0.75) -> DataFrame:
    """For each search (``key``, with its title, wanted type and season) the candidate it takes, with its score.

    Of the candidates of the wanted type a single one is taken without a score. Of several, and with a season known, the
    most similar one by title, the first of equals, if it reaches ``least``. Later seasons are part of the title looked
    for, and so is the first one from where a candidate names it. Candidates are looked at within their search only."""
    of_type = candidates.where(F.col("type") == F.col("wanted")).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    scored = of_type.where((F.col("__n") > 1) & F.col("season").isNotNull()).withColumn("__b", bare_title(F.col("candidate")))
    first = F.max(F.when((F.col("season") == 1) & F.col("__b").rlike("第一[季部]"), 1).otherwise(0)).over(Window.partitionBy(key).orderBy(pos))
    season = F.when(first == 1, " 第一季").when(F.col("season") > 1, F.concat(F.lit(" 第"), number_to_chinese(F.col("season")), F.lit("季"))).otherwise("")
    scored = scored.withColumn("__a", F.concat("title", season)).withColumn("score", jaro_winkler_udf()("__a", "__b"))
    best = first_of(scored, [key], [F.desc(F.round("score", 9)), pos]).where(F.col("score") >= least)
    alone = of_type.where("__n = 1").withColumn("score", F.lit(None).cast("double"))
    return alone.drop("__n").unionByName(best.drop("__n", "__a", "__b"))


def hint_number(hint: Column) -> Column:
    """An episode number in a short hint: at most 12 bytes and three whole digits."""
    digits = F.regexp_extract(hint, r"([0-9]+\.?[0-9]*)", 1)
    return F.when((F.octet_length(hint) <= 12) & (F.char_length(F.regexp_extract(digits, r"^([0-9]+)", 1)).between(1, 3)), F.regexp_replace(digits, r"\.$", "").try_cast("double"))


# Commands by what their entry is.
COMMANDS = {"load-danmaku": "episode", "search-episodes-event": "anime", "get-extra-event": "anime", "open-latest-menu-anime": "nav", "open-menu": "nav"}


def command_kind(value: Column) -> Column:
    """The kind of an entry, by the first known command among its values."""
    kinds = F.create_map(*(x for k, v in COMMANDS.items() for x in (F.lit(k), F.lit(v))))
    return F.get(F.filter(F.transform(value, lambda x: F.try_element_at(kinds, x)), lambda k: k.isNotNull()), F.lit(0))


def episode_lists(items: DataFrame, key: str) -> DataFrame:
    """For each list whether it holds episodes: by command where most entries have one, else by hint."""
    usable = F.col("value").isNotNull() & F.coalesce(F.col("selectable"), F.lit(True))
    kind = command_kind(F.col("value"))
    count = lambda c: F.count_if(usable & F.coalesce(c, F.lit(False)))
    agg = items.groupBy(key).agg(count(F.lit(True)).alias("total"), count(kind.isNotNull()).alias("known"), count(kind == "episode").alias("episodes"), count(hint_number(F.col("hint")).isNotNull()).alias("numeric"))
    return agg.select(key, F.when(F.col("known") * 2 > F.col("total"), F.col("episodes") * 2 > F.col("total")).otherwise(F.col("numeric") * 2 > F.col("total")).alias("is_episode_list"))


def match_episode(episodes: DataFrame, number: int) -> DataFrame:
    """The first entry with the wanted number."""
    return episodes.where(hint_number(F.col("hint")) == number).orderBy("pos").limit(1)


def systematic(rows: DataFrame, files: int, pos: str = "pos", most: int = 10_000, count: int | None = None) -> DataFrame:
    """Every step-th row by position from 0, where the step keeps ``files`` files of this length below ``most`` rows."""
    n = rows.count() if count is None else count
    step = max(1, -(-n * files // most))
    return rows.where(F.col(pos) % step == 0)


def segment_starts(seconds: Column, step_ms: int = 60_000) -> Column:
    """Start of each request in milliseconds."""
    return F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.floor(seconds * 1000) - 1).cast("bigint"), F.lit(step_ms).cast("bigint"))
