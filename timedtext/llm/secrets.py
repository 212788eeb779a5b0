"""Secret scans with multipart credential linking.

Strong findings come from three patterns and stand alone. Weak candidates - identifiers, key-like strings and
endpoints - say little by themselves; one is reported only when a complementary part lies in the same scope, that is,
at most ``scope`` code points away: a key beside an identifier or endpoint, an identifier or endpoint beside a secret.
Parts are joined as intervals along each document by ordered running bounds, so no pairs are emitted.

All of it is DataFrame functions. Positions follow from splitting a text at a pattern: the pieces between matches and
the matches themselves alternate, and their lengths add up.

Defined results: a null or empty text has no spans. Repeated rows each get a row. An empty table gives an empty result.
A weak candidate that overlaps a strong span is not reported, and a part is never its own complement: a key within an
identifier or an endpoint is that one's value. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.llm.common import materialize

#: kind -> (pattern, group whose length counts, least length)
STRONG = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
WEAK = {
    "ident": (
        r"(?:(?<![A-Za-z0-9_])(?i:access_?key(?:_?id)?|client_?id|account_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}|(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{6,})",
        0,
        0,
    ),
    # some stretch without hyphens and underscores has ten characters, letters and digits among them: build names have none
    "key": (r"(?<![A-Za-z0-9+/_=.@-])(?=(?:[A-Za-z0-9+/_-]*[_-])?(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{10,})[A-Za-z0-9+/_-]{16,}={0,2}", 0, 0),
    "endpoint": (
        r"(?:(?<![A-Za-z0-9])(?i:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D\"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?![\d.])|(?<![A-Za-z0-9])(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}(?::\d+)?)",
        0,
        0,
    ),
}
#: A cheaper pattern for hex: shorter runs cannot pass, and runs are maximal either way.
FAST = {"hex": (r"[0-9a-f]{24,}", 0, 0)}
KINDS = [*STRONG, *WEAK]
SCOPE = 200
BLOCK = 512


def _running(lengths: Column) -> Column:
    """Sums of an array of longs up to each element, itself included, in time linear in practice: within blocks first."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / BLOCK).cast("int") - 1), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    within = lambda a: F.aggregate(
        a, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)) + x))
    )
    inner = F.transform(blocks, within)
    tops = F.transform(inner, lambda a: F.element_at(a, -1))
    ends = within(tops)
    return F.flatten(F.transform(inner, lambda a, b: F.transform(a, lambda x: x + F.when(b > 0, F.get(ends, b - 1)).otherwise(F.lit(0)))))


def spans_of(text: Column, kind: str) -> Column:
    """Array of struct(start, order, end) of the passing matches of one kind, in order; code points, end exclusive."""
    pattern, group, least = FAST.get(kind) or {**STRONG, **WEAK}[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    k = F.lit(KINDS.index(kind))
    steps = F.zip_with(F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda x: F.length(x).cast("long")), F.transform(whole, lambda x: F.length(x).cast("long")), lambda a, b: a + b)
    ends = _running(steps)
    rows = F.arrays_zip(ends.alias("e"), F.transform(whole, F.length).alias("l"), F.transform(counted, F.length).alias("c"))
    made = F.transform(F.filter(rows, lambda x: x["c"] >= least), lambda x: F.struct((x["e"] - x["l"]).alias("start"), k.alias("order"), x["e"].alias("end")))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<start:bigint,order:int,end:bigint>>"))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts: rid, start, order, end. The weak ones that a complementary part within ``scope`` makes reportable.

    A weak candidate that overlaps a strong span is no candidate, and a key that overlaps an identifier or an endpoint is
    that one's value and no key, so no part is its own complement. Along each document, the furthest end before a part and
    the nearest start after it, for each role, decide.
    """
    order = {k: i for i, k in enumerate(KINDS)}
    is_in = lambda *kinds: F.col("order").isin(*(order[k] for k in kinds))
    along = Window.partitionBy("rid").orderBy("start", "order", "end")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)

    def nearest(role: Column) -> tuple[Column, Column]:
        return F.max(F.when(role, F.col("end"))).over(before), F.min(F.when(role, F.col("start"))).over(after)

    def clear_of(rows: DataFrame, role: Column, who: Column) -> DataFrame:
        """Without those of ``who`` that overlap some part of the role."""
        left, right = nearest(role)
        over = F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False))
        return rows.withColumn("over", who & over).where(~F.col("over")).drop("over")

    strong = is_in(*STRONG)
    apart = clear_of(clear_of(parts, strong, ~strong), is_in("ident", "endpoint"), is_in("key"))
    cols = {}
    for r, role in (("secret", is_in("assign", "hex", "key")), ("part", is_in("access", "ident", "endpoint"))):
        cols[f"{r}_end"], cols[f"{r}_start"] = nearest(role)
    near = lambda r: F.coalesce(F.col("start") - F.col(f"{r}_end") <= scope, F.lit(False)) | F.coalesce(F.col(f"{r}_start") - F.col("end") <= scope, F.lit(False))
    return apart.withColumns(cols).where(~strong & F.when(is_in("key"), near("part")).otherwise(near("secret"))).select("rid", "start", "order", "end")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, the number of strong spans of each kind, their digest, all spans, and the number of linked weak ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(key).alias("doc_id"),
        *(spans_of(t, k).alias(f"s_{k}") for k in KINDS),
    )
    found = materialize(found, "secret-spans")
    weak = F.concat(*(F.col(f"s_{k}") for k in WEAK))
    strong = F.concat(*(F.col(f"s_{k}") for k in STRONG))
    parts = found.where(F.size(weak) > 0).select("rid", F.inline(F.concat(strong, weak)))
    extra = linked(parts, scope).groupBy("rid").agg(F.collect_list(F.struct("start", "order", "end")).alias("linked"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    both = found.join(extra, "rid", "left").withColumn("linked", F.coalesce("linked", none))
    return both.select(
        "doc_id",
        *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in STRONG),
        F.sha2(written(strong), 256).alias("base_sha256"),
        written(F.concat(strong, "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
