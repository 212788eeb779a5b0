"""Folds against plain loops, layout invariants, files, archives, streams."""

import gzip
import io
import random
import zipfile
import zlib

import numpy as np
import pytest

from timedtext.functions import similarity
from timedtext.functions.similarity import Cascade
from timedtext.operators import layout, merging, timeline
from timedtext.sources import archives, export, payloads


def made(spark, n=400, seed=3, span=300.0):
    r = random.Random(seed)
    words = ["hello", "hallo", "hello!!", "world", "worlds", "哈哈哈", "哈哈", "x", "abcabc"]
    rows = [(i, f"s{i % 2}", round(r.random() * span, 3), r.choice([1, 1, 1, 4, 5]), r.randrange(2**24), r.choice(words)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "cid long, source string, time double, type int, color int, text string")


def test_fuzzy_assign_is_one_pass(spark):
    rows, df = made(spark)
    c = Cascade(max_dist=2)
    got = {r["cid"]: (r["leader"], r["reason"]) for r in merging.fuzzy_assign(df, ["source"], threshold=4, cascade=c).collect()}
    norms = {r["cid"]: r["norm"] for r in merging.fuzzy_assign(df, ["source"], threshold=4, cascade=c).collect()}
    for s in ("s0", "s1"):
        live = []
        for cid, _, t, kind, _, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (int(r[2] * 1000 + 0.5), r[0])):
            ms = int(t * 1000 + 0.5)
            live = [x for x in live if ms - x[0] <= 4000]
            f = c.features(norms[cid])
            hit = next(((leader, why) for _, leader, g in reversed(live) if (why := c.compare(f, g))), None)
            if hit is None:
                live.append((ms, cid, f))
                hit = (cid, "orig")
            assert got[cid] == hit


def test_lanes_do_not_collide(spark):
    _, df = made(spark, 300, span=120.0)
    rows = layout.with_length(layout.timed(df).where("type = 1").selectExpr("cid", "source", "text", "start_time", "end_time", "200 as size"))
    placed = [r for r in layout.lanes_rolling(rows, ["source"]).collect() if r["y"] is not None]
    assert placed
    for s in ("s0", "s1"):
        mine = sorted((r for r in placed if r["source"] == s), key=lambda r: (r["start_time"], r["cid"]))
        for i, b in enumerate(mine):
            for a in mine[:i]:
                if a["end_time"] > b["start_time"] and a["y"] < b["y"] + 200 and b["y"] < a["y"] + 200:
                    # the front row's tail is left of the follower's head when that enters and when the front row leaves
                    for t in (b["start_time"], a["end_time"]):
                        tail = 1920 + a["length"] - (a["length"] + 1920) / 15 * (t - a["start_time"])
                        assert tail <= 1920 - (b["length"] + 1920) / 15 * (t - b["start_time"]) + 1e-6


def first_fit(rows, size, height, upward, meets):
    """The nearest place to the edge where no row in the way meets the new one, by trying all."""
    places = range(height - size + 1, 0, -1) if upward else range(1, height - size + 2)
    return next((y for y in places if not any(y < r["y"] + r["size"] and r["y"] < y + size and meets(r) for r in rows)), None)


def test_lanes_by_trying_all_places():
    r = random.Random(12)
    for trial in range(20):
        screen, rows, now = layout.Screen(100), [], 0.0
        for _ in range(60):
            now += r.choice([0, 0, 0.5, 1, 2.5])
            size, length = r.choice([10, 17, 30]), r.choice([10.0, 200.0, 900.0])
            rows = [x for x in rows if x["end"] > now]
            if trial % 2:
                speed = (length + 1920) / 15
                meets = lambda x: any(1920 + x["length"] - x["speed"] * (t - x["start"]) > 1920 - speed * (t - now) + 1e-9 for t in (now, x["end"]))  # noqa: B023, E731
                y, got, end = first_fit(rows, size, 100, False, meets), layout.roll(screen, now, length, size, 15), now + 15
            else:
                upward = r.random() < 0.5
                y, got, end = first_fit(rows, size, 100, upward, lambda x: True), layout.stack(screen, now, size, 5, upward), now + 5
            assert got == y
            if y is not None:
                rows.append({"y": y, "size": size, "start": now, "end": end, "length": length, "speed": (length + 1920) / 15})


def test_slices_do_not_show(spark):
    """Numbers, stretches and values on screen are those of one pass over each stream, whatever the slices."""
    from pyspark.sql import functions as F

    rows, df = made(spark, 500, span=5000.0)
    df = df.unionByName(spark.createDataFrame([(900, None, 3.0, 1, 0, "x"), (901, "s0", None, 1, 0, "x"), (902, "s0", None, 1, 0, "y"), (903, "s1", 17.0, 1, 0, "y"), (904, "s1", 17.0, 1, 0, "yy")], df.schema))
    rows = [tuple(r) for r in df.collect()]
    first = lambda r: (r[2] is not None, r[2] or 0, r[1] or "", r[0])
    for stream in (["source"], None):
        expected = {}
        for s in {r[1] for r in rows} if stream else {None}:
            mine = sorted((r for r in rows if not stream or r[1] == s), key=first)
            expected |= {r[0]: k + 1 for k, r in enumerate(mine)}
        assert {r["cid"]: r["ord"] for r in timeline.ordered(df, stream, span=0.7).collect()} == expected
    for gap in (0, 1, 9):
        expected = {}
        for s in {r[1] for r in rows}:
            number, last = 0, None
            for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
                number += not (last is not None and r[2] is not None and r[2] - last <= gap)
                last = r[2]
                expected[r[0]] = number
        assert {r["cid"]: r["session"] for r in timeline.sessions(df, gap, ["source"], order=["cid"]).collect()} == expected
    timed = df.where("time is not null").withColumn("t_ms", F.floor(F.col("time") * 1000 + 0.5).cast("bigint"))
    for span in (40, 5000):
        got = {r["cid"]: r["onscreen"] for r in merging.on_screen(timed, ["source"], F.char_length("text").cast("double"), span_ms=span).collect()}
        ms = {r[0]: int(r[2] * 1000 + 0.5) for r in rows if r[2] is not None}
        assert len(got) == len(ms)
        for r in rows:
            if r[2] is not None:
                assert got[r[0]] == sum(len(q[5]) for q in rows if q[1] == r[1] and q[2] is not None and ms[r[0]] - span <= ms[q[0]] and (ms[q[0]], q[0]) <= (ms[r[0]], r[0]))


def test_colour_leaders_in_order(spark):
    r = random.Random(2)
    colours = [r.choice([0, 0x101010, 0x808080]) + r.randrange(40) * 0x10000 + r.randrange(40) * 0x100 + r.randrange(40) for _ in range(400)]
    palette, leaders = merging.Palette(15), []
    apart = lambda a, b: sum((((a >> k) & 255) - ((b >> k) & 255)) ** 2 for k in (0, 8, 16)) ** 0.5
    for c in colours:
        found = next((x for x in leaders if apart(x, c) <= 15), c)
        if found == c and c not in leaders:
            leaders.append(c)
        assert palette.leader(c) == found
    assert len(leaders) > 20


def test_equal_texts_merge_by_one_pass(spark):
    rows, df = made(spark, 300, span=60.0)
    got = {r["cid"]: (r["merge_count"], r["out_text"]) for r in merging.tolerance_merge(df, 5, stream=["source"]).collect()}
    expected = {}
    for key in {(r[1], r[5], r[3]) for r in rows}:
        run = []
        for r in [*sorted((r for r in rows if (r[1], r[5], r[3]) == key), key=lambda r: (r[2], r[0])), None]:
            if run and (r is None or r[2] - run[0][2] > 5):
                n = len(run)
                expected[run[0][0]] = (n, key[1] + (f"x{n}" if n > 2 or len({x[2] for x in run}) > 1 else ""))
                run = []
            run.append(r)
    assert got == expected


def test_rows_that_do_not_merge_pass_through(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1, 5, "hello"), (2, "a", 2.0, 1, 6, "hello"), (3, "a", 2.5, 7, 7, "hello"), (4, "a", 3.0, 1, 8, ""), (5, "a", 3.0, None, 8, "hello"), (6, "a", 3.0, 1, 8, None)], "cid long, source string, time double, type int, color int, text string")
    got = sorted((r["leader"], r["text"], r["merge_count"], r["merge_reason"]) for r in merging.merge_all(df, ["source"]).na.fill("none").collect())
    assert got == [(1, "hello(2)", 2, "identical"), (3, "hello", 1, "orig"), (4, "", 1, "orig"), (5, "hello", 1, "orig"), (6, "none", 1, "orig")]
    plain = merging.fuzzy_merge(merging.fuzzy_assign(spark.createDataFrame([(k, "a", float(k), 1, 0, t) for k, t in enumerate(["yes!", "yes~", "yes~", "yes!", "yes"])], df.schema), ["source"]), normalize_display=False)
    assert [r["text"] for r in plain.collect()] == ["yes~(5)"]


def test_fingerprints_and_file_heads(spark):
    import hashlib

    from pyspark.sql import functions as F

    from timedtext.functions import addresses

    def brute(data):
        h = 5381
        for b in data:
            h = (h * 33 + b) % 2**32
        return f"{h:08x}"

    texts = ["", "a", "é😀", "x" * 100 + "1", "x" * 100 + "2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.times33(F.encode("t", "UTF-8")).alias("f")).collect()
    assert all(r["f"] == brute(r["t"].encode()) for r in rows)
    big = b"ab" * (8 * 1024 * 1024)
    files = spark.createDataFrame([(bytearray(big + b"tail"),), (bytearray(big),), (bytearray(b"short"),)], "content binary")
    got = [r[0] for r in files.select(addresses.head_hash(F.col("content"))).collect()]
    assert got == [hashlib.md5(big).hexdigest()] * 2 + [None]
    # published vectors of the cipher's standard, first block
    key, data = F.unhex(F.lit("2b7e151628aed2a6abf7158809cf4f3c")), F.unhex(F.lit("6bc1bee22e409f96e93d7e117393172a"))
    iv = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))
    ecb, cbc = spark.range(1).select(F.hex(addresses.aes_encrypt(data, key)), F.hex(addresses.aes_encrypt(data, key, "CBC", iv))).first()
    assert ecb.startswith("3AD77BB40D7A3660A89ECAF32466EF97") and cbc.startswith("7649ABAC8119B246CEE98E9B12E9197D")


def test_histories_are_written(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "path string, n int, note string")
    export.write_history(rows, "path", str(tmp_path / "h"))
    export.write_history(rows, "path", str(tmp_path / "h"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "h")).collect()]
    assert [json.loads(x) for x in lines] == [{"a": {"n": 1, "note": "x"}, "b": {"n": 2}}]


def test_fixed_rows_do_not_overlap(spark):
    _, df = made(spark, 200, span=100.0)
    rows = layout.timed(df).where("type > 3").selectExpr("cid", "source", "type", "start_time", "end_time", "300 as size")
    placed = [r for r in layout.lanes_fixed(rows, ["source"]).collect() if r["y"] is not None]
    for i, b in enumerate(placed):
        for a in placed[:i]:
            if a["source"] == b["source"] and a["start_time"] < b["end_time"] and b["start_time"] < a["end_time"]:
                assert a["y"] + 300 <= b["y"] or b["y"] + 300 <= a["y"]


def test_empty_tables(spark):
    _, df = made(spark, 2)
    none = df.limit(0)
    assert merging.tolerance_merge(none, 5).count() == 0
    assert merging.fuzzy_assign(none, ["source"]).count() == 0
    assert timeline.near_pairs(none, 5).count() == 0


def test_band_join_has_an_equal_key(spark):
    _, df = made(spark, 20)
    plan = timeline.near_pairs(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_delay_probe(spark):
    from pyspark.sql import functions as F

    segs = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("delay")) for a, b in ((0.0, 2.0), (100.0, -1.5))))
    t = spark.createDataFrame([(0.0,), (0.001,), (100.0,), (100.001,)], "t double")
    got = [tuple(r) for r in t.select(timeline.delay_at(segs, F.col("t")), timeline.delay_at(segs, F.col("t"), inclusive=True)).collect()]
    assert got == [(0.0, 2.0), (2.0, 2.0), (2.0, 0.5), (0.5, 0.5)]


def test_xml_reader(spark):
    body = '<i><d p="3,1,25,16777215,x">a &amp; b</d><d id="1" p="1.5,4,30,255">c</d><d p="1,2,3">short</d><d p="a,1,25,1">bad</d><d xp="1,1,1,1">no</d><d p="1,1,25,1"></d></i>'
    rows = payloads.xml_comments(spark.createDataFrame([(body,)], "payload string")).collect()
    assert [(r["time"], r["type"], r["size"], r["color"], r["text"]) for r in rows] == [(3.0, 1, 25, 16777215, "a & b"), (1.5, 4, 30, 255, "c")]


def test_files_round_trip(spark, tmp_path):
    _, df = made(spark, 50)
    export.write_xml(df, str(tmp_path / "out.xml"), "filtered")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out.xml")).collect()]
    assert lines[0] == export.HEADER and lines[-1] == "</i>" and "stage=filtered" in lines[1]
    one = tmp_path / "in"
    one.mkdir()
    (one / "a.xml").write_text("\n".join(lines), encoding="utf-8")
    back = payloads.read_files(spark, str(one))
    assert back.count() == 50 and {r["stage"] for r in back.select("stage").distinct().collect()} == {"filtered"}
    assert export.mode_of("MERGED") == "merged" and export.mode_of("zzz") == "raw" and export.mode_of(None) == "raw"


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x.xml", "zip")
    for name, data in (("a.z", buffer.getvalue()), ("b.z", gzip.compress(b"gzip")), ("c.z", zlib.compress(b"zlib")), ("d.z", b"plain"), ("e.z", b"PK\x03\x04broken")):
        (tmp_path / name).write_bytes(data)
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["payload"] for r in rows if r["payload"]) == ["gzip", "plain", "zip", "zlib"]
    assert sum(r["error"] is not None for r in rows) == 1


@pytest.mark.parametrize("kind", ["fuzzy", "dedup", "tolerance", "onscreen"])
def test_streams_equal_batch(spark, tmp_path, kind):
    from pyspark.sql import functions as F

    from timedtext.streaming import stateful

    rows, df = made(spark, 120, span=60.0)
    timed = df.withColumn("ts", F.timestamp_millis(F.floor(F.col("time") * 1000 + 0.5).cast("bigint")))
    late = spark.createDataFrame([(9999, "end", 10_000.0, 1, 0, "end")], "cid long, source string, time double, type int, color int, text string").withColumn("ts", F.timestamp_millis(F.lit(10_000_000).cast("bigint")))
    timed.repartition(3).write.parquet(str(tmp_path / "in/part1"))
    late.write.parquet(str(tmp_path / "in/part2"))
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    if kind == "fuzzy":
        out = stateful.fuzzy_assign(stream, "source", delay="200 seconds", threshold=4)
        expected = {r["cid"]: (r["leader"], r["reason"]) for r in merging.fuzzy_assign(df, ["source"], threshold=4).collect()}
        value = lambda r: (r["leader"], r["reason"])
    elif kind == "dedup":
        out = stateful.trigger_dedup(stream, "text", delay="200 seconds")
        expected = {r["cid"]: r["accepted"] for r in merging.trigger_dedup(df, "text").collect()}
        value = lambda r: r["accepted"]
    elif kind == "onscreen":
        out = stateful.on_screen(stream, "source", delay="200 seconds")
        whole = df.withColumn("t_ms", F.floor(F.col("time") * 1000 + 0.5).cast("bigint"))
        expected = {r["cid"]: round(r["onscreen"], 6) for r in merging.on_screen(whole, ["source"], F.sqrt(F.char_length("text"))).collect()}
        value = lambda r: round(r["onscreen"], 6)
    else:
        out = stateful.tolerance_merge(stream, "text", delay="200 seconds")
        anchors = {r["cid"] for r in merging.tolerance_merge(df, 5, by_type=False).collect()}
        expected, value = None, None
    query = out.writeStream.format("memory").queryName(f"out_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    try:
        query.processAllAvailable()
        got = [r for r in spark.sql(f"select * from out_{kind}").collect() if r["cid"] != 9999]
    finally:
        query.stop()
    assert len(got) == len(rows)
    if expected is None:
        assert {r["anchor"] for r in got} == anchors
    else:
        assert {r["cid"]: value(r) for r in got} == expected


def test_late_rows_are_counted(spark, tmp_path):
    from timedtext.streaming import stateful

    schema = "cid long, source string, ts timestamp, type int, text string"
    times = [["2024-01-01 00:00:00", "2024-01-01 00:10:00"], ["2024-01-01 00:10:01"], ["2024-01-01 00:00:30", "2024-01-01 00:00:40", "2024-01-01 00:11:00"]]
    for k, part in enumerate(times):
        rows = spark.createDataFrame([(10 * k + i, "a", t, 1, "x") for i, t in enumerate(part)], "cid long, source string, t string, type int, text string")
        rows.selectExpr("cid", "source", "cast(t as timestamp) as ts", "type", "text").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = stateful.session_counts(stream, "source", delay="1 second").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    try:
        query.processAllAvailable()
        assert stateful.late_rows(query) == 2
    finally:
        query.stop()


def test_rule_files_are_edited_in_place(tmp_path):
    from timedtext.sources.rulefile import RuleFile

    xml = tmp_path / "r.xml"
    xml.write_text('<?xml version="1.0"?>\n<filters>\n  <item enabled="true">t=a</item>\n<!-- note -->\n</filters>\n', encoding="utf-8")
    f = RuleFile(str(xml))
    assert f.add("b") and not f.add("b") and not f.add("  ")
    f.toggle(0)
    assert f.add("a") and [(r.pattern, r.enabled) for r in RuleFile(str(xml)).rules] == [("a", True), ("b", True)]
    assert "<!-- note -->" in xml.read_text(encoding="utf-8") and xml.read_text(encoding="utf-8").rstrip().endswith("</filters>")
    f.edit(1, "c")
    f.delete(0)
    assert [r.pattern for r in RuleFile(str(xml)).rules] == ["c"]
    js = tmp_path / "r.json"
    js.write_text('[{"type":1,"filter":"z"},{"type":0,"filter":"a","opened":false,"id":7}]')
    g = RuleFile(str(js))
    assert g.add("a") and g.add("n") and '"id": 7' in js.read_text() and len(RuleFile(str(js)).rules) == 2 and '"type": 1' in js.read_text()
    txt = tmp_path / "r.txt"
    txt.write_text("one\n\n two \n")
    h = RuleFile(str(txt))
    h.delete(0)
    assert txt.read_text() == "two\n"
    h.path = str(tmp_path / "missing" / "r.txt")
    with pytest.raises(OSError):
        h.add("three")
    assert [r.pattern for r in h.rules] == ["two"]


def test_scored_pairs_are_those_of_the_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(5)
    words = ["hello", "hallo", "hello!!", "world", "worlds", "哈哈哈", "哈哈", "x", "xx", "abcabc", "abcabcabcabc", "😀a😀", "", None]
    times = [*(round(r.random() * 400, 1) for _ in range(300)), *(7.0 for _ in range(60)), 8.0, 8.5, -31.0, -0.5, 1e12, 1e12 + 2, None, float("nan"), float("inf"), float("inf")]
    rows = [(i, r.choice(["s0", "s1", None]), t, r.choice(words)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "cid long, source string, time double, text string").repartition(3)
    for sounds in ({}, {"哈": ["h", "a"], "x": ["a", "h"]}):
        cascade = Cascade(max_dist=2, sounds=sounds)
        for seconds, group, batch, pairs, table in ((1.5, 20, "7", 50, 0), (1.5, 20_000, "10000", 1 << 18, 1 << 22), (0, 9, "3", 4, 1 << 22), (1000, 100, "64", 1000, 0)):
            monkeypatch.setattr(timeline, "GROUP", group)
            monkeypatch.setattr(timeline, "PAIRS", pairs)
            monkeypatch.setattr(similarity.Texts, "TABLE", table)
            monkeypatch.setattr(similarity.Bags, "BLOCK", 40 if table else 1 << 20)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            try:
                got = [tuple(x) for x in timeline.scored_pairs(df, seconds, "text", cascade.reasons, "string", stream=["source"]).collect()]
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            expected = []
            for a in rows:
                for b in rows:
                    if a[1] == b[1] and None not in (a[2], b[2]) and (b[2], b[0]) > (a[2], a[0]) and b[2] - a[2] <= seconds:
                        why = cascade.compare(cascade.features(a[3] or ""), cascade.features(b[3] or ""))
                        expected += [(a[0], b[0], why)] if why else []
            assert sorted(got) == sorted(expected)
    assert {why for *_, why in expected} == {"identical", "edit", "pinyin", "cosine"}
    assert timeline.scored_pairs(df.limit(0), 5, "text", Cascade().reasons, "string").count() == 0
    assert timeline.scored_pairs(df.where(F.col("cid") == 3), 5, "text", Cascade().reasons, "string").count() == 0


def test_distances_of_places_are_those_of_texts():
    r = random.Random(8)
    texts = sorted({"".join(r.choice("abc哈😀 ") for _ in range(r.randrange(9))) for _ in range(80)})
    made_of, plain = similarity.Texts(texts), [Cascade().features(t) for t in texts]
    i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
    assert made_of.char_distance(i, j).tolist() == [plain[a].apart(plain[b], True) for a, b in zip(i, j)]
    assert made_of.bigram_score(i, j).tolist() == [plain[a].score(plain[b]) for a, b in zip(i, j)]
