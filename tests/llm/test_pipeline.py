"""The corpus pipeline against plain versions of its stages."""

import re

import corpus_pipeline as pipeline
from timedtext.llm.common import materialize, table

from .test_ops import groups, linked_spans, strong_spans


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [" " + " ".join(re.findall(r"[^\W_]+", r["text"].lower())) + " " for r in table(spark, sf_dir, "benchmark").collect()]
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    expect = {
        "language": lambda d: {i: t for i, t in d.items() if t and re.search(r"[^\W\d_]", t)},
        "near_duplicates": lambda d: {i: t for i, t in d.items() if groups(list(d.items()))[i][1] == i} if len(d) < 50 else {i: d[i] for i, (_, c) in groups(list(d.items())).items() if c == i},
        "benchmark_leaks": lambda d: {i: t for i, t in d.items() if not any(x in plain(t) for x in items)},
        "credentials": lambda d: {i: t for i, t in d.items() if not strong_spans(t) and not linked_spans(t)},
    }
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if name == "sequences":
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(kept)
            continue
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == expect[name](kept)
        kept = got
    assert pipeline.run(spark, sf_dir).count() == docs.count()


def test_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_edges(spark, sf_dir):
    """Nulls, repeats, ties, long texts and columns with names that are used inside."""
    plain = [r["text"] for r in table(spark, sf_dir, "documents").where("lang = 'en' and n_chars > 400").orderBy("doc_id").limit(6).collect()]
    long = " ".join(plain * 400)
    rows = [(1, plain[0]), (1, plain[0]), (2, plain[0]), (None, plain[0]), (3, None), (4, ""), (5, "12 34"), (6, plain[1] + " password=hunter22x"), (7, long), (None, plain[2]), (8, plain[3]), (8, plain[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", "h") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __row string, key string")
    kept = []
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        kept.append(sorted(((r["doc_id"] is None, r["doc_id"]) for r in docs.select("doc_id").collect()), key=str))
    ids = lambda *x: sorted(((i is None, i) for i in x), key=str)
    assert kept[0] == ids(1, 1, 2, None, 6, 7, None, 8, 8)
    # one of the two rows without an id stays, so both do
    assert kept[1] == ids(1, 6, 7, None, None, 8, 8)
    assert kept[3] == ids(1, 7, None, None, 8, 8)
    assert {i for _, i in kept[4]} == {1, 7, None, 8}
