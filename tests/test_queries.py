"""Every registered query against its DuckDB oracle."""

import math

import pytest

from timedtext.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
        assert rows == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


def crowded(tmp_path, n, every=0.4):
    """Events dense enough that screens are full, in a folder of their own, and a connection that sees them."""
    import duckdb

    con = duckdb.connect()
    kinds = "['click', 'view', 'error', 'signup', 'purchase']"
    con.execute(
        f"""create table events as select i as event_id, timestamp '2024-01-01' + to_microseconds(cast(floor(i * {every}) * 50000000 as bigint)) as ts, i * 7 % 12 as user_id,
 {kinds}[1 + i * i % 5] as event_type, 1.0::double as value, '{{"k": ' || (i * 13 % 101) || '}}' as props from range({n}) r(i)"""
    )
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    return con


def same_as_sql(spark, tmp_path, name, con):
    got = QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
    return rows


def test_density_drop_draws_as_its_sql(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "density_drop", crowded(tmp_path, 6000))
    assert 0 < sum(drop for _, drop in rows) < len(rows)


def quick_on_crowds(spark, tmp_path, name):
    """As its SQL on a short crowd; millions of pairs of few texts take seconds, far from what each pair by itself takes."""
    import time

    same_as_sql(spark, tmp_path, name, crowded(tmp_path, 500, 0.1))
    con = crowded(tmp_path, 6000, 0.01)
    began = time.time()
    found = QUERIES[name](spark, str(tmp_path)).selectExpr("count(*)", "bit_xor(xxhash64(*))").first()[0]  # reads all columns
    assert time.time() - began < 25
    pairs = con.execute("with n as (select event_id as i, user_id % 4 as s, floor((epoch_us(ts) - 1704067200000000) // 100000) / 1000.0::double as t from events where event_id % 8 <> 7) select count(*) from n a join n b on a.s = b.s and (b.t, b.i) > (a.t, a.i) and b.t - a.t <= 30").fetchall()[0][0]
    assert pairs > 3_000_000
    return found, pairs


def test_similar_pairs_of_crowds(spark, tmp_path):
    found, pairs = quick_on_crowds(spark, tmp_path, "similar_pairs")
    assert 0 < found < pairs


def test_char_distance_pairs_of_crowds(spark, tmp_path):
    found, pairs = quick_on_crowds(spark, tmp_path, "char_distance_pairs")
    assert found == pairs


def test_bigram_cos2_pairs_of_crowds(spark, tmp_path):
    found, pairs = quick_on_crowds(spark, tmp_path, "bigram_cos2_pairs")
    assert found == pairs
