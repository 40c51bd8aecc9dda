"""Entry contract, and a few whole queries against their SQL text."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "lineitem orders events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_sql_text_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 130


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["A5_frame_rollup", "J3_track_interpolation", "U4_label_edit_fold", "A15_per_label_metrics", "X2_auto_pause_stream"])
def test_against_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in res.description]

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == want
