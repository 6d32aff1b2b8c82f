"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from wavemill.plans import audits, rules, signals  # noqa: F401
from wavemill.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    return sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_summaries_hold_one_day(spark, sf, monkeypatch):
    """No text grows with all the events of a user."""
    from wavemill.plans import queries

    seen = []
    monkeypatch.setattr(queries, "parse_summaries", lambda texts: seen.append(texts) or [texts.selectExpr("*", *[f"1 AS {c}" for c in "case_id recording_id seizure_index onset_seconds offset_seconds duration_seconds".split()])] * 3)
    QUERIES["str_parse_blocks"](spark, sf)
    texts = seen[0].selectExpr("path", "size(split(text, 'File Name:')) - 1 AS n").toPandas()
    assert len(texts) and texts["n"].eq(1).all() and texts["path"].is_unique
