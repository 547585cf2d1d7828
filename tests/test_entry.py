import importlib.util
import os


def _load():
    p = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", p)
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs(spark):
    m = _load()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["sector", "p25", "p75", "listings", "iqr"]


def test_every_oracle_has_query():
    m = _load()
    assert set(m.oracle_sql()) <= set(m.queries())
