"""Every query of the library against its SQL on the smallest tables, and shuffle invariance of some."""

import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names():
    from tidemark.plans import registry

    return sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(map(repr, (tuple(float(f"{v:.6g}") if isinstance(v, float) else v for v in r) for r in rows)))


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from tidemark.plans import registry

    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*(f"`{c}`" for c in cols)).collect()]
    if name not in registry.ORACLE:
        return
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"select {quoted} from ({registry.ORACLE[name]})").fetchall()
    assert plain(rows) == plain(want)


def test_entry_imports_without_the_text_folder(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert "op5_simhash" not in entry.queries() and entry.oracle_sql()
