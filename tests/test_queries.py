"""Every core query against its SQL on the smallest data, where it lies."""

import os

import duckdb
import pytest

from cueloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and x != x or str(x) in ("<NA>", "NaT"):
        return None
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else str(round(x, 6))
    return str(x)


def rows(frame):
    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        want = con.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_subpackage_is_optional():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "cueloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "cueloom.llm" not in path.read_text(encoding="utf-8"), path
