"""Registered queries against their SQL on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline import queries as graph

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if x is not None else None


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def shared_tables(spark, tmp_path_factory):
    """Derived tables are made once for all queries of this module."""
    made, folder, whole = {}, tmp_path_factory.mktemp("derived"), graph.derive

    def derive(session, sf_dir, name):
        if name not in made:
            path = f"file://{folder}/{name}"
            whole(session, sf_dir, name).write.parquet(path)
            made[name] = path
        return session.read.parquet(made[name])

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "derive", derive)
        yield


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(graph.ORACLES))
def test_same_rows_as_sql(spark, duck, shared_tables, name):
    df = graph.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    got = duck.execute(graph.ORACLES[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str)
    assert ours and ours == theirs


def test_every_query_is_listed():
    assert set(graph.ORACLES) <= set(graph.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "weftline.llm", "corpus_pipeline"])
def test_entry_without_an_import(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout
    assert int(out.split()[0]) >= len(graph.QUERIES) and int(out.split()[1]) >= len(graph.ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["parent", "child", "name", "kind", "has_children"]
