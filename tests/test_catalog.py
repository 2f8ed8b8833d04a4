"""The catalog against its SQL on the smallest tables, where they are at hand."""

import os

import duckdb
import pytest

from quarry.operators.index import Index
from quarry.plans import catalog
from quarry.plans.api import build_index

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
SOME = ["role_histogram", "fingerprint", "tok_content", "bm25f_content", "hybrid_default", "quick_balanced", "budget_tokens", "chunk_counts", "edges_non_vendored", "pagerank_norm", "rrf_two_lists", "merge_incremental", "render_compact", "usage_gain", "stream_sessions", "embedding_cosine"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    want = duck.execute(catalog.oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


def test_index_round_trip(spark, tmp_path):
    files = catalog.corpus(spark, DIR).limit(20)
    build_index(files, rounds=2).save(str(tmp_path / "i"))
    assert Index.load(spark, str(tmp_path / "i")).docs.count() == files.count() and Index.load(spark, str(tmp_path / "none")) is None
