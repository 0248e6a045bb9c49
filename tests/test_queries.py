"""Every registered query against its SQL, and the entry points."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    got = registry.queries()[name](spark, sf_dir)
    found = oracle.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert plain(got.select(*sorted(names)).collect()) == plain([tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pooled_vectors_keep_the_sign_of_zero(spark, tmp_path):
    odd = [[-1e-7, 1e-7, -2.4e-7, -2.6e-7], [-0.0, 0.0], [float("nan"), float("inf"), float("-inf"), None, -3.4e38], [k / 256 for k in range(-4, 5)], [], None]
    spark.createDataFrame(list(enumerate(odd)), "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in registry.queries()["mean_pooled"](spark, str(tmp_path)).orderBy("vec_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()["mean_pooled"]).fetchall()
    assert repr(got) == repr(sorted(found, key=lambda r: r[0]))  # by repr: -0.0 equals 0.0
    assert repr(got[0][1]) == "[-0.0, 0.0, -0.0, -1e-06]" and repr(got[1][1]) == "[-0.0, 0.0]"
