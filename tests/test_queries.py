import math
import os

import duckdb
import pytest

from motionloom.plans import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"m05_importances", "m01_cluster_scores"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the standing tables")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_voice_query_computes_its_measures(spark):
    got = {}
    for r in registry.queries()["v20_voice_measures"](spark, DATA).collect():
        got.setdefault(r["key"], {})[r["feature"]] = r["value"]
    assert sorted(got) == [0, 1]  # suppliers 0 to 7, 8 and 9
    for k in ("Jitter->F0_abs_dif", "HNR_mean", "GNE_mean", "VFER_mean", "mean_mfcc_0", "DFA", "RPDE", "IMF_SNR_SEO"):
        assert all(math.isfinite(m[k]) for m in got.values()), k
    assert all(math.isfinite(got[0][k]) for k in ("PPE", "Ea"))
