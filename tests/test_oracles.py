"""Queries whose plans are long against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from meshwork.plans.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
NAMES = [
    "degree", "triangles", "average_clustering", "assortativity", "components", "core_number", "bfs_from_first", "cheapest_from_first", "betweenness_suppliers", "eigenvector_10",
    "hvg_degree", "nvg_degree", "nvg_degree_limit", "recurrence_knn", "recurrence_radius_euclidean", "recurrence_radius_manhattan", "recurrence_radius_maximum", "series_structural", "series_likelihoods", "null_swap_summary", "null_er_summary",
]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, TABLES)
    names = sorted(found.columns)
    want = base.sql(ORACLES[name])
    assert sorted(want.columns) == names
    rows = sorted([tuple(r[c] for c in names) for r in found.collect()], key=repr)
    assert rows == sorted([tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()], key=repr)


def test_core_numbers_of_a_long_path_equal_their_sql(spark, tmp_path):
    """Values fall from a path's ends inwards: a path of 100 parts takes more rounds than a fixed 40."""
    items = [(k, p) for k in range(99) for p in (k, k + 1)]
    base = duckdb.connect()
    for name, rows, schema in (("lineitem", items, "l_orderkey long, l_partkey long"), ("part", [(p,) for p in range(100)], "p_partkey long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = base.execute(ORACLES["core_number"]).fetchall()
    assert sorted(want) == sorted((r.node, r.core) for r in QUERIES["core_number"](spark, str(tmp_path)).collect())
    assert {core for _, core in want} == {1}
