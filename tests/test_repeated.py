"""Tables that are repeated with shifted keys: buildings and the rings of brands that coincide, as in large copies."""

import shutil

import duckdb
import pytest

from terrane.functions.shapes import PREDICATES, Shape
from terrane.operators import spatial
from terrane.plans import queries

from .test_features import SF, _rows


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """(folder, connection): parts twice in the same places."""
    folder, con = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        if t == "part":
            con.execute(f"copy (select * replace (p_partkey + i * 60000 as p_partkey) from '{SF}/{t}.parquet', range(2) r(i)) to '{folder}/{t}.parquet' (format parquet)")
        else:
            shutil.copy(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


NAMES = ["m4_polygons", "m9_area_relations", "p5_containing_relations", "j12_spatial_join", "p5_points_in_relations"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, repeated, name):
    folder, con = repeated
    assert _rows(queries.QUERIES[name](spark, folder).toPandas()) == _rows(con.execute(queries.SQL[name]).df())


def test_rectangles_meet_without_shapes(spark):
    """Every predicate of rectangles and other shapes, against the shapes themselves."""
    ring = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    drawn = [Shape.polygon(ring(*r)) for r in [(0, 0, 10, 10), (0, 0, 10, 10), (10, 0, 5, 10), (2, 2, 3, 3), (8, 8, 9, 9), (40, 40, 1, 1), (0, 0, 90_000_000, 80)]]
    drawn += [Shape.polygon(ring(0, 0, 10, 10)[::-1]), Shape.polygon([(0, 0), (30, 0), (0, 30)]), Shape.line((0, 0), (50, 50))]
    rows = [(k, s.bounds.min_x, s.bounds.min_y, s.bounds.max_x, s.bounds.max_y, s.flat()) for k, s in enumerate(drawn)]
    df = spark.createDataFrame(rows, "fid long, min_x int, min_y int, max_x int, max_y int, shape array<int>")
    for name, test in PREDICATES.items():
        if name != "disjoint":
            want = sorted((i, j) for i, a in enumerate(drawn) for j, b in enumerate(drawn) if test(a, b))
            assert sorted((r.left_fid, r.right_fid) for r in spatial.spatial_join(df, df, name).collect()) == want, name
    # where neither side has a box of its own, coarse tiles make no pairs
    plan = spark._jvm.PythonSQLUtils.explainString(spatial.candidate_pairs(df, df)._jdf.queryExecution(), "simple")
    assert "OR r_own" not in plan
