import glob
import os

import duckdb
import pytest

from rollprobe.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["sr_total", "sr_rollup", "sr_selection", "lr_total", "radius_cascade", "interface", "ts_kinetics", "flatten_stats", "gram_matrix", "altloc_dedup", "structure_totals", "topology_join", "empty_frames", "lr_centers", "supplied_pairs", "unknown_radius", "mass_elements", "item_warnings", "report_rsa", "report_log", "report_json", "csv_class_selection", "padded_points", "pdb_read", "mmcif_read", "psf_read", "residue_runs_structures", "feature_bundle", "ts_uncertainty", "ts_autocorr"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    cur = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})")
    key = lambda r: tuple((x is None, x) if not isinstance(x, float) else (False, x) for x in r)
    assert sorted(rows, key=str) == sorted(cur.fetchall(), key=str) or sorted(map(key, rows)) == sorted(map(key, cur.fetchall()))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) > 40


def test_far_parts(spark, tmp_path):
    """Keys of a table 60 times as large: their z has more digits than the field of a PDB line."""
    keys = [*range(60), *range(1_192_000, 1_192_060)]
    con = duckdb.connect()
    con.execute(f"create table part as select k::bigint as p_partkey, 'Brand#' || k % 9 as p_brand, (k % 50)::int as p_size from (select unnest({keys}) as k)")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    for name in ("pdb_read", "pdb_align"):
        got = QUERIES[name](spark, str(tmp_path))
        cols = got.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall(), key=str)
