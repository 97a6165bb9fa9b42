"""Registered queries against their SQL on the smallest tables."""

import time
from pathlib import Path

import duckdb
import pytest

from wordloom.plans import bindings
from wordloom.plans.queries import ORACLE, QUERIES, doc_responses
from wordloom.sources import responses
from wordloom.storage import shared_dir

SF = "/root/testdata/sf0.001"
SOME = ("edge_orientation", "edge_dedup", "bfs_depth", "prune_round_2", "scc_labels", "topo_level", "tr_full", "refine_pipeline", "node_url", "url_change_log", "tr_two_hop_parts", "scc_sizes", "scc_members", "intra_scc_edges", "tr_two_hop_handoff", "tr_full_handoff", "json_roundtrip", "param_parse", "search_enabled", "condensed_edge_originals")


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_json_roundtrip_of_all_documents(spark):
    columns = ["e_id", "n_id", "is_p"]
    want, got = bindings.doc_tuples(spark, SF), QUERIES["json_roundtrip"](spark, SF)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    bodies = doc_responses(spark, SF)
    vertices = bindings.doc_vertices(spark, SF)
    assert bodies.count() == vertices.count()
    columns = ["v_id", "word", "lang"]
    back = responses.decode_vertices(bodies).select(columns).distinct()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vertices.select(columns).collect()))


def test_parts_take_little_disk(spark, tmp_path):
    """Shuffle files and written tables of tr_two_hop_parts, for each line item."""
    spark.sql("select /*+ repartition(1) */ id div 4 as l_orderkey, id * 7919 % 6000 as l_partkey, id * 104729 % 300 as l_suppkey, cast(id % 4 + 1 as int) as l_linenumber from range(180000)").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def used():
        files = disk.getAllFiles()
        written = Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet")
        return sum(files.apply(i).length() for i in range(files.size())) + sum(p.stat().st_size for p in written)

    spark._jvm.System.gc()  # the files of earlier tests go first
    time.sleep(3)
    before = used()
    QUERIES["tr_two_hop_parts"](spark, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/out")
    assert used() - before < 30 * 180_000


def test_parts_with_null_and_negative_keys(spark, tmp_path):
    lines = [(1, 2, 3, 1), (1, 2, 4, 2), (None, 2, 3, 1), (1, None, 3, 2), (-5, -6, -7, 1), (-5, -6, 0, 2), (1, 2, 3, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["tr_two_hop_parts"](spark, f"file://{tmp_path}")
    want = con.sql(ORACLE["tr_two_hop_parts"])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
