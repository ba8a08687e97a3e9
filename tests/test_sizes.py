"""What shows on larger tables alone, on small ones with small limits."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest

from isospark import queries, session
from isospark.functions import scalar as S
from isospark.operators import cluster, coverage, peaks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _sql(sql: str) -> list[tuple]:
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_numbers_beyond_their_digits(spark):
    """Numbers longer than the id has digits for are cut as by the SQL's ``lpad``."""
    exons = queries._view(spark, SF, "v_exons")
    assert exons.count() > 1000
    got = queries.numbered_features(exons, digits=3)
    want = queries.ORACLES["numbered_features"].replace(", 7, '0')", ", 3, '0')")
    assert want != queries.ORACLES["numbered_features"]
    assert sorted(tuple(r) for r in got.select("id", "contig", "strand", "tid", "s", "e").collect()) == _sql(want)


@pytest.mark.parametrize("view", ["v_exons", "v_class", "v_junc"])
def test_parts_do_not_grow_with_the_table(spark, monkeypatch, view):
    """Rows of an order are dealt to as many parts as the table needs, not to a fixed number."""
    monkeypatch.setattr(session, "PART_ROWS", 200)
    rows = queries._view(spark, SF, view)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in sizes) <= 2 * 200


@pytest.mark.parametrize("name", ["same_name_suppression", "collapse_introns", "cluster_presence"])
def test_small_parts_change_nothing(spark, monkeypatch, name):
    monkeypatch.setattr(session, "PART_ROWS", 200)
    df = queries.QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(tuple(r) for r in df.collect()) == _sql(f"SELECT {cols} FROM ({queries.ORACLES[name]})")


def test_introns_are_counted_once(spark):
    """The fold over the reads' alignments is not in the plan that neighbours and both sides' depths are joined by."""
    df = queries.QUERIES["intron_calls"](spark, SF)
    assert "lineitem" not in "".join(df.inputFiles())
    assert df.count() > 0


@pytest.mark.parametrize("name", ["dedupe_first", "intron_method_matrix_first", "intron_method_matrix_sum", "intron_neighbour_filter", "leader_merge", "site_calls", "collapse_tes", "collapse_tss", "fp_seed_clusters", "point_gtf", "attr_parse"])
def test_shuffles_after_the_views_have_parts_enough(spark, monkeypatch, name):
    """Every shuffle has as many parts as the rows of the largest table need; the caller's session stays as it is."""
    monkeypatch.setattr(session, "PART_ROWS", 200)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    own = spark.conf.get("spark.sql.shuffle.partitions")
    df = queries.QUERIES[name](spark, SF)
    assert int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) == -(-rows // 200)
    assert df.sparkSession.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert spark.conf.get("spark.sql.shuffle.partitions") == own
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(tuple(r) for r in df.collect()) == _sql(f"SELECT {cols} FROM ({queries.ORACLES[name]})")


def test_small_tables_keep_the_session(spark):
    assert session.roomy(spark, session.PART_ROWS) is spark


def test_segments_are_python_objects_one_at_a_time():
    """A batch of leader clustering is not held as Python objects at once."""
    batch = pa.array([[{"s": 1000 * i + k, "e": 1000 * i + k + 900, "own": True} for k in range(100)] for i in range(300)])
    to = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("to_s", pa.int64()), ("to_e", pa.int64())]))

    def peak(f):
        tracemalloc.start()
        out = f()
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, out

    whole, want = peak(lambda: [cluster._exits(r, 200) for r in batch.to_pylist()])
    each, got = peak(lambda: cluster._each(lambda r: cluster._exits(r, 200), to, batch))
    assert got.to_pylist() == want
    assert each < whole / 20
    assert cluster._each(len, to, batch[:0]).to_pylist() == []


def test_dense_positions_are_many_windows(spark):
    """A contig with a row at every position is many window partitions, for peaks and for depth."""
    rows = spark.range(1 << 18).select(F.col("id").alias("pos"))
    sizes = [r["count"] for r in peaks.stretches(rows, "pos", 50).groupBy("_stretch").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= (1 << 16) + 2 * 50
    assert coverage.STRETCH <= 1 << 16


def test_attributes_are_split_once(spark):
    """The text is split once a row, not again for each of its pieces; of repeated keys the last stays."""
    plan = str(S.gff3_attributes("info"))
    assert plan.count("split(") == 1
    rows = spark.createDataFrame([("a=1; b = 2;a=3;x",), ("",), (None,), ("k=v=w;k=",)], "info string")
    assert [r[0] for r in rows.select(S.gff3_attributes("info")).collect()] == [{"b": "2", "a": "3"}, {}, None, {"k": ""}]


def test_stems_take_no_ranges(spark):
    """The class of a stem's characters has no ranges, which took most of the time of ``attr_parse``; what it keeps is ASCII."""
    assert "A-Z" not in str(S.file_stem("path"))
    rows = spark.createDataFrame([("/a/b \u00e9\u0661 c-d.e_1.gff3.GZ",), ("x.",), ("[^&]\\w.-_.txt",)], "path string")
    assert [r[0] for r in rows.select(S.file_stem("path")).collect()] == ["b_c-d.e_1", "x.", "_w.-_"]
