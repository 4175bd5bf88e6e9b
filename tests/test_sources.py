import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galewise import session
from galewise.operators import catalog, forecast, metrics, towers
from galewise.sources import files
from galewise.sources import tables as t


def test_discovery_is_recursive_and_reads_names_only(spark, tmp_path):
    names = ["ecfine.I2022093000.048.F2022100200.nc", "ecfine.I2022093012.000.F2022093012.nc", "notes.txt"]
    for i, name in enumerate(names):
        folder = tmp_path / "a" / f"month={i}" / "deep"
        folder.mkdir(parents=True)
        (folder / name).write_bytes(b"x")
    found = files.discover_forecasts(spark, [str(tmp_path / "a")])
    assert {(r.init, r.gap, r.F_time) for r in found.collect()} == {
        ("I2022093000", "048", "F2022100200"), ("I2022093012", "000", "F2022093012")
    }
    assert [r.gap for r in forecast.lead_filter(found).collect()] == ["048"]


def test_station_files_with_other_columns_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Extra,StationNum,ObservTimes,WindDirect10,WindVelocity10,ExMaxWindV\nx,K2931,21093021,10,20,30\n")
    (tmp_path / "b.csv").write_text("Extra,StationNum,ObservTimes,WindDirect10,WindVelocity10,ExMaxWindV\ny,K2942,21093022,,20,31\n")
    schema = T.StructType([T.StructField("Extra", T.StringType()), *files.STATION_SCHEMA.fields])
    rows = files.read_stations(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schema)
    assert rows.columns == files.STATION_COLUMNS
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("K2931", "21093021", 10, 20, 30), ("K2942", "21093022", None, 20, 31)
    ]


def test_nan_is_missing(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nNaN,u\n,v\n1.5,\n")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    df = files.read_csv(spark, str(tmp_path / "x.csv"), schema)
    assert {r.column_name: r.non_null for r in metrics.column_counts(df).collect()} == {"a": 1, "b": 2}


def test_nan_forecasts_are_left_out_of_the_rmse(spark):
    rows = [(3, 1, 1.0, 2.0, 5.0), (3, 1, 9.0, 2.0, float("nan")), (3, 1, 9.0, 2.0, None), (3, 1, 9.0, 2.0, -1.0)]
    df = spark.createDataFrame(rows, "gap int, exp int, K2962_prediction double, K2962_observing double, K2962_ecf double")
    row = metrics.calibration_rmse(df).first()
    assert (row.K2962_rmse_calibration, row.K2962_rmse_ecf) == (1.0, 3.0)


def test_ranking_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("2 qid:5 1:0.5 2:-1 #docid = 7\n0 qid:6 1:3 #docid = 8\n")
    rows = files.read_ranking_text(spark, str(tmp_path / "t.txt"), ["1", "2"])
    assert sorted(tuple(r) for r in rows.collect()) == [(0, "g_6", 3.0, None), (2, "g_5", 0.5, -1.0)]


def test_report_and_snapshot(spark, tmp_path):
    detail = t.calibration(spark, SF)
    summary = metrics.calibration_rmse(detail)
    files.write_report(detail, summary, str(tmp_path / "report"))
    assert files.read_csv(spark, str(tmp_path / "report/details"), detail.schema).count() == detail.count()
    assert files.read_csv(spark, str(tmp_path / "report/summary"), summary.schema).count() == summary.count()
    labels = forecast.station_labels(t.station_obs(spark, SF))
    stored = files.snapshot(labels, str(tmp_path / "labels"))
    assert stored.schema.simpleString() == labels.schema.simpleString()
    assert sorted(stored.collect()) == sorted(labels.collect())


def test_null_hours_do_not_form_a_group(spark):
    obs = spark.createDataFrame([("K2931", None, 1, 1, 10), ("K2931", "21093021", 1, 1, 10)], files.STATION_SCHEMA)
    assert forecast.station_labels(obs).count() == 1


@pytest.fixture
def flagged(spark):
    yield catalog.publishable(t.video_embedding(spark, SF), t.course_platform(spark, SF), t.course(spark, SF))
    spark.sql("DROP VIEW IF EXISTS towers")
    for prefix in ("tq_", "ts_"):
        for row in spark.sql(f"SHOW TABLES LIKE '{prefix}*'").collect():
            spark.sql(f"DROP TABLE `{row.tableName}`")


def names(spark, prefix):
    return sorted(r.tableName for r in spark.sql(f"SHOW TABLES LIKE '{prefix}*'").collect())


def test_publish_switches_both_towers_and_retires_old_versions(spark, flagged):
    for day in range(1, 7):
        done = catalog.publish_pair(flagged, "tq_", "ts_", "towers", f"2024010{day}000000")
        assert done.rows == {"query": flagged.count(), "search": flagged.count()}
        assert catalog.current_version(spark, "towers") == done
        for tower in catalog.TOWERS:
            assert sorted(catalog.read_tower(spark, "towers", tower).collect()) == sorted(done.read(spark, tower).collect())
    assert catalog.apply_retention(spark, "tq_") == ["tq_20240102000000", "tq_20240103000000"]
    assert names(spark, "tq_") == [f"tq_2024010{d}000000" for d in (1, 4, 5, 6)]
    with pytest.raises(ValueError):
        catalog.publish_pair(flagged, "tq_", "ts_", "towers", "20240106000000")
    plan = catalog.read_tower(spark, "towers", "query")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "tq_20240106000000" in plan


@pytest.mark.parametrize("step", [0, 1, 2])
def test_a_job_broken_off_leaves_the_old_version(spark, flagged, monkeypatch, step):
    old = catalog.publish_pair(flagged, "tq_", "ts_", "towers", "1")
    calls, sums = [], catalog._content

    def broken(df):
        calls.append(1)
        if len(calls) == 2 * step + 2 or step == 2 and len(calls) == 4:
            raise OSError("lost")
        return sums(df)

    monkeypatch.setattr(catalog, "_content", broken)
    fewer = flagged.where("video_id % 2 = 0")
    with pytest.raises(OSError):
        catalog.publish_pair(fewer, "tq_", "ts_", "towers", "2")
    monkeypatch.setattr(catalog, "_content", sums)
    assert catalog.current_version(spark, "towers") == old
    for tower in catalog.TOWERS:
        assert catalog.read_tower(spark, "towers", tower).count() == flagged.count()
    left = catalog.drop_unpublished(spark, "tq_", "ts_", "towers") if step == 1 else None
    assert left in (None, ["tq_2", "ts_2"])
    done = catalog.publish_pair(fewer, "tq_", "ts_", "towers", "2")
    assert done.rows == {"query": fewer.count(), "search": fewer.count()} and catalog.current_version(spark, "towers") == done


def test_a_table_that_lost_rows_is_not_published(spark, flagged, monkeypatch):
    sums = catalog._content
    monkeypatch.setattr(catalog, "_content", lambda df: (sums(df)[0], len(df.columns) and id(df)))
    with pytest.raises(RuntimeError):
        catalog.publish_pair(flagged, "tq_", "ts_", "towers", "1")
    assert catalog.current_version(spark, "towers") is None


@pytest.mark.parametrize("n,victims", [(0, 0), (1, 0), (4, 0), (5, 1), (9, 5)])
def test_retention_counts(spark, n, victims):
    names = spark.createDataFrame([(f"p_{i:02d}",) for i in range(n)] + [("other_1",)], "name string")
    assert catalog.retention_victims(names, "p_").count() == victims


def test_replace_table(spark):
    for n in (3, 5):
        catalog.replace_table(spark.range(n), "replaced")
    assert spark.table("replaced").count() == 5


def test_towers_join_needs_both_sides(spark):
    vec = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "idx long, v array<double>")
    ids = spark.createDataFrame([(10, 0), (11, 1)], "video_id long, idx long")
    out = towers.tower_join(
        vec.withColumnRenamed("v", "embedding_search"), ids,
        vec.withColumnRenamed("v", "embedding_query"), ids.where("video_id = 11"),
    )
    assert [tuple(r) for r in out.collect()] == [(11, [2.0], [2.0])]


def test_lineage_is_cut_in_the_shared_folder(spark):
    shared = session.shared_dir(spark)
    assert shared == spark.conf.get("spark.checkpoint.dir")
    df = session.cut_lineage(spark.range(10).withColumn("x", F.array(F.col("id"))), "part")
    assert df.count() == 10 and df.inputFiles() and all(shared in f for f in df.inputFiles())
