import csv

import pytest
from complaints import COLUMNS, history
from pyspark.sql import functions as F

from casemesh.operators.clean import clean_history, with_content_id, with_position_id
from casemesh.sources.history import inline_history, read_history, read_raw_history, write_history
from casemesh.sources.index import index_history, load_index
from casemesh.sources.media import read_media
from casemesh.sources.tables import read_table


def inline(spark):
    return inline_history(spark, dict(zip(COLUMNS, map(list, zip(*history())))))


def test_inline_table_and_its_cleaning(spark):
    df = inline(spark)
    assert df.dtypes[-1] == ("eta", "double") and df.count() == 90
    holed = df.withColumn("complaint_text", F.when(F.col("priority") != "Low", F.col("complaint_text")))
    cleaned = clean_history(holed)
    assert cleaned.count() == 60 and cleaned.columns[-1] == "eta_days"
    assert clean_history(cleaned).columns == cleaned.columns
    with pytest.raises(ValueError):
        inline_history(spark, {"complaint_text": ["a"], "eta": []})


def test_csv_round_trip(spark, tmp_path):
    rows = history()[:5] + [
        ('Commas, "quotes" and\na line break', "A, B", "High", 0.2),
        ("  kept blanks  ", "B", "Low", None),
        (None, "C", "Low", 2.5),
    ]
    df = spark.createDataFrame(
        rows, "complaint_text string, assigned_officer string, priority string, eta double"
    )
    path = str(tmp_path / "out")
    write_history(df, path)
    assert {tuple(r) for r in read_raw_history(spark, path, multi_line=True).collect()} == set(rows)
    again = read_history(spark, path, multi_line=True)
    assert again.count() == len(rows) - 1 and again.dtypes[-1] == ("eta_days", "double")


def test_csv_header_names_decide_not_positions(spark, tmp_path):
    path = tmp_path / "h.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["eta_days", "priority", "complaint_text", "assigned_officer"])
        out.writerow([1.5, "High", "text, with comma", "Head"])
    got = read_history(spark, str(path)).first()
    assert (got.complaint_text, got.eta_days, got.priority) == ("text, with comma", 1.5, "High")


@pytest.mark.parametrize("rows_per_range", [7, 1000])
def test_position_ids_are_consecutive_in_key_order(spark, rows_per_range):
    df = spark.range(100).select((F.col("id") * 37 % 1000).alias("key")).repartition(6)
    got = with_position_id(df, "key", rows_per_range=rows_per_range).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.key)] == [f"id_{i}" for i in range(100)]


def test_content_ids_are_stable(spark):
    df = clean_history(inline(spark))
    one = {r.id for r in with_content_id(df, ["complaint_text", "priority"]).collect()}
    two = {r.id for r in with_content_id(df.repartition(9), ["complaint_text", "priority"]).collect()}
    assert one == two and len(one) == 90


def entries(spark, numbers, note):
    rows = [(f"id_{i}", f"{note} {i}", [float(i)], ("Head", "Low", 1.0)) for i in numbers]
    return spark.createDataFrame(
        rows, "id string, document string, embedding array<float>, "
        "metadata struct<assigned_officer:string,priority:string,eta_days:double>",
    )


def test_index_only_gains_entries(spark, tmp_path):
    path = str(tmp_path / "index")
    assert load_index(spark, path).count() == 0
    assert index_history(entries(spark, range(10), "old"), path) == 10
    assert index_history(entries(spark, range(10), "new"), path) == 0
    assert index_history(entries(spark, range(5, 15), "new"), path) == 5
    got = {r.id: r.document for r in load_index(spark, path).collect()}
    assert len(got) == 15 and got["id_7"] == "old 7" and got["id_12"] == "new 12"


def test_media_paths_without_content(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.wav", "deep/b.wav", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    media = read_media(spark, str(tmp_path), "*.wav")
    assert sorted(r[0].rsplit("/", 1)[1] for r in media.collect()) == ["a.wav", "b.wav"]
    plan = media._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_only_small_tables_are_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    assert read_table(spark, path).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = str(tmp_path / "w")
    spark.range(100).repartition(40).write.option("maxRecordsPerFile", 1).parquet(wide)
    assert "Repartition" not in read_table(spark, wide)._jdf.queryExecution().logical().toString()


def test_position_ids_keep_rows_without_key(spark):
    from casemesh.operators.clean import with_position_id

    rows = [(k,) for k in (5, 1, 9, 3)] + [(None,)] * 6
    df = spark.createDataFrame(rows, "key int")
    for size in (1, 2, 1_000_000):
        got = with_position_id(df, "key", rows_per_range=size).collect()
        assert sorted(int(r["id"][3:]) for r in got) == list(range(10))
        place = {r["key"]: int(r["id"][3:]) for r in got if r["key"] is not None}
        assert place == {1: 6, 3: 7, 5: 8, 9: 9}
