from complaints import COLUMNS, history

from casemesh import jobs
from casemesh.sources.history import inline_history, write_history


def test_jobs_from_csv_to_decisions(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("h.csv", "models", "index", "in", "out", "hits", "live")}
    write_history(inline_history(spark, dict(zip(COLUMNS, map(list, zip(*history()))))), paths["h.csv"])
    where = ["--models", paths["models"], "--index", paths["index"]]
    report = jobs.main(
        ["train", "--history", paths["h.csv"], *where, "--trees", "5", "--depth", "4", "--holdout"]
    )
    assert report["indexed"] == 90 and report["officer_f1"] > 0.8

    requests = spark.createDataFrame(
        [("a", "The pothole near Mill Road is crumbling, say residents.", None), ("b", "!!", None)],
        "complaint_id string, text_input string, media_path string",
    )
    requests.write.parquet(paths["in"])
    asked = ["--requests", paths["in"], *where]
    assert jobs.main(["triage", *asked, "--out", paths["out"]]) == {"rows": 2, "out_of_scope": 0}
    jobs.main(["search", *asked, "--out", paths["hits"], "--k", "3"])
    hits = spark.read.parquet(paths["hits"]).where("complaint_id = 'a'").orderBy("rank").collect()
    assert len(hits) == 3 and hits[0].document.startswith("The pothole near Mill Road")
    jobs.main(["stream", *asked, "--out", paths["live"], "--state", str(tmp_path / "s"), "--once"])
    live = {r.complaint_id: r.status for r in spark.read.parquet(paths["live"]).collect()}
    assert live == {"a": "model", "b": "rejected"}

    media = tmp_path / "media"
    media.mkdir()
    for name in ("call1.wav", "call2.wav", "water_leak.mp4"):
        (media / name).write_bytes(b"x")
    spoken = spark.createDataFrame(
        [(f"file:{media}/call1.wav", "There is smoke in the hall"), (f"file:{media}/call2.wav", "!!")],
        "media_path string, transcript string",
    )
    spoken.write.parquet(str(tmp_path / "spoken"))
    (tmp_path / "rules.json").write_text(
        '{"rule": "smoke", "priority": 1, "keywords": ["smoke"], "officer": "Brigade"}\n'
        '{"rule": "holes", "priority": 2, "keywords": ["pothole near"]}\n'
    )
    options = ["--media", str(media), "--transcripts", str(tmp_path / "spoken"), "--recall", "0.9"]
    options += ["--rule-table", str(tmp_path / "rules.json"), "--out", str(tmp_path / "all")]
    assert jobs.main(["triage", *asked, *options])["rows"] == 5
    rows = {r.complaint_id.split("/")[-1]: r for r in spark.read.parquet(str(tmp_path / "all")).collect()}
    assert {k: r.status for k, r in rows.items() if k != "water_leak.mp4"} == {
        "a": "out_of_scope", "b": "rejected", "call1.wav": "smoke", "call2.wav": "rejected",
    }
    assert rows["call1.wav"].officer == "Brigade" and rows["water_leak.mp4"].complaint_text
