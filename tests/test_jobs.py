"""Whole jobs on small CSV files."""

from pyspark.sql import functions as F

from tracewright.plans import jobs
from tracewright.sources import csv as src

STEP = 40 / 111_194.9


def raw_file(folder, user, shift):
    lines, second = ["LATITUDE,LONGITUDE,UTC_DATE,UTC_TIME"], 0
    def add(lat, lon):
        lines.append(f"{lat:.6f},{lon:.6f},2022-10-17,{6 + second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}")
    for k in range(60):  # a ride north, a stay, a ride on
        second = 20 * k
        add(48.8 + (k + shift) * STEP, 2.3)
    for k in range(15):
        second = 1200 + 60 * k
        add(48.8 + (59 + shift) * STEP, 2.3)
    for k in range(40):
        second = 2200 + 20 * k
        add(48.8 + (62 + k + shift) * STEP, 2.3)
    (folder / f"{user}.csv").write_text("\n".join(lines) + "\n")


def test_refine_cluster_and_corridors(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for k in range(4):
        raw_file(raw, f"10_{k}", k)
    out = jobs.refine_files(spark, str(raw), step=1)
    src.write_table(out["refined"], str(tmp_path / "refined"), "csv")
    refined = src.read_refined(spark, str(tmp_path / "refined" / "*.csv"))
    trips = refined.groupBy("TRAJECTORY_UID").count().collect()
    assert len(trips) == 8 and all(r["count"] >= 10 for r in trips)
    assert [r["GLOBAL_TRAJECTORY_ID"] for r in out["refined"].select("GLOBAL_TRAJECTORY_ID").distinct().orderBy("GLOBAL_TRAJECTORY_ID").collect()] == list(range(1, 9))
    stats = out["file_stats"].collect()
    assert all((r["valid_points"], r["staypoints"], r["trajectories_kept"]) == (115, 1, 2) for r in stats)
    clusters = jobs.cluster_points(refined, **(jobs.FOCUSED | {"min_shared": 2, "cell_m": 200}))["clusters"]
    assert clusters.select("CLUSTER_ID").distinct().count() == 2
    found = jobs.common_corridors(spark, str(tmp_path / "refined"))["corridors"].select("length_km", F.size(F.split("latitudes", ";")).alias("n")).collect()
    assert found and max(r["n"] for r in found) >= 8


def test_bad_files_are_named_and_corridors_read_back(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for k in range(3):
        raw_file(raw, f"10_{k}", k)
    (raw / "11_9.csv").write_text("A,B\n1,2\n")
    out = jobs.refine_files(spark, str(raw), step=1)
    stats = {r["source_file"]: r for r in out["file_stats"].collect()}
    assert set(stats) == {"10_0.csv", "10_1.csv", "10_2.csv", "11_9.csv"}
    assert stats["11_9.csv"]["error"] == "missing columns: LATITUDE, LONGITUDE" and stats["11_9.csv"]["valid_points"] == 0
    assert stats["10_0.csv"]["error"] == "" and stats["10_0.csv"]["merged_staypoints"] == 1 and stats["10_0.csv"]["presampling_removed_points"] == 0
    src.write_table(out["refined"], str(tmp_path / "refined"), "csv")
    src.write_table(jobs.common_corridors(spark, str(tmp_path / "refined"))["corridors"].drop("shown"), str(tmp_path / "corridors"), "csv")
    report = jobs.corridor_report(spark, str(tmp_path / "corridors"))["corridor_report"].collect()
    assert report and {r["intensity"] for r in report} <= {"red", "orange", "blue"} and max(r["length_km"] for r in report) > 1
