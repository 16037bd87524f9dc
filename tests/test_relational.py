"""Every relational query against its oracle, and literal fixtures for the tie and null rules."""

import datetime
import math
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from daylark import catalog
from daylark.functions import missing, scalar
from daylark.operators import daily, matching, panel, personal, profile
from daylark.plans import catalogue
from daylark.sources import ingest, versions


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_oracle(name, same_as_oracle):
    same_as_oracle(catalogue.queries()[name], catalogue.oracle_sql()[name])


def values(spark, column, items):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string")
    return [r[0] for r in rows.select("k", column(F.col("x")).alias("v")).orderBy("k").select("v").collect()]


def test_missing_predicates_differ(spark):
    items = [None, "", " nan ", "NULL", "-", "N/A", "5d", "Infinity", "1e3", "-7.9", "0x10"]
    assert values(spark, lambda x: missing.ingest_value(x, "number"), items) == [None] * 8 + [1000.0, -7.9, None]
    assert values(spark, lambda x: missing.ingest_value(x, "int"), items)[-3:] == [1000, -7, None]
    assert values(spark, missing.preprocess_missing, items)[:6] == [True, True, True, False, True, True]
    assert values(spark, lambda x: missing.ingest_value(x, "bool"), ["TRUE", "no", "?", "1"]) == [True, False, None, True]
    assert values(spark, missing.preprocess_ordinal, ["2", " Low ", "NA"]) == ["2.0", "Low", None]


def test_half_up_is_symmetric(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (-0.1,)], "x double")
    assert [r[0] for r in rows.select(scalar.half_up(F.col("x"), 0)).collect()] == [3.0, -3.0, 0.0, 0.0]


def test_catalog_refuses_unknown_and_schema_only():
    assert catalog.lookup("sleep").key_style == "session"
    with pytest.raises(KeyError):
        catalog.lookup("nothing")
    with pytest.raises(ValueError):
        catalog.lookup("glucose")


def test_ingest_upserts_and_audits(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text("id,height_2022,weight_2022,other\n1,160,60,x\n2,170,nan,y\n,150,50,z\n")
    second.write_text("id,height_2022,weight_2022\n2,171,70\n3,180,80\n")
    entry = ingest.ingest(spark, "height_weight", str(first), store).first()
    assert (entry.rows_inserted, entry.rows_rejected, entry.participants) == (2, 1, 2)
    ingest.ingest(spark, "height_weight", str(second), store)
    got = {r.participant_id: (r.height_2022, r.weight_2022) for r in versions.read(spark, f"{store}/height_weight").collect()}
    assert got == {1: (160.0, 60.0), 2: (171.0, 70.0), 3: (180.0, 80.0)}
    assert sorted(r[0] for r in versions.read(spark, f"{store}/participants").collect()) == [1, 2, 3]
    _, headers, known = ingest.preview(spark, str(first), catalog.lookup("height_weight"))
    assert len(headers) == 4 and len(known) == 3


def test_dominant_phase_takes_first_on_ties(spark):
    rows = spark.createDataFrame([(1, "Luteal"), (1, "Menstrual"), (2, "Luteal"), (2, "Luteal"), (2, "Menstrual")], "participant_id int, phase string")
    found = profile.dominant_phase(profile.phase_counts(rows))
    assert {r.participant_id: r.dominant for r in found.collect()} == {1: "Menstrual", 2: "Luteal"}


def test_rolling_carries_over_gaps_and_never_looks_ahead(spark):
    rows = [(1, d, None if d in (1, 4) else float(d)) for d in range(1, 11)]
    frame = lambda r: spark.createDataFrame(r, "participant_id int, day_in_study int, v double")
    out = {r.day_in_study: r for r in panel.rolling_last_observed(frame(rows), "v", 3).collect()}
    assert out[1]["mean"] is None and out[2]["mean"] == 2.0 and out[2]["std"] == 0.0
    assert out[4]["mean"] == out[3]["mean"] == 2.5 and out[10]["mean"] == 9.0
    changed = [(p, d, 99.0 if d > 6 else v) for p, d, v in rows]
    again = {r.day_in_study: r["mean"] for r in panel.rolling_last_observed(frame(changed), "v", 3).collect()}
    assert all(again[d] == out[d]["mean"] for d in range(1, 7))


def test_pearson_guards(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 4.0), (3, None, 9.0)], "p int, a double, b double")
    got = {r.p: r.r for r in rows.groupBy("p").agg(personal.pearson(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0}


def test_nearest_takes_later_on_ties(spark):
    at = lambda d: datetime.datetime(2024, 3, d)
    left = spark.createDataFrame([(1, "a", at(10)), (2, "b", at(10))], "left_id int, owner string, t timestamp")
    right = spark.createDataFrame([(7, "a", at(8)), (8, "a", at(12)), (9, "b", datetime.datetime(2023, 1, 1))], "right_id int, owner string, s timestamp")
    assert [(r.left_id, r.right_id) for r in matching.nearest_within(left, right, "owner", "t", "s").collect()] == [(1, 8)]


def test_interval_aware_panel_keeps_intervals_apart(spark):
    spine = spark.createDataFrame([(1, 1, 5, "Luteal"), (1, 2, 5, "Luteal")], "participant_id int, study_interval int, day_in_study int, phase string")
    glucose = spark.createDataFrame([(1, 1, 5, 4.0), (1, 2, 5, 6.0)], "participant_id int, study_interval int, day_in_study int, glucose_value double")
    tables = {"hormones_selfreport": spine, "glucose": glucose}
    pooled = daily.build_daily_features(tables).collect()
    apart = daily.build_daily_features(tables, interval_aware=True).collect()
    assert [r.glucose_mean for r in pooled] == [5.0, 5.0]
    assert sorted(r.glucose_mean for r in apart) == [4.0, 6.0]


def test_stage_minutes_of_broken_json_count_zero(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1.0, 1.0, 1.0, 1.0, "a", "b", '{"summary": {"deep": {"minutes": 9}}}'), (1, 1, 1.0, 1.0, 1.0, 1.0, "a", "c", "oops")],
        "participant_id int, day_in_study int, minutes_asleep double, minutes_awake double, time_in_bed double, efficiency double,"
        " sleep_start_timestamp string, sleep_end_timestamp string, levels string",
    )
    assert daily.sleep_daily(rows).first().sleep_deep_min == 9.0


def test_upsert_by_date_keeps_first_identity(spark):
    schema = "id string, date date, created_at int, note string"
    day = datetime.date(2024, 1, 1)
    old = spark.createDataFrame([("x", day, 1, "old")], schema)
    new = spark.createDataFrame([("y", day, 2, "new")], schema)
    assert [(r.id, r.created_at, r.note) for r in ingest.upsert_by_date(old, new).collect()] == [("x", 1, "new")]


def test_export_bundle_counts_only_shared(spark):
    rows = spark.createDataFrame([("a", datetime.date(2024, 1, 9), "n", True), ("b", datetime.date(2024, 1, 9), "n", False)], "who string, date date, notes string, opt boolean")
    shared = personal.export_packet(rows, F.col("who"), F.col("opt"), strict=True)
    bundle = personal.export_bundle(shared, ["date", "notes"]).collect()
    assert [(r.alias, '"count":1' in r.bundle, "2024-01-01" in r.bundle) for r in bundle] == [("a", True, True)]


def test_overwrite_survives_a_crash_in_between(spark, tmp_path):
    path = str(tmp_path / "table")
    ingest.overwrite(spark.range(3), path)
    ingest.overwrite(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    (tmp_path / "table").rename(tmp_path / "table.before")  # as a crash after the first rename leaves it
    ingest.restore(spark, path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "table.before").exists()


def test_keyed_put_delete_history_and_sync(spark, tmp_path):
    path = str(tmp_path / "put")
    put = lambda rows: ingest.put_by_key(spark.createDataFrame(rows, "kind string, v int"), path, "kind")
    put([("a", 1), ("b", 2)])
    put([("b", 3)])
    assert sorted(map(tuple, spark.read.parquet(path).select("kind", "v").collect())) == [("a", 1), ("b", 3)]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "id int, owner string")
    left = ingest.delete_owned(rows, spark.createDataFrame([(1, "x"), (2, "y")], "id int, owner string"))
    assert sorted(map(tuple, left.collect())) == [(1, "y"), (2, "x")]
    old = spark.createDataFrame([(k, k, None) for k in range(5)], "id int, predicted_at int, synced_id int")
    new = spark.createDataFrame([(9, 9, None)], old.schema)
    kept = ingest.bounded_history(old, new, 3)
    assert [r.id for r in kept.collect()] == [9, 4, 3]
    synced = ingest.mark_synced(kept, spark.createDataFrame([(4, 44)], "id int, synced_id int"))
    assert {r.id: r.synced_id for r in synced.collect()} == {9: None, 4: 44, 3: None}


def test_documents_binaries_and_extraction(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"id": 1, "tag": null}\n{"id": 2, "tag": "x"}\n')
    docs = ingest.read_documents(spark, str(tmp_path / "docs"), "id int, tag string", {"tag": F.lit("none")})
    assert sorted(map(tuple, docs.collect())) == [(1, "none"), (2, "x")]
    (tmp_path / "big.pdf").write_bytes(b"x" * 50)
    (tmp_path / "small.pdf").write_bytes(b"y" * 5)
    found = ingest.read_binaries(spark, str(tmp_path), "*.pdf", most_bytes=10).collect()
    assert [(r.length, bytes(r.content)) for r in found] == [(5, b"yyyyy")]
    texts = spark.createDataFrame([('{"lh": 4.5}',), ("no json",), (None,), ('{"lh": "x"}',), ("[1]",)], "raw string")
    assert [r.extracted and r.extracted.lh for r in ingest.extracted(texts, "raw", "lh double").collect()] == [4.5, None, None, None, None]


def test_stored_panel_is_refreshed(spark, tmp_path):
    spine = spark.createDataFrame([(1, 1), (1, 2)], "participant_id int, day_in_study int")
    glucose = spark.createDataFrame([(1, 1, 5.0), (1, 1, 7.0)], "participant_id int, day_in_study int, glucose_value double")
    path = str(tmp_path / "daily")
    first = daily.refresh_daily_features({"hormones_selfreport": spine, "glucose": glucose}, path)
    assert {r.day_in_study: r.glucose_mean for r in first.collect()} == {1: 6.0, 2: None}
    again = daily.refresh_daily_features({"hormones_selfreport": spine.where("day_in_study = 2"), "glucose": glucose}, path)
    assert again.count() == 1


def test_values_at_ranks(spark):
    import random

    rng = random.Random(1)
    rows = [(g, float(rng.choice([1, 2, 2, 2, 3, rng.random() * 9]))) for g in "ab" for _ in range(500)] + [("a", None)]
    wanted = [(g, k) for g in "ab" for k in (0, 1, 77, 250, 499)]
    got = profile.values_at(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", spark.createDataFrame(wanted, "g string, rank long")).collect()
    ordered = {g: sorted(v for h, v in rows if h == g and v is not None) for g in "ab"}
    assert {(r.g, r["rank"]): r.v for r in got} == {(g, k): ordered[g][k] for g, k in wanted}


def test_top_k_in_blocks(spark, monkeypatch):
    points = spark.range(60).selectExpr("id", "array(double(id), double(id % 7)) AS vector")
    whole = sorted(map(tuple, matching.top_k(points, points.where("id % 5 = 0"), 3).collect()))
    monkeypatch.setattr(matching, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, matching.top_k(points, points.where("id % 5 = 0"), 3).collect())) == whole and len(whole) == 36


def test_top_k_compares_in_arrays_with_the_distances_of_sums(spark, monkeypatch):
    """No pair is a row, ties go to the smaller id, a point without a vector comes last, and near copies keep their order."""
    rng = random.Random(3)
    made = [(k, [float(rng.randrange(3)) + 1e4 + rng.randrange(3) * 1e-7 for _ in range(4)] if k != 33 else None) for k in range(120)]
    points = spark.createDataFrame(made, "id long, vector array<double>").repartition(3)
    monkeypatch.setattr(matching, "POINTS_AT_ONCE", 7)
    monkeypatch.setattr(matching, "QUERIES_AT_ONCE", 5)
    for k in (1, 5, 119):
        found = matching.top_k(points, points.where("id % 10 = 0"), k)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        want = []
        for q, v in made[::10]:
            far = sorted((math.inf if w is None else math.sqrt(reduce(lambda x, ab: x + (ab[0] - ab[1]) * (ab[0] - ab[1]), zip(w, v), 0.0)), p) for p, w in made if p != q)
            want += [(q, p, None if d == math.inf else d, n + 1) for n, (d, p) in enumerate(far[:k])]
        assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[3])) == want
