"""Versions of tables: writers that stop at any step, two writers, readers; record numbers of split files, bounded previews."""

import random

import pytest
from pyspark.sql import functions as F

from daylark import catalog
from daylark.sources import ingest, versions
from daylark.streaming import daily


class Stopped(Exception):
    pass


def ids(rows):
    return sorted(r[0] for r in rows.collect())


def raising(*_, **__):
    raise Stopped


STEPS = ["numbers", "commit", "_publish", "after"]


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_that_stops_leaves_one_whole_version(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/t"
    versions.replace(spark.range(2), path)
    with monkeypatch.context() as patch:
        if step == "after":
            real = versions._publish
            patch.setattr(versions, "_publish", lambda *a: (real(*a), raising()))
        else:
            patch.setattr(versions, step, raising)
        with pytest.raises(Stopped):
            versions.replace(spark.range(5), path)
    assert ids(versions.read(spark, path)) == list(range(5 if step == "after" else 2))
    versions.replace(versions.read(spark, path).unionByName(spark.range(9, 10)), path)
    assert ids(versions.read(spark, path))[-1] == 9


@pytest.mark.parametrize("target", ["height_weight", "participants"])
def test_an_ingest_that_stops_may_be_repeated(spark, tmp_path, monkeypatch, target):
    """Rows 1 and 2 are in the table; an upsert of row 3 stops before or after its commit and is run again."""
    store, first, second = f"file://{tmp_path}/store", tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text("id,height_2022\n1,160\n2,170\n")
    second.write_text("id,height_2022\n3,180\n2,171\n")
    ingest.ingest(spark, "height_weight", str(first), store)
    real = versions._publish
    for late in (False, True):
        def stop(spark, path, *rest):
            if path.endswith(target):
                if late:
                    real(spark, path, *rest)
                raise Stopped
            real(spark, path, *rest)

        with monkeypatch.context() as patch:
            patch.setattr(versions, "_publish", stop)
            if not (late and target == "participants"):  # the second run finds its participants there
                with pytest.raises(Stopped):
                    ingest.ingest(spark, "height_weight", str(second), store)
        assert {1, 2} <= set(ids(versions.read(spark, f"{store}/height_weight").select("participant_id")))
        ingest.ingest(spark, "height_weight", str(second), store)
        got = {r.participant_id: r.height_2022 for r in versions.read(spark, f"{store}/height_weight").collect()}
        assert got == {1: 160.0, 2: 171.0, 3: 180.0}
        assert ids(versions.read(spark, f"{store}/participants")) == [1, 2, 3]


def test_of_two_writers_one_is_told(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    base = versions.replace(spark.range(2), path)
    versions.commit(spark.range(3), path, base)
    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(7), path, base)
    assert ids(versions.read(spark, path)) == [0, 1, 2] and versions.numbers(spark, path) == [0, 1]
    assert not [f for f in (tmp_path / "t" / "_log").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_readers_keep_their_version_and_old_ones_are_cleaned(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.read(spark, path) is None and versions.record(spark, path) is None
    for n in range(4):
        versions.replace(spark.range(n), path)
    reader = versions.read(spark, path, 2)
    versions.replace(spark.range(9), path)
    assert ids(reader) == [0, 1] and versions.read(spark, path, 0).count() == 0
    spark.range(5).write.parquet(f"{path}/data-of-a-stopped-writer")
    assert len(versions.clean(spark, path, keep=2)) == 3 and versions.numbers(spark, path) == [3, 4]
    assert ids(versions.read(spark, path, 3)) == [0, 1, 2] and (tmp_path / "t" / "data-of-a-stopped-writer").exists()
    assert versions.clean(spark, path, keep=2, hours=-1) == ["data-of-a-stopped-writer"]
    with pytest.raises(KeyError):
        versions.read(spark, path, 0)


def test_a_stream_batch_is_merged_once(spark, tmp_path, monkeypatch):
    source, target, checkpoint = str(tmp_path / "in"), f"file://{tmp_path}/table", str(tmp_path / "cp")
    schema = "k int, at int, v string"
    run = lambda: daily.upsert_stream(spark.readStream.schema(schema).parquet(source), target, ["k"], ["at"], checkpoint, buckets=4).awaitTermination(120)
    got = lambda: sorted((r.k, r.v) for r in versions.read(spark, target).collect())
    spark.createDataFrame([(k, 1, "a") for k in range(8)], schema).coalesce(1).write.parquet(source)
    run()
    before = versions.record(spark, target)["parts"]
    real = versions._publish
    for late in (False, True):
        spark.createDataFrame([(1, 2 + late, f"b{late}"), (1, 1, "old")], schema).coalesce(1).write.mode("append").parquet(source)
        with monkeypatch.context() as patch:
            patch.setattr(versions, "_publish", lambda *a: (real(*a) if late else None, raising()))
            with pytest.raises(Exception):
                run()
        assert len(got()) == 8 and dict(got())[1] == (f"b{late}" if late else "a")
        count = len(versions.numbers(spark, target))
        run()
        assert dict(got())[1] == f"b{late}" and len(versions.numbers(spark, target)) == count + (not late)
    after = versions.record(spark, target)["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and set(before) == set(after)


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rejects_tell_their_row_in_a_file_read_in_many_blocks(spark, tmp_path, small_blocks):
    rng, want = random.Random(4), []
    for name in ("a", "b"):
        lines, row = ["other,id,height_2022" if name == "b" else "id,height_2022,weight_2022"], 1
        for k in range(400):
            if rng.random() < 0.2:
                lines.append("")
            row += 1
            bad = rng.random() < 0.1
            number = "" if bad else str(k)
            lines.append(f'"x, {k}",{number},150' if name == "b" else f"{number},160" + ",50" * rng.randrange(2))
            if bad:
                want.append((f"{name}.csv", row))
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    table = catalog.lookup("height_weight")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = ingest.typed(ingest.read_csv(spark, str(tmp_path), table), table.fields)
    got = ingest.rejected(rows).select(F.element_at(F.split("__file", "/"), -1).alias("f"), "__row", "reason").collect()
    assert sorted((r.f, r[1]) for r in got) == want and {r.reason for r in got} == {"missing participant_id"}
    assert ingest.accepted(rows).count() == 800 - len(want)
    assert [(r.file[-5:], r.row) for r in ingest.first_errors(rows).collect()] == want[:20]


@pytest.mark.parametrize("text,error", [("", "empty"), ("\n\n", "empty"), ("id\n", "header"), ('"id,height_2022\n', "header"), ("id,height_2022\n", None), ("id\n1\n", None), ("﻿id,height_2022\n1,2\n", None)])
def test_errors_count_only_without_records(spark, tmp_path, text, error):
    (tmp_path / "x.csv").write_text(text)
    table = catalog.lookup("height_weight")
    if error:
        with pytest.raises(ValueError, match=error):
            ingest.read_csv(spark, str(tmp_path / "x.csv"), table)
    else:
        rows = ingest.read_csv(spark, str(tmp_path / "x.csv"), table).collect()
        assert [(r.id, r.row) for r in rows] == [("1", 2)] * (text.count("1"))


def test_preview_reads_no_more_than_its_bytes(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,height_2022,other\n1,2,\"a, b\"\n3\n" + "4,5,6\n" * 20_000)
    rows, headers, known = ingest.preview(spark, str(tmp_path / "x.csv"), catalog.lookup("height_weight"))
    assert [tuple(r) for r in rows.collect()][:2] == [("1", "2", "a, b"), ("3", None, None)] and rows.count() == 5
    assert (headers, known) == (["id", "height_2022", "other"], ["id", "height_2022"])
    assert len(ingest.head(spark, str(tmp_path / "x.csv"))) == ingest.PREVIEW_BYTES and ingest.head(spark, str(tmp_path / "x.csv"), 10) == b"id,height_"
    (tmp_path / "y.csv").write_text("id,height_2022\n" + "1" * 50_000)
    assert ingest.preview(spark, str(tmp_path / "y.csv"), catalog.lookup("height_weight"))[0].count() == 0


def test_overwrite_mends_what_a_stopped_one_left(spark, tmp_path):
    path = str(tmp_path / "table")
    ingest.overwrite(spark.range(3), path)
    (tmp_path / "table").rename(tmp_path / "table.before")
    ingest.overwrite(spark.range(7, 8), str(tmp_path / "other"))
    ingest.overwrite(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "table.before").exists()
