"""Sources and sinks against files written by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, loaders
from tessera.sources.shared import shared_dir, written


def test_json_lines_keep_or_refuse_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": oops\n{"a": 3}\n')
    rows = {(r.a, r.b, r._corrupt) for r in files.json_lines(spark, str(tmp_path / "log.jsonl"), "a long, b string").collect()}
    assert rows == {(1, "x", None), (None, None, '{"a": oops'), (3, None, None)}
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "log.jsonl"), "a long, b string", strict=True).collect()


def test_artifacts_carry_the_keys_of_their_paths(spark, tmp_path):
    for seed, value in ((42, 0.5), (43, 0.75)):
        folder = tmp_path / "classification" / "credit" / f"seed_{seed}"
        folder.mkdir(parents=True)
        (folder / "full.json").write_text(json.dumps({"metrics": {"auc": value}, "rows": [1, 2]}, indent=1))
        (folder / "notes.txt").write_text("not an artifact")
    df = files.artifacts(spark, str(tmp_path), "metrics struct<auc:double>, rows array<long>")
    got = {(r.task, r.dataset, r.seed, r.condition, r.metrics.auc, tuple(r["rows"])) for r in df.collect()}
    assert got == {("classification", "credit", 42, "full", 0.5, (1, 2)), ("classification", "credit", 43, "full", 0.75, (1, 2))}


def test_first_path_description_and_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n")
    (tmp_path / "b.csv").write_text("y,z\nb,2\n")
    assert files.first_that_exists(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv")]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.first_path(spark, [str(tmp_path / "none.csv")])
    both = files.parts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {(r.x, r.y, r.z, r.source_file[-5:]) for r in both.collect()} == {("1", "a", None, "a.csv"), (None, "b", "2", "b.csv")}
    (tmp_path / "credit-description.txt").write_text("Two\nlines")
    (tmp_path / "wine").mkdir()
    (tmp_path / "wine" / "data_description.txt").write_text("Wine")
    found = {(r.name, r.text) for p in ("credit-description.txt", "wine/data_description.txt") for r in files.description(spark, str(tmp_path / p)).collect()}
    assert found == {("credit", "Two\nlines"), ("wine", "Wine")}
    assert files.csv_or_empty(spark, str(tmp_path / "none.csv"), "a long").count() == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    files.append_json(df, str(tmp_path / "json"))
    files.append_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    files.write_csv(df, str(tmp_path / "csv"), ["v"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["v"]
    files.append_rows(df, str(tmp_path / "rows"))
    files.append_rows(df.withColumn("w", F.lit(1)), str(tmp_path / "rows"))
    assert set(spark.read.option("mergeSchema", True).parquet(str(tmp_path / "rows")).columns) == {"k", "v", "w"}
    manifest = files.write_bundle({"one": df, "two": df.limit(1)}, str(tmp_path / "bundle"))
    assert {(r.name, r.rows) for r in manifest.collect()} == {("one", 2), ("two", 1)}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "f.bin").write_bytes(b"abc" * 1000)
    row = files.checksums(spark, str(tmp_path / "raw")).first()
    assert (row.length, row.sha256) == (3000, hashlib.sha256(b"abc" * 1000).hexdigest())
    back = loaders.write_predictions(spark.createDataFrame([(7, 1, 0.5), (8, 0, 0.2)], "row_id long, y int, p double"), str(tmp_path / "p"), "row_id")
    assert {tuple(r) for r in back.collect()} == {(7, 1, 0.5, 1), (8, 0, 0.2, 0)}


def test_loaders_refuse_and_handle_odd_targets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,num,cat,y\n" + "\n".join(f"{i},{'' if i % 3 == 0 else i},{'' if i % 4 == 0 else 'c' + str(i % 2)},{('yes', 'no', '')[i % 3]}" for i in range(60)) + "\n")
    got = loaders.binary_task(spark, str(tmp_path / "t.csv"), "id")
    assert got.count() == 40 and {r.y for r in got.collect()} == {0, 1} and got.where("num is null or cat is null").count() == 0
    assert dict(got.dtypes)["num"] == "float" and got.where("split = 'test'").count() == 8
    (tmp_path / "m.csv").write_text("id,num,y\n" + "\n".join(f"{i},{i},{i % 3}" for i in range(30)) + "\n")
    with pytest.raises(ValueError):
        loaders.binary_task(spark, str(tmp_path / "m.csv"), "id")
    multi = loaders.multiclass_task(spark, str(tmp_path / "m.csv"), "id", test_size=0.3)
    assert {(r.y, r["count"]) for r in multi.where("split = 'test'").groupBy("y").count().collect()} == {(0, 3), (1, 3), (2, 3)}
    (tmp_path / "r.csv").write_text("id,num,y\n1,2,3.5\n2,x,oops\n3,,4\n")
    assert {(r.id, r.y) for r in loaders.regression_task(spark, str(tmp_path / "r.csv"), "id").collect()} == {("1", 3.5), ("3", 4.0)}


def test_shared_tables(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = written(spark.range(10), "ten")
    assert df.count() == 10 and df.inputFiles()[0].startswith(("file:", "/"))


def test_sections_by_file_and_cleared_folders(spark, tmp_path):
    from tessera.sources import shared
    from tessera.sources.files import section_lines

    (tmp_path / "a.csv").write_text("first\nname,x\nr,1\n\nsecond\r\nname,y,z\r\ns,2,3\n")
    (tmp_path / "b.csv").write_text("first\nname,x\nr,9\n")
    found = {(r.path[-5:], r.title, r.name, r.column, r.cell) for r in files.sections(section_lines(spark, str(tmp_path)), ["path"]).collect()}
    assert found == {("a.csv", "first", "r", "x", "1"), ("a.csv", "second", "s", "y", "2"), ("a.csv", "second", "s", "z", "3"), ("b.csv", "first", "r", "x", "9")}
    mark = shared.named_so_far()
    kept, gone = shared.written(spark.range(3).toDF("a"), "kept"), None
    mark = shared.named_so_far()
    gone = shared.fresh_dir(spark, "gone")
    spark.range(3).write.parquet(gone)
    shared.fresh_dir(spark, "never written")
    assert shared.clear_written(spark, mark) == 1 and shared.named_so_far() == mark and kept.count() == 3


def test_signature_graph_with_a_least_share(spark):
    from tessera.operators.cluster import signature_graph

    rng = __import__("random").Random(6)
    rows = [(c, i, rng.randrange(3)) for i in range(150) for c in "abcd"]
    long = spark.createDataFrame(rows, "candidate string, row_id long, label int")
    tuples = {}
    for i in range(150):
        tuples.setdefault(tuple(x for _, j, x in sorted(r for r in rows if r[1] == i)), []).append(i)
    for least in (0.0, 0.5, 0.75, 1.0):
        wanted = {(min(a), min(b), len(a), len(b), sum(x == y for x, y in zip(s, t)) / 4) for s, a in tuples.items() for t, b in tuples.items() if min(a) < min(b) and sum(x == y for x, y in zip(s, t)) >= max(1, 4 * least)}
        assert {tuple(r) for r in signature_graph(long, least).collect()} == wanted
