"""Readers and writers on small files."""
from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trajlake.operators.blocks import Axis
from trajlake.schema import EPISODE_INDEX, LEDGER
from trajlake.sources import files as I
from trajlake.sources import sinks as O


def test_typed_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("path\tsize\tepisodes:int\tusable\nb/x\t10\t3\tyes\na/y\t\t\t\n")
    df = I.read_typed_tsv(spark, str(path))
    rows = {r.path: (r["size"], r.episodes, r.usable) for r in df.collect()}
    assert rows == {"b/x": (10, 3, True), "a/y": (None, None, None)}
    O.write_typed_tsv(df.select("path", "size", "episodes"), str(tmp_path / "out"), ["path"], ints=["episodes"])
    again = I.read_typed_tsv(spark, str(tmp_path / "out"))
    assert [(r.path, r["size"], r.episodes) for r in again.orderBy("path").collect()] == [("a/y", None, None), ("b/x", 10, 3)]


def test_tabs_are_found(spark):
    df = spark.createDataFrame([("a\tb", "x"), ("c", "d")], "p string, q string")
    assert [(r.column, r.cells) for r in O.bad_cells(df).collect()] == [("p", 1)]


def test_ledger_last_file_wins(spark, tmp_path):
    for name, digest in (("a", "1"), ("b", "2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(json.dumps({"id": "fam/x", "local_path": "raw/fam/x", "sha256_verified": digest}, indent=1))
    assert [(r.id, r.sha256_verified) for r in I.read_ledger(spark, str(tmp_path), LEDGER).collect()] == [("fam/x", "2")]


def test_records_of_several_roots(spark, tmp_path):
    for root in ("r1", "r2"):
        (tmp_path / root / "records" / "fam").mkdir(parents=True)
        (tmp_path / root / "records" / "fam" / "a.jsonl").write_text(json.dumps({"uid": root, "status": "ok"}) + "\n\n")
    df = I.read_records(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], "uid string, status string")
    assert sorted(r.uid for r in df.collect() if r.uid) == ["r1", "r2"]


def test_trajectories_read_only_what_is_named(spark, tmp_path):
    spark.createDataFrame([(0.0, [1.0, 2.0], "wide")], "timestamp double, state array<double>, other string").coalesce(1).write.parquet(str(tmp_path / "episode_1"))
    part = next((tmp_path / "episode_1").glob("*.parquet"))
    part.rename(tmp_path / "episode_00000001.parquet")
    df = I.read_trajectories(spark, str(tmp_path / "episode_00000001.parquet"), ["timestamp"])
    assert df.first().episode == "episode_00000001"
    assert "other" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_file_digests_agree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    body = b"hello\n" * 1000
    (tmp_path / "d" / "f.bin").write_bytes(body)
    for df in (I.small_file_digests(spark, str(tmp_path / "d")), I.file_digests(spark, str(tmp_path / "d"), chunk=77)):
        r = df.first()
        assert (r.sha256, r.sha1, r.bytes) == (hashlib.sha256(body).hexdigest(), hashlib.sha1(body).hexdigest(), len(body))
        assert r.git_blob_sha1 == hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()


def test_trajectory_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"env_info": {"env_id": "Pick", "max_episode_steps": 5}, "source_type": "rl", "episodes": [
        {"episode_id": 0, "episode_seed": 7, "success": True}, {"episode_id": 1, "episode_seed": 8, "success": False}]}, indent=1))
    assert [(r.env_id, r.episode_seed, r.success) for r in I.read_trajectory_metadata(spark, str(tmp_path / "m.json")).orderBy("episode_id").collect()] == [("Pick", 7, True), ("Pick", 8, False)]


def test_source_registry(spark, tmp_path):
    @I.register_source("literal")
    def literal(session, path, **options):
        return {"frames": session.range(options["n"])}

    assert I.read_source(spark, "literal", "", n=3)["frames"].count() == 3
    with pytest.raises(KeyError):
        I.read_source(spark, "nothing", "")


def index_rows(spark, *files):
    return spark.createDataFrame([(f"u{f}", f, "fam", "d", "t", None, ["head"], True, None, "mit", None, None, 40, 0.78) for f in files], EPISODE_INDEX)


def test_index_is_sorted_and_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "index")
    O.write_index(index_rows(spark, "b", "a"), path)
    O.write_index(index_rows(spark, "c", "a", "b"), path)
    got = spark.read.parquet(path)
    assert [r.file for r in got.orderBy("file").collect()] == ["a", "b", "c"] and got.first().tier_p_passed is None
    assert [p.name for p in tmp_path.iterdir()] == ["index"]
    with pytest.raises(ValueError):
        O.index_table(index_rows(spark, "a").drop("license"))


def test_new_assets_and_conflicts(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), ("c", "3"), ("c", "4"), ("d", "5")], "name string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("d", "9")], "name string, sha256 string")
    fresh, bad = O.new_assets(new, old)
    assert sorted(r.name for r in fresh.collect()) == ["b"] and sorted(r.name for r in bad.collect()) == ["c", "d"]


def test_checksum_and_job_lines(spark, tmp_path):
    O.write_checksums(spark.createDataFrame([("b", "22"), ("a", "11")], "path string, sha256 string"), str(tmp_path / "sums"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "sums")).collect()) == ["11  ./a", "22  ./b"]
    O.write_job_manifest(spark.createDataFrame([("j", 5)], "id string, stats long"), str(tmp_path / "jobs"), ["id"])
    assert spark.read.json(str(tmp_path / "jobs")).columns == ["id"]


def test_views_and_episodes_are_written(spark, tmp_path):
    from trajlake.plans.views import state
    s = state(spark, "/root/testdata/sf0.001")
    O.write_views(s, str(tmp_path / "actions"), Axis(), ["gripper_binary", "agent_v8_state"])
    wide = spark.read.parquet(str(tmp_path / "actions" / "mode=agent_v8_state"))
    assert len(wide.columns) == 32 and wide.schema["left_x"].metadata["units"].startswith("m")
    O.write_episodes(s.withColumn("dataset", F.lit("d")), str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == s.count()
    O.append_records(spark.createDataFrame([("u", "f")], "uid string, family string"), str(tmp_path / "records"))
    O.append_records(spark.createDataFrame([("v", "f")], "uid string, family string"), str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).count() == 2


def test_catalogue_opens_only_what_it_needs(spark, tmp_path):
    """One family, or inline entries, by partition; families chosen by another table prune when the plan runs."""
    from trajlake.sources.files import read_catalog
    from trajlake.sources.sinks import write_catalog

    rows = [(f"f{i % 5}/{i}", f"f{i % 5}", "table" if i % 3 == 0 else "inline") for i in range(60)]
    write_catalog(spark.createDataFrame(rows, "id string, family string, origin string"), str(tmp_path / "c"))
    path = str(tmp_path / "c")
    assert {r.id for r in read_catalog(spark, path).collect()} == {r[0] for r in rows}
    one, inline = read_catalog(spark, path, family="f2"), read_catalog(spark, path, tables=False)
    assert {r.id for r in one.collect()} == {r[0] for r in rows if r[1] == "f2"} and {r.id for r in inline.collect()} == {r[0] for r in rows if r[2] == "inline"}
    assert len({r.p for r in one.select(F.input_file_name().alias("p")).collect()}) <= 8 and all("family=f2" in r.p for r in one.select(F.input_file_name().alias("p")).collect())
    with pytest.raises(KeyError):
        read_catalog(spark, path, family="f9")
    spark.createDataFrame([("f1", "open"), ("f2", "closed")], "family string, status string").write.parquet(str(tmp_path / "s"))
    chosen = inline.join(spark.read.parquet(str(tmp_path / "s")).where("status = 'open'").select("family"), "family", "left_semi")
    assert "dynamicpruning" in chosen._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in chosen.collect()} == {r[0] for r in rows if r[1] == "f1" and r[2] == "inline"}
