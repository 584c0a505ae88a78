"""Staged tables live in the shared folder and are removed on request."""

import os

import pytest

from panelloom.sources import storage, tabular
from panelloom.spec import PanelSpec


def test_stage_and_clear(spark):
    staged = storage.stage(spark.range(10).selectExpr("id", "id % 3 AS g"), "probe")
    root = storage.scratch_root(spark).removeprefix("file:")
    assert staged.count() == 10 and root.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert any(n.startswith("probe-") for n in os.listdir(root))
    storage.clear_scratch(spark)
    assert not os.path.exists(root)


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())


def test_cut_keeps_rows(spark):
    assert storage.cut(spark.range(5)).count() == 5


def _folder(tmp_path):
    (tmp_path / "in" / "day=1" / "part").mkdir(parents=True)
    return str(tmp_path / "in")


def test_a_changed_file_in_a_nested_folder_gives_new_rows(spark, tmp_path):
    source = _folder(tmp_path)
    nested = tmp_path / "in" / "day=1" / "part" / "a.csv"
    nested.write_text("x\n1\n")
    build = lambda: spark.read.option("recursiveFileLookup", True).csv(source, header=True)
    first = storage.reused(spark, "nested", [source], build)
    assert first.count() == 1 and storage.reused(spark, "nested", [source], build).inputFiles() == first.inputFiles()
    nested.write_text("x\n1\n2\n")
    assert storage.reused(spark, "nested", [source], build).count() == 2
    (tmp_path / "in" / "day=1" / "part" / "_log").write_text("hidden files do not count")
    state = storage.version(spark, [source])
    (tmp_path / "in" / "day=1" / "part" / "_log").write_text("not even when they change")
    assert storage.version(spark, [source]) == state


def test_an_expired_table_is_built_anew_and_released_without_readers(spark, tmp_path):
    source, built = _folder(tmp_path), []
    (tmp_path / "in" / "a.csv").write_text("x\n1\n")

    def build():
        built.append(1)
        return spark.range(len(built))

    first = storage.reused(spark, "aging", [source], build)
    assert storage.reused(spark, "aging", [source], build).count() == 1 and len(built) == 1
    second = storage.reused(spark, "aging", [source], build, lifetime=0.0)
    assert second.count() == 2 and len(built) == 2
    assert first.count() == 1  # two frames still read the replaced table
    paths = lambda: [p for _, _, p in storage._entries(spark, "aging")]
    held = paths()
    storage.done(first)
    storage.done(first)
    assert paths() == held and len(held) == 2
    again = storage.reused(spark, "aging", [source], build)
    assert again.inputFiles() == second.inputFiles()
    storage._READERS[held[0]] = 0  # the other frame is done as well
    storage.release(spark, "aging")
    assert paths() == held[1:] and second.count() == 2


def test_a_build_that_fails_publishes_nothing(spark, tmp_path):
    source = _folder(tmp_path)
    broken = lambda: spark.range(4).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        storage.reused(spark, "broken", [source], broken)
    assert storage._entries(spark, "broken") == []
    assert storage.reused(spark, "broken", [source], lambda: spark.range(4)).count() == 4


def _panel(spark, value):
    return spark.createDataFrame([("a", 2000, value), ("a", 2001, value), ("b", 2000, value)], "country string, year int, co2 double")


def test_export_reads_its_input_once_and_publishes_together(spark, tmp_path, monkeypatch):
    spec, out, reads = PanelSpec(), str(tmp_path / "out"), spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            reads.add(batch.num_rows)
            yield batch

    df = _panel(spark, 1.0)
    read = lambda paths: {n: spark.read.parquet(p).agg({"co2": "sum"}).first()[0] for n, p in paths.items()}
    paths = tabular.export_panel(df.mapInArrow(counted, df.schema), spec, out, keys=["b"])
    assert reads.value == 3 and read(paths) == {"processed": 3.0, "latest_snapshot": 2.0, "key_countries": 1.0}
    plain = tabular.write_table

    def failing(frame, path, kind):
        if path.endswith("key_countries"):
            raise OSError("disk")
        plain(frame, path, kind)

    monkeypatch.setattr(tabular, "write_table", failing)
    with pytest.raises(OSError, match="disk"):
        tabular.export_panel(_panel(spark, 5.0), spec, out, keys=["b"])
    assert read(paths) == {"processed": 3.0, "latest_snapshot": 2.0, "key_countries": 1.0}
    monkeypatch.setattr(tabular, "write_table", plain)
    moved = storage.move

    def stuck(spark, source, target):
        if target == f"{out}/key_countries" and "/new/" in source:
            raise OSError("moved")
        moved(spark, source, target)

    monkeypatch.setattr(storage, "move", stuck)
    with pytest.raises(OSError, match="moved"):
        tabular.export_panel(_panel(spark, 5.0), spec, out, keys=["b"])
    assert read(paths) == {"processed": 3.0, "latest_snapshot": 2.0, "key_countries": 1.0}
    monkeypatch.setattr(storage, "move", moved)
    assert read(tabular.export_panel(_panel(spark, 5.0), spec, out, keys=["b"]))["processed"] == 15.0
    assert sorted(os.listdir(out)) == ["key_countries", "latest_snapshot", "processed"]
