from pathlib import Path

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from delaylake import workspace
from delaylake.config import LakeConfig
from delaylake.operators import model, silver
from delaylake.plans import flow
from delaylake.plans.checks import records_of
from delaylake.plans.flow import run_flow
from delaylake.streaming import bronze
from delaylake.streaming.bronze import read_bronze
from delaylake.workspace import fresh_dir, shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flow") / "csv")
    records = records_of(spark, SF)
    records.write.options(header=True, quote='"', escape='"').csv(path)
    return path, records.count()


def test_whole_run_twice(spark, source, tmp_path):
    path, total = source
    cfg = LakeConfig(root=str(tmp_path / "lake"), source_csv=path, silver_partitions=("year",))
    first = run_flow(spark, cfg)
    assert sum(first["ingest"].values()) == first["bronze"] == first["silver"] == total
    assert set(first["ingest"]) == set(range(1, 11))
    undated = spark.read.parquet(cfg.silver).filter("flight_date is null").count()
    assert undated > 0 and first["load"] == total - undated
    assert set(first["train"]) == {"auc", "f1", "weighted_precision", "weighted_recall"}
    held_out = spark.read.parquet(cfg.training).filter("not known")
    scored = model.load(spark, cfg.model).transform(held_out)
    evaluator = BinaryClassificationEvaluator(numBins=0)
    assert first["train"]["auc"] == pytest.approx(evaluator.evaluate(scored), abs=1e-9)
    assert spark.read.parquet(cfg.training).count() == total

    again = run_flow(spark, cfg, steps=("ingest", "bronze", "silver", "load"))
    assert again == {k: first[k] for k in again}


def test_frame_as_source_and_single_steps(spark, tmp_path):
    cfg = LakeConfig(root=str(tmp_path / "lake"), slices=3, files_per_batch=1)
    records = records_of(spark, SF).limit(100)
    found = run_flow(spark, cfg, records, steps=["bronze", "ingest"])
    assert list(found) == ["ingest", "bronze"]
    assert found["ingest"] == {1: 33, 2: 33, 3: 34} and found["bronze"] == 100
    with pytest.raises(ValueError, match="unknown steps"):
        run_flow(spark, cfg, steps=["sliver"])


def test_paced_slices_give_the_same_and_are_not_published_twice(spark, tmp_path):
    records = records_of(spark, SF).limit(50)
    paced = LakeConfig(root=str(tmp_path / "lake"), slices=4, pause_seconds=0.01)
    at_once = LakeConfig(root=paced.root, slices=4)
    for cfg in (paced, paced, at_once):
        found = run_flow(spark, cfg, records, steps=["ingest", "bronze"])
        assert found == {"ingest": {1: 12, 2: 12, 3: 12, 4: 14}, "bronze": 50}


def distinct_and_all(spark, cfg):
    landed = read_bronze(spark, cfg.bronze)
    return landed.distinct().count(), landed.count()


def numbered(spark, first, last):
    return spark.range(first, last).selectExpr("cast(id as string) as AIRLINE", "'x' as DEST")


def test_a_grown_source_lands_every_row_once(spark, tmp_path):
    source = str(tmp_path / "csv")
    cfg = LakeConfig(root=str(tmp_path / "lake"), source_csv=source, slices=3)
    for first, last in ((0, 20), (20, 50)):
        numbered(spark, first, last).write.mode("append").csv(source, header=True)
        found = run_flow(spark, cfg, steps=["ingest", "bronze"])
        assert sum(found["ingest"].values()) == last - first and found["bronze"] == last
        assert run_flow(spark, cfg, steps=["ingest", "bronze"]) == found
        assert distinct_and_all(spark, cfg) == (last, last)


class CutOff(Exception):
    pass


def cut_off_after(monkeypatch, slices):
    """Publishing stops after some slices, once."""
    publish = flow.publish_slice

    def some(staged, number, landing, columns):
        if number > slices:
            monkeypatch.setattr(flow, "publish_slice", publish)
            raise CutOff
        return publish(staged, number, landing, columns)

    monkeypatch.setattr(flow, "publish_slice", some)


def test_a_changed_number_of_slices_waits_for_the_next_generation(spark, tmp_path, monkeypatch):
    root, steps = str(tmp_path / "lake"), ["ingest", "bronze"]
    cfg = LakeConfig(root=root, slices=10, pause_seconds=0.01)
    cut_off_after(monkeypatch, 3)
    with pytest.raises(CutOff):
        run_flow(spark, cfg, numbered(spark, 0, 50), steps)
    found = run_flow(spark, LakeConfig(root=root, slices=5), numbered(spark, 0, 50), steps)
    assert found["ingest"] == {i: 5 for i in range(1, 11)} and found["bronze"] == 50
    assert distinct_and_all(spark, cfg) == (50, 50)
    found = run_flow(spark, LakeConfig(root=root, slices=5), numbered(spark, 50, 75), steps)
    assert found["ingest"] == {i: 5 for i in range(1, 6)} and found["bronze"] == 75


def test_a_frame_of_varying_order_cut_off_midway(spark, tmp_path, monkeypatch):
    steps = ["ingest", "bronze"]
    cfg = LakeConfig(root=str(tmp_path / "lake"), slices=5, pause_seconds=0.01)
    cut_off_after(monkeypatch, 2)
    rows = numbered(spark, 0, 50)
    with pytest.raises(CutOff):
        run_flow(spark, cfg, rows.orderBy("AIRLINE"), steps)
    found = run_flow(spark, cfg, rows.orderBy(F.desc("AIRLINE")), steps)
    assert found["bronze"] == 50 and distinct_and_all(spark, cfg) == (50, 50)


def test_lost_bronze_rows_are_noticed(spark, tmp_path):
    cfg = LakeConfig(root=str(tmp_path / "lake"), slices=2)
    run_flow(spark, cfg, numbered(spark, 0, 10), ["ingest"])
    landing = f"{cfg.landing}/generation=1/slice=2"
    read_bronze(spark, landing).limit(3).write.parquet(f"{landing}/more")
    with pytest.raises(RuntimeError, match="13 rows, but 10"):
        run_flow(spark, cfg, steps=["bronze"])


def test_silver_columns_keep_their_order(spark, tmp_path):
    cfg = LakeConfig(root=str(tmp_path / "lake"), slices=1, silver_partitions=("year", "month"))
    run_flow(spark, cfg, records_of(spark, SF).limit(50), ["ingest", "bronze", "silver"])
    assert silver.read_silver(spark, cfg.silver).columns == list(silver.SILVER_COLUMNS)


def test_scratch_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_dir", lambda _: str(tmp_path))
    assert workspace.written(spark.range(3), "x").count() == 3
    path = Path(workspace.scratch_dir(spark))
    assert path.is_relative_to(tmp_path) and list(path.iterdir())
    workspace.remove_scratch(spark)
    assert not path.exists()


def test_shared_folder_is_the_one_the_session_names(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")
    assert fresh_dir(spark, "x").startswith(shared_dir(spark))


def test_tables_between_the_steps_have_files_of_bounded_length(spark, tmp_path, monkeypatch):
    """One file for each task of the step before filled the next one's tasks unevenly."""
    for module in (bronze, silver, flow):
        monkeypatch.setattr(module, "FILE_ROWS", 10)
    source = str(tmp_path / "source")
    days = spark.range(100).coalesce(1)
    days.selectExpr(
        "'2024-01-02' FL_DATE", "concat('C', id) AIRLINE", "'O' ORIGIN", "'D' DEST", "id DISTANCE",
        "1 DEP_DELAY", "2 ARR_DELAY", "id % 2 CANCELLED", "'' CANCELLATION_REASON",
    ).write.option("header", True).csv(source)
    cfg = LakeConfig(root=str(tmp_path / "lake"), source_csv=source, slices=1, max_iterations=1)
    flow.run_flow(spark, cfg)
    for path in (cfg.bronze, cfg.silver, cfg.training):
        table = spark.read.parquet(path)
        by_file = table.groupBy(F.input_file_name()).count().collect()
        assert max(r["count"] for r in by_file) <= 10
        assert table.count() == 100
