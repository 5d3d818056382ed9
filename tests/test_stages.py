import pytest

from linkloom.plans import canonical, stages  # noqa: F401  canonical registers its stages
from linkloom.plans.stages import Store, execute, expand, parameters, plan
from linkloom.streaming.ingest import ingest


def test_missing_input(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    code, manifest = execute(store, ["edges"])
    assert code == 2 and manifest[0]["missing"] == ["pagelinks", "linktarget", "page", "rdmap"]
    assert [s for _, s, _ in plan(store, ["redirects", "edges"])] == ["missing-input", "missing-input"]


def test_expand_and_parameters():
    assert [s.name for s in expand(["dedup", "edges", "dedup"])] == ["edges", "dedup"]
    assert "prune" not in {s.name for s in expand(["all"])}
    with pytest.raises(KeyError):
        expand(["nothing"])
    s = stages.REGISTRY["prune"]
    assert parameters(s, {"stages": {"prune": {"budget": 5}}}, ["prune.budget=7"]) == {"budget": 7, "mode": "smart"}
    with pytest.raises(KeyError):
        parameters(s, {}, ["prune.wrong=1"])


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    args = (spark, str(folder), "pagelinks", str(tmp_path / "out"), str(tmp_path / "state"))
    for n, line in enumerate(["INSERT INTO x VALUES (1,0,2),(3,0,4);", "INSERT INTO x VALUES (5,0,6);"]):
        (folder / f"{n}.sql").write_text(line + "\n")
        ingest(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
