"""Families of tables are published whole or not at all."""

from __future__ import annotations

from pathlib import Path

import pytest

from haulmark.sources import sinks


def tables(spark, n: int) -> dict:
    return {"a": spark.range(n), "b": spark.range(2 * n).selectExpr("id", "cast(id as string) as name")}


def folders(path: Path) -> set[str]:
    return {p.name for p in path.iterdir() if p.is_dir()}


def test_a_run_that_dies_leaves_nothing_or_what_was_there(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/f"
    commit = sinks._commit

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.publish_family(spark, path, tables(spark, 5))
    orphans = folders(tmp_path / "f")
    assert len(orphans) == 1 and sinks.manifest(spark, path) is None and not sinks.verified(spark, path)
    with pytest.raises(FileNotFoundError):
        sinks.family(spark, path)
    monkeypatch.setattr(sinks, "_commit", commit)
    assert sinks.publish_family(spark, path, tables(spark, 5))
    assert folders(tmp_path / "f").isdisjoint(orphans) and {n: d.count() for n, d in sinks.family(spark, path).items()} == {"a": 5, "b": 10}
    # what is verified is kept, even against other tables, and so is its version
    version = sinks.manifest(spark, path)["version"]
    assert not sinks.publish_family(spark, path, tables(spark, 7)) and sinks.manifest(spark, path)["version"] == version


def test_broken_families_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    sinks.publish_family(spark, path, tables(spark, 5))
    version = sinks.manifest(spark, path)["version"]
    for file in (tmp_path / "f" / version / "a").glob("*.parquet"):
        file.unlink()
    assert not sinks.verified(spark, path)
    assert sinks.publish_family(spark, path, tables(spark, 6))
    assert sinks.manifest(spark, path)["version"] != version and sinks.family(spark, path)["a"].count() == 6
