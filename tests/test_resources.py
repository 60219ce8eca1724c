"""Resource folders: long lists count whole."""

from __future__ import annotations

import pytest

from taxoflow.plans import pipeline


def test_long_ordered_lists(spark, tmp_path, monkeypatch):
    (tmp_path / "terms.csv").write_text("id,label\nX_1,smoked fish\n")
    (tmp_path / "suffixes.csv").write_text("suffix\n" + "".join(f"s{i}\n" for i in range(1200)) + "fish\n")
    (tmp_path / "priority_classes.csv").write_text("label\n" + "".join(f"p{i}\n" for i in range(1200)))
    found = pipeline.load_resources(spark, str(tmp_path))
    assert found.scheme.priority == [f"p{i}" for i in range(1200)]
    assert found.table.where("suffix_mode and text = 'smoked'").count() == 1
    monkeypatch.setattr(pipeline, "ORDERED_ROWS", 1000)
    with pytest.raises(ValueError, match="more than 1000 rows"):
        pipeline.load_resources(spark, str(tmp_path))
