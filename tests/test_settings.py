"""Settings and schema versions."""

import pytest

from kelpworks import schemas
from kelpworks.config import Config


def test_layers(tmp_path):
    p = tmp_path / "config.toml"
    p.write_text('[search]\nhybrid_alpha = 1\nother = 2\n[index]\nlanguages = ["go"]\n[pack]\ndefault_token_budget = "many"\n[locate_smart]\nmax_steps = 9\n')
    c = Config.load(str(p), {"KELPWORKS_LOCATE_SMART_ENABLED": "1", "KELPWORKS_LOCATE_SMART_MAX_STEPS": "3", "KELPWORKS_INDEX_EXCLUDE": "a, b"})
    assert (c.search.hybrid_alpha, c.index.languages, c.index.exclude, c.pack.default_token_budget, c.locate_smart.enabled, c.locate_smart.max_steps) == (1.0, ["go"], ["a", "b"], 50_000, True, 3)
    assert Config.load(str(tmp_path / "none"), {}) == Config()


def test_bad_files_and_values(tmp_path):
    p = tmp_path / "config.toml"
    p.write_text("[search\n")
    with pytest.warns(UserWarning):
        assert Config.load(str(p), {}) == Config()
    with pytest.warns(UserWarning):
        assert Config.load(None, {"KELPWORKS_SEARCH_HYBRID_ALPHA": "x"}) == Config()


def test_migrate(spark):
    old = spark.createDataFrame([("f::a::1", "g::b::2", "Calls", "Heuristic", "x")], "from_id string, to_id string, kind string, confidence string, extra string")
    new = schemas.migrate("edges", old, 1)
    row = new.first()
    assert (row["from_file"], row["to_name"], row["from_start"]) == ("f", "b", 1) and "extra" not in new.columns
    assert schemas.migrate("edges", new, schemas.VERSION).collect() == new.collect()
    assert schemas.conform("vectors", old.limit(0)).columns == ["chunk_id", "embedding", "model", "dimension"]
