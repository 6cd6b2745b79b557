from __future__ import annotations

from types import SimpleNamespace

import pytest

from resamplia.operators import store


def test_session_settings(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.sparkContext.master == "local[4]"


def test_nothing_is_written_to_local_folders():
    """No module of the library makes a temporary folder or cuts lineage by itself, but `store`, whose folder is the session's."""
    from pathlib import Path

    import resamplia

    for path in Path(resamplia.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts and path.name != "store.py":
            text = path.read_text()
            assert "mkdtemp" not in text and "checkpoint" not in text.lower(), path


def session(master, folder=None):
    """What `store` asks a session for."""
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default))


def test_store_uses_the_folder_of_the_session():
    for master in ("local[4]", "local-cluster[3,2,1000]", "yarn"):
        given = session(master, "hdfs:///shared")
        assert store.shared_folder(given) == "hdfs:///shared" and given.sparkContext.getCheckpointDir() is None
        assert store.new_folder(given, "step").startswith("hdfs:///shared/step-")


def test_store_makes_a_folder_only_in_one_local_process():
    for master in ("local-cluster[3,2,1000]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_folder(session(master))
    alone = session("local[4]")
    assert store.shared_folder(alone) == alone.sparkContext.getCheckpointDir() == store.shared_folder(alone)
