"""Where tables are written when no shared folder is set."""

from types import SimpleNamespace

import pytest
from msgspark.operators import graph


def session(master, application, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=application))


def test_a_local_master_gets_a_folder_of_its_own_and_others_must_set_one():
    for master in ("local", "local[4]", "local[2,3]"):
        first = graph.shared_folder(session(master, f"app-{master}"))
        assert first.startswith("file://") and graph.shared_folder(session(master, f"app-{master}")) == first
    assert graph.shared_folder(session("local[4]", "another")) != first
    for master in ("spark://far:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="far|yarn|cluster"):
            graph.shared_folder(session(master, "one"))
        assert graph.shared_folder(session(master, "one", "hdfs://x/y/")) == "hdfs://x/y"


def test_tables_are_written_there(spark):
    assert graph.saved_path(spark.range(3)).startswith(graph.shared_folder(spark) + "/saved-")
