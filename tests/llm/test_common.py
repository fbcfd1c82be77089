"""Folders that all machines share."""

from types import SimpleNamespace

import pytest

from corpusloom.llm import common


def session(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None), setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_clusters_must_name_a_folder():
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "s3a://shared/dir")) == "s3a://shared/dir"
    here = session("local[4]")
    assert common.shared_dir(here) == common.shared_dir(here)
