from __future__ import annotations

from types import SimpleNamespace

import pytest

from pitchlake.operators.lineage import checkpoint_folder


def session(master, **conf):
    held = dict(conf)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        checkpoint_folder(session("spark://host:7077"))
    assert checkpoint_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    alone = session("local[4]")
    assert checkpoint_folder(alone) == checkpoint_folder(alone)
