import os
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from setflow.sources.durable import discard, scratch, shared_dir, stored


def test_scratch_deletes_all_but_what_is_kept(spark):
    with scratch(spark) as outer:
        with scratch(spark) as keep:
            a, b = stored(spark.range(3), "a"), stored(spark.range(4), "b")
            keep.append(b)
        assert not os.path.exists(a._stored_at.removeprefix("file://")) and b.count() == 4
        c = stored(spark.range(5), "c")
        outer.append(c)
    assert not os.path.exists(b._stored_at.removeprefix("file://")) and c.count() == 5
    discard(c, spark.range(1))
    assert not os.path.exists(c._stored_at.removeprefix("file://"))


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"])
def test_no_local_folder_on_a_cluster(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError):
        shared_dir(session)
    session.conf.get = lambda *a: "hdfs://x/y/"
    assert shared_dir(session) == "hdfs://x/y"


def test_only_missing_optional_parts_are_forgiven(monkeypatch):
    def missing(name):
        def run(_):
            raise ModuleNotFoundError(name=name)

        return run

    monkeypatch.setattr(entry, "import_module", missing("setflow.llm"))
    assert entry._optional("setflow.llm.queries") is None and entry._llm() == ({}, {})
    for other in ("setflow.llm.ogg", "xxhash", "setflow"):
        monkeypatch.setattr(entry, "import_module", missing(other))
        with pytest.raises(ModuleNotFoundError):
            entry.queries()
