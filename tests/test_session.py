import os

import pytest

from quillgraph import session as S


class Stub:
    """A session without the setting."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId = master, "app-1"

    def get(self, key, default):
        return default


def test_shared_dir_comes_from_the_session(spark):
    assert S.shared_dir(spark) == spark.conf.get(S.CHECKPOINT_KEY)


def test_own_folder_only_in_local_sessions():
    own = S.shared_dir(Stub("local[2]"))
    assert own == S.shared_dir(Stub("local[2]")) and os.path.isdir(own.removeprefix("file://"))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            S.shared_dir(Stub(master))


def test_cut_restarts_the_plan_and_forget_removes_it(spark):
    df = S.cut(spark.range(5).selectExpr("id * 2 as x"))
    assert sorted(r.x for r in df.collect()) == [0, 2, 4, 6, 8] and "Range" not in df._jdf.queryExecution().toString()
    S.forget(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0])
