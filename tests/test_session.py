"""Session settings and scratch folders."""

import os

import pytest

from vigilo import session as S
from vigilo.plans.materialize import input_signature


class FakeContext:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class FakeSpark:
    def __init__(self, master):
        self.sparkContext = FakeContext(master)
        self.conf = {}


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(FakeSpark(master))


def test_scratch_is_removed(spark):
    path = S.scratch_path(spark, "trial")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    assert path.startswith(S.scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
    assert not os.path.isdir(local)


def test_signature_follows_the_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    one = input_signature(spark, str(tmp_path))
    assert one == input_signature(spark, f"{tmp_path}")
    spark.range(50).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert input_signature(spark, str(tmp_path)) != one
    assert input_signature(spark, str(tmp_path / "absent")) == (str(tmp_path / "absent"),)
