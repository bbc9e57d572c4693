import pytest

from mnemospark import session as S


class Conf(dict):
    def get(self, key, default=None):  # noqa: A003
        return super().get(key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_has_to_name_its_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            S.shared_dir(Fake(spark_master=master))
        assert S.shared_dir(Fake(spark_master=master, **{"spark_checkpoint_dir": "s3a://bucket/shared"})) == "s3a://bucket/shared"
    assert S.shared_dir(Fake(spark_master="local[4]")).startswith("file:///")


def test_tables_are_deleted(spark):
    df = S.materialize(spark.range(3))
    path = df._own_table
    assert df.count() == 3 and S.path_exists(spark, path)
    S.release(df)
    S.release(df)
    assert not S.path_exists(spark, path)
    other = S.materialize(spark.range(2))._own_table
    S.release_all()
    assert not S.path_exists(spark, other)
