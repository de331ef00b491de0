"""The shared folder: the session's setting first, a local one only where all runs in one process."""

import pytest

from kindred.sources import shared


class Session:
    """What ``shared_folder`` asks of a session."""

    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def set(self, name, value):
        self.settings[name] = value


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]", ""])
def test_a_cluster_needs_a_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(spark_master=master))
    assert shared.shared_folder(Session(**{"spark.master": master, "spark.checkpoint.dir": "hdfs://a/b"})) == "hdfs://a/b"


def test_one_process_gets_a_temporary_folder():
    session = Session(spark_master="local[4]")
    folder = shared.shared_folder(session)
    assert folder.startswith("file://") and shared.shared_folder(session) == folder


def test_written_tables_are_read_back(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) AS x")
    again = shared.written(df)
    assert again.dtypes == df.dtypes and again.count() == 10


def test_release_keeps_what_is_still_read(spark):
    mine = (spark.sparkContext.applicationId, "me")
    with shared.owned("me"):
        first, second = shared.written(spark.range(5)), shared.written(spark.range(7))
        with shared.owned("another"):
            other = shared.written(spark.range(3))
    free = shared.written(spark.range(4))
    shared.release(second.where("id > 1"), "me")
    assert (second.count(), other.count(), free.count()) == (7, 3, 4)
    assert {p.rsplit("/", 1)[1] for p in shared.TABLES[mine]} == {second.inputFiles()[0].split("/")[-2]}
    with pytest.raises(Exception, match="(?i)not exist|not found|FileNotFound"):
        first.selectExpr("sum(id)").collect()
    shared.release(spark.range(1), "me")
    assert not shared.TABLES[mine] and other.count() == 3
