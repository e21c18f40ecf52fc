import pytest

from pathloom import session


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Fake:
    def __init__(self, master, folder=None):
        self.sparkContext = Context(master)
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_checkpoint_folder(master):
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake(master))
    assert session.ensure_checkpoint_dir(Fake(master, "file:///shared")) == "file:///shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_a_local_session_gets_a_folder(master):
    assert "pathloom-" in session.ensure_checkpoint_dir(Fake(master))


def test_small_means_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t", "array(1, 2) AS a")
    assert session.is_small(df) and not session.is_small(df, max_rows=99) and not session.is_small(df, max_bytes=100_000)
    assert session.is_small(df.select("id"), max_bytes=100_000) and session.is_small(df.where("false"), 0, 0)
