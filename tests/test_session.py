"""Where intermediate tables go."""

import pytest

from vitalgrid.session import shared_base


class _Context:
    applicationId = "app"

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder


class _Session:
    def __init__(self, master, conf=None, folder=None):
        self.sparkContext = _Context(master, folder)
        self.conf = conf or {}


def test_the_shared_folder_is_taken_in_order():
    assert shared_base(_Session("yarn", {"spark.checkpoint.dir": "s3://a/b/"}, "hdfs:/c")) == "s3://a/b"
    assert shared_base(_Session("yarn", {}, "hdfs:/c")) == "hdfs:/c"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_base(_Session(master))


def test_a_local_master_gets_one_folder_of_its_own():
    assert shared_base(_Session("local[4]")) == shared_base(_Session("local[4]"))
