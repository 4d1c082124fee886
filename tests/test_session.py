"""The shared folder and the tables in it."""

import os

import pytest

from exonia import session


def test_stored_tables_are_discarded(spark):
    df = session.stored(spark.range(5), "five")
    assert df.count() == 5 and os.path.isdir(df._stored_in)
    assert df._stored_in.startswith(spark.conf.get("spark.checkpoint.dir"))
    session.discard(df)
    assert not os.path.exists(df._stored_in)


class Cluster:
    """As much of a session as shared_dir asks for, on a cluster."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)
