import os

import pytest

from graphloom import session
from graphloom.plans import registry


def test_written_tables_are_read_back_and_released(spark):
    df = session.cut(spark.range(5).selectExpr("id", "cast(null as string) t"), "five")
    assert df.count() == 5 and df.dtypes == [("id", "bigint"), ("t", "string")]
    folder = session.new_folder(spark, "x")
    assert folder.startswith(session.shared_folder(spark))


def test_scratch_tables_go_at_the_end_of_their_block(spark):
    outer = session.cut(spark.range(2), "outer")
    with session.scratch():
        inner = session.cut(spark.range(3), "inner").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(inner)
    assert not os.path.exists(inner) and outer.count() == 2


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_every_statement_belongs_to_a_query():
    assert set(registry.sql()) <= set(registry.queries())


def test_the_code_is_shipped_once(spark):
    session.ship(spark)
    session.ship(spark)
    assert spark.sparkContext.applicationId in session._shipped
    assert os.path.isdir(os.path.dirname(session.__file__))
