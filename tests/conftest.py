import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loanloom import Portfolio  # noqa: E402
from loanloom.session import local_session  # noqa: E402
from loanloom.sources.schemas import RAW_DDL  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(cores=4, shuffle_partitions=4, memory="4g",
                            extra={"spark.sql.warehouse.dir": str(warehouse),
                                   "spark.sql.maxMetadataStringLength": "20000",
                                   "spark.sql.debug.maxToStringFields": "500"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def portfolio(spark):
    return Portfolio.from_fixture(spark, f"{TESTDATA}/sf0.001")


@pytest.fixture(scope="session")
def raw_rows(spark):
    """Build rows of a raw table from the columns that matter; the others are NULL."""
    def build(table, *rows):
        names = [column.split()[0] for column in RAW_DDL[table].split(",")]
        unknown = {name for row in rows for name in row} - set(names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows],
                                     RAW_DDL[table].replace("\n", " "))
    return build


def dicts(rows):
    return [row.asDict() for row in rows.collect()]


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()
