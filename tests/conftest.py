import pytest

from folioscope.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a one-row table."""
    def run(*columns, **values):
        row = {k: v for k, v in values.items()} or {"_": 0}
        schema = ", ".join(f"{k} {_kind(v)}" for k, v in row.items())
        out = spark.createDataFrame([tuple(row.values())], schema).select(*columns).first()
        return out[0] if len(out) == 1 else tuple(out)

    return run


def _kind(value):
    if isinstance(value, list):
        return f"array<{_kind(value[0])}>"
    return {str: "string", int: "bigint", float: "double", type(None): "string"}[type(value)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
