import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from worklens.session import get_session

    session = get_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Value of one expression over one row of named values."""
    def run(expression, schema="x string", **row):
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        frame = spark.createDataFrame([tuple(row.get(n) for n in names)], schema)
        return frame.select(expression.alias("v")).first()["v"]
    return run


def _leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    name = plan.getClass().getSimpleName()
    if name.endswith("QueryStageExec"):
        plan = plan.plan()
    if name == "FileSourceScanExec":
        return [plan]
    kids = plan.children()
    return [x for i in range(kids.size()) for x in _leaves(kids.apply(i))]


@pytest.fixture(scope="session")
def files_read():
    """Files that the scans of a folder open when a frame is computed."""
    def run(df, folder):
        df.collect()
        return sum(p.metrics().apply("numFiles").value() for p in _leaves(
            df._jdf.queryExecution().executedPlan())
            if folder in p.relation().location().rootPaths().mkString())
    return run
