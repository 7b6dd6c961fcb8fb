import pytest

from forecourt.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "forecourt-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of an expression over a list of inputs."""
    from pyspark.sql import functions as F

    def run(expression, values, kind="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        rows = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in rows]

    return run
