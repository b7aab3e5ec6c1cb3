import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Frames of small rows: table("doc_id long, text string", [...])."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
