import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def facts(spark):
    """A small fact table with two states, three districts and a date gap."""
    from tallyfield.spec import DEFAULT as D

    rows = [
        ("2025-01-06", "Assam", "North", "110001", 4, 3, 3),
        ("2025-01-06", "Assam", "South", "110002", 0, 5, 0),
        ("2025-01-07", "Assam", "North", "110001", 1, 1, 8),
        ("2025-01-11", "Bihar", "North", "220001", 2, 2, 2),
        ("2025-03-02", "Bihar", "North", "220002", 10, 0, 0),
        ("2025-03-02", "Bihar", "North", None, 0, 0, 7),
    ]
    df = spark.createDataFrame(rows, "d string, state string, district string, pincode string, a bigint, b bigint, c bigint")
    return df.selectExpr(
        "to_date(d) AS date", "state", "district", "pincode", "a AS age_0_5", "b AS age_5_17",
        "c AS age_18_greater", f"a + b + c AS {D.total}",
    )


def series(spark, values, start="2025-01-06"):
    """A gapless daily series."""
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, value bigint").selectExpr(
        f"date_add(date'{start}', i) AS date", "value"
    )
