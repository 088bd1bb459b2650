import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugewell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4, spark__driver__memory="6g")


@pytest.fixture(scope="session")
def sf(request):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sensor():
    """Hourly sensor table with planted extremes."""
    rng = np.random.default_rng(42)
    n = 1000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "datetime": [dt.datetime(2023, 1, 1) + dt.timedelta(hours=i) for i in range(n)],
            "temperature": rng.normal(25, 5, n),
            "humidity": rng.normal(60, 10, n),
            "pressure": rng.normal(1013, 20, n),
            "wind_speed": rng.exponential(10, n),
            "category": rng.choice(list("ABC"), n),
            "value": rng.integers(1, 100, n),
        }
    )
    pdf.loc[50:55, "temperature"] = 100.0
    pdf.loc[100:105, "humidity"] = -10.0
    return pdf


@pytest.fixture(scope="session")
def sensor_df(spark, sensor):
    return spark.createDataFrame(sensor).repartition(5).cache()
