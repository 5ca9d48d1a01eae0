import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="module")
def odd(spark):
    from cases import ODD, frame

    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    from cases import frame

    return frame(spark, [])
