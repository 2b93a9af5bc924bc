import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from onoma.session import local_session

    s = local_session("*", shuffle_partitions=8, app="onoma-tests")
    yield s
    s.stop()


@pytest.fixture
def names_df(spark):
    """The FIXTURES golden match table (keys 1..8)."""
    rows = [
        (1, "Ana Gómez Ruiz", "ana gomez ruiz"),
        (2, "ana gomez ruiz", "ana gomez ruiz"),
        (3, "Juan Carlos Perez", "juan carlos perez"),
        (4, "Juan Perez", "juan perez"),
        (5, "An", "an"),
        (6, "María García", "maria garcia"),
        (7, "!!", ""),
        (8, "Perez, Juan", "perez juan"),
    ]
    return spark.createDataFrame(rows, "id long, full_name string, normalized_name string")
