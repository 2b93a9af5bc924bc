"""Rows that every operator has to take."""

import pytest
from pyspark.sql import functions as F

from onoma.llm.common import prepare
from test_operators import DOC_SCHEMA, EDGE


@pytest.fixture(scope="session")
def session(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd(session):
    """Nulls, blanks, repeats and a long text, with extra columns of names that the operators use."""
    df = session.createDataFrame(EDGE, DOC_SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("n", "chunk", "ids", "shard", "word", "node", "part", "answers", "a", "b", "id")})


@pytest.fixture(scope="session")
def none(session):
    return session.createDataFrame([], DOC_SCHEMA)
