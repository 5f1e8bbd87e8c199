import pytest

from textloom.llm import queries

from ..test_oracle import same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    same_rows(spark, sf_dir, name, queries.queries()[name], queries.oracle_sql()[name])
