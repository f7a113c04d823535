import pytest

from siltstone.llm import queries

from ..test_queries import duck, equal  # noqa: F401  (a fixture)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(name, spark, sf_dir, duck):  # noqa: F811
    equal(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])
