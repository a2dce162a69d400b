import pytest
from conftest import duck_rows, rows

from lodestone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    got = rows(registry.QUERIES[name](spark, data))
    if name in registry.SQL:
        assert got == duck_rows(duck, registry.SQL[name])
    elif name != "cmp_03_marking":
        assert got[1]
