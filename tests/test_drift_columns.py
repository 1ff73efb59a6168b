import pytest

from peerlens.operators.drift import MOST_COLUMNS, unified_records


def test_too_many_columns_raise(spark):
    aliases = spark.range(MOST_COLUMNS + 1).selectExpr("concat('h', id) AS header", "concat('c', id) AS column_name")
    with pytest.raises(ValueError):
        unified_records(None, None, aliases)
