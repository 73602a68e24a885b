"""Every registered query with SQL, compared with DuckDB on the smallest tables."""

import pytest

from culvert import catalog
from culvert.plans.compare import check

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, name):
    verdict, rows, _ = check(spark, SF, catalog.QUERIES[name], catalog.ORACLE[name])
    assert verdict == "ok", (name, rows, verdict)


def test_models_produce_rows(spark):
    assert catalog.QUERIES["traffic_predictions"](spark, SF).count() > 0
