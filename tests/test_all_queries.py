"""Every query of the catalog runs on the smallest tables and returns a stable schema."""
from conftest import SF_SMALL

from raterlab.plans import catalog


def test_every_registered_query_runs(spark):
    failures = {}
    for name, fn in catalog.QUERIES.items():
        try:
            df = fn(spark, SF_SMALL)
            cols = df.columns
            df.collect()
            assert fn(spark, SF_SMALL).columns == cols
        except Exception as ex:  # noqa: BLE001 — collect all failures
            failures[name] = str(ex)[:300]
    assert not failures, failures
