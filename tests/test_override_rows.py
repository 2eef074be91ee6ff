"""The rows that a model is fitted on are made once."""

import os

import pytest

from larkspur.plans import enriched

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_fit_reads_written_rows(spark):
    df = enriched.override_model(spark, SF)
    assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert df.count() == enriched._override(spark, SF).where("split = 'test'").count()
