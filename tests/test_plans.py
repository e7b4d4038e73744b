"""Plan regressions: raw passes per operator and no cartesian products."""

import os
import sys

import pytest

from shared import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "scripts"))

from bench import HEADLINE  # noqa: E402
from plan_report import rows_scanned  # noqa: E402
from tillroll.sources import fixtures  # noqa: E402
from tillroll.sources.tables import write_table  # noqa: E402

# measured in PLANS.md; extra passes are narrow column scans
EXTRA_PASSES = {"kpi_summary": 3, "product_performance": 2, "recommendations": 4}


@pytest.fixture(scope="module")
def sales(spark):
    return write_table(fixtures.sales(spark, SF_SMALL), "plan_test_sales")


@pytest.mark.parametrize("name", sorted(HEADLINE))
def test_raw_passes_and_no_cartesian(spark, sales, name):
    spark.catalog.clearCache()
    df = HEADLINE[name](sales)
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    n = sales.count()
    passes = rows_scanned(df, "plan_test_sales") / n
    assert passes == pytest.approx(EXTRA_PASSES.get(name, 1))
    assert "CartesianProduct" not in qe.executedPlan().toString()
