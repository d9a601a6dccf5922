"""End to end: raw quotes through fitted models to every report table."""

import datetime as dt
from pathlib import Path

import pytest

from smilegrid.catalog.inputs import INFERENCE, RULES, Market
from smilegrid.operators import models
from smilegrid.plans.study import Study
from smilegrid.settings import Grid, Splits
from smilegrid.settings import Study as Settings

DATA = Path("/root/testdata/sf0.01")
# Sixty sessions leave about thirty for trading, enough for a ten-lag test.
SHORT = Splits(train_end=dt.date(2024, 1, 24), fit_end=dt.date(2024, 2, 5), min_train=8, min_validation=4, min_arma_train=8)


@pytest.mark.skipif(not DATA.exists(), reason="test data not available")
def test_whole_study(spark, tmp_path):
    source = Market(spark, str(DATA))
    grid = Grid(x_points=9, t_points=6)
    study = Study(
        spark,
        source.raw_quotes,
        source.gappy_rates,
        source.sessions,
        Settings(grid=grid, splits=SHORT, signals=RULES, inference=INFERENCE),
    )
    study.boost_configs = [{**c, "maxIter": 2} for c in models.BOOST_CONFIGS]
    study.decision_years = (2024,)
    study.bootstrap = False

    assert study.clean.count() == study.cleaning_counters["kept_basic"]
    reports = study.report_tables()
    checks = {r.check_name: (r.status, r.violations) for r in reports["checks"].collect()}
    assert len(checks) == 20
    assert {name for name, (status, _) in checks.items() if status != "PASS"} == set()
    # Volatilities recovered from prices reprice them, so the exact subset is not empty.
    exact = reports["exact_vega_subset"].first()
    assert exact.n_contracts > 0
    for name in ("forecast_model_comparison", "state_performance", "multiple_testing", "hedge_costs", "full_chain", "model_ranks"):
        assert reports[name].count() > 0, name
    written = study.write_reports(str(tmp_path / "reports"))
    assert sorted(written) == sorted(reports)
