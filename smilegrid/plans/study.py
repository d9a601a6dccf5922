"""The whole study as lazily built, materialised stages."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import calendar as cal
from ..operators import (
    archive,
    checks,
    cleaning,
    features,
    implied_vol,
    mapping,
    models,
    pnl,
    quotes,
    reports,
    risk,
    robustness,
    scoring,
    signals,
    stats,
    surface,
)
from ..settings import FORECAST_MODELS, TRADED_MODELS, Study as Settings
from ..sources import tables
from .lineage import cut, drop_stages


def refuse(rows: DataFrame, sound: Column, message: str) -> DataFrame:
    """All rows of a stored table, or an error as soon as one is not sound."""
    error = F.raise_error(F.lit(message)).cast("boolean")
    return rows.where(F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(error))


class Study:
    """Quotes, rates and a session calendar in; surfaces, signals, portfolios and
    report tables out.

    Each stage is a frame built on first use. Stages that feed several others are
    written once to the shared folder (`cut`), so a lost executor costs at most
    one stage and no consumer replans the chain. With `archive`, the path of the
    same raw quotes stored by `archive.write_archive`, exit quotes are looked up
    there instead of by a scan.
    """

    bootstrap = True
    surface_method = "separable"
    archive: str | None = None

    def __init__(self, spark: SparkSession, raw_quotes: DataFrame, raw_rates: DataFrame, sessions: DataFrame, settings: Settings = Settings()):
        self.spark = spark
        self.raw_quotes = raw_quotes
        self.raw_rates = raw_rates
        self.sessions = sessions
        self.use(settings)

    def use(self, settings: Settings) -> None:
        self.cleaning_rules, self.grid, self.splits = settings.cleaning, settings.grid, settings.splits
        self.rules, self.inference = settings.signals, settings.inference

    # ------------------------------------------------------------ quotes to surface

    @cached_property
    def calendar(self) -> DataFrame:
        return cal.calendar_table(self.sessions)

    @cached_property
    def rates(self) -> DataFrame:
        return cut(cleaning.prepare_rates(self.raw_rates))

    @cached_property
    def flagged(self) -> DataFrame:
        return cleaning.with_first_failure(self.raw_quotes, self.rates, self.cleaning_rules)

    @cached_property
    def clean(self) -> DataFrame:
        """Kept quotes. The funnel counters are observed while the rows are written,
        so the raw archive is read once for both."""
        counters = Observation("cleaning")
        failed = F.col("first_fail")
        watched = self.flagged.observe(
            counters,
            F.count(F.lit(1)).alias("input"),
            *[F.count_if(failed == name).alias("dropped_" + name) for name, _ in cleaning.FUNNEL],
            F.count_if(failed.isNull()).alias("kept_basic"),
        )
        out = cut(cleaning.kept(watched))
        self.cleaning_counters = counters.get
        return out

    @cached_property
    def funnel(self) -> DataFrame:
        """The cleaning funnel from the counters observed while the kept quotes were written."""
        self.clean  # noqa: B018
        return cleaning.funnel_of(self.spark, self.cleaning_counters)

    @cached_property
    def iv_quotes(self) -> DataFrame:
        return cut(implied_vol.invert(self.clean))

    @cached_property
    def locations(self) -> DataFrame:
        """Median volatility per day and quoted location. The usable points are
        written once (four columns), because the median looks at them twice."""
        points = cut(surface.surface_points(self.iv_quotes, self.grid))
        return cut(surface.unique_locations(points))

    @cached_property
    def grid_surface(self) -> DataFrame:
        """Every node of every day with enough observations, NULL where not observed."""
        return cut(surface.build_surface(self.locations, self.grid, self.surface_method))

    @cached_property
    def day_stats(self) -> DataFrame:
        return cut(surface.day_stats(self.locations, self.grid_surface, self.grid, self.surface_method))

    @cached_property
    def surface(self) -> DataFrame:
        kept = surface.kept_nodes(self.grid_surface, self.day_stats)
        return cut(kept.where("iv_grid IS NOT NULL").select("quote_date", "node", "x_idx", "t_idx", "iv_grid"))

    @cached_property
    def nodes(self) -> DataFrame:
        return surface.grid_nodes(self.spark, self.grid).select("node", "log_moneyness", "T")

    @cached_property
    def market(self) -> DataFrame:
        return cut(mapping.market_day(mapping.normalise_market(self.iv_quotes)))

    # ------------------------------------------------------------ forecasts

    @cached_property
    def panel(self) -> DataFrame:
        """Every session and node; stored, as lags, both horizons and the filter models read it."""
        return cut(cal.densify(self.surface, self.calendar, self.nodes.select("node")))

    def lagged(self, horizon: int = 1) -> DataFrame:
        return features.lag_features(self.panel, self.calendar, horizon)

    boost_configs = models.BOOST_CONFIGS

    @cached_property
    def journal(self) -> DataFrame:
        """Forecasts of the four models for both horizons at every test origin."""
        base = None
        for h in (1, 2):
            masked = cut(features.split_masks(self.lagged(h), self.splits))
            fitted = {
                "ridge": models.ridge_forecast(masked, self.splits),
                "arima": models.arma_forecast(self.panel, self.splits, h),
                "xgboost": models.boosted_forecast(masked, self.splits, self.boost_configs),
            }
            if h == 1:
                base = masked.select(
                    F.col("quote_date").alias("forecast_origin_date"),
                    F.col("target_date").alias("forecast_target_date"),
                    "node",
                    F.col("lag_1").alias("forecast_persistence"),
                ).where(F.col("forecast_origin_date") >= F.lit(self.splits.fit_end))
            for name, frame in fitted.items():
                column = f"forecast_{name}" + ("" if h == 1 else "_h2")
                side = frame.select(F.col("quote_date").alias("forecast_origin_date"), "node", F.col("forecast").alias(column))
                base = base.join(side, ["forecast_origin_date", "node"], "left")
        out = scoring.attach_outcomes(
            base,
            self.surface,
            {"forecast_origin_date": "observed_iv_at_origin", "forecast_target_date": "actual_iv_at_target"},
        )
        return cut(scoring.annotate(out.join(features.regions(self.nodes), "node")))

    @cached_property
    def economic(self) -> DataFrame:
        """Decision rows with both horizons and, joined last, the outcomes."""
        base = self.journal.select(
            F.col("forecast_origin_date").alias("decision_date"),
            F.col("forecast_target_date").alias("entry_date"),
            "node",
            "log_moneyness",
            "T",
            F.col("observed_iv_at_origin").alias("observed_iv_at_decision"),
            "moneyness_region",
            "maturity_region",
            *[F.col(f"forecast_{m}").alias(f"forecast_{m}_h1") for m in TRADED_MODELS],
            *[f"forecast_{m}_h2" for m in TRADED_MODELS],
        )
        exits = cal.with_targets(self.calendar, (2,)).select(
            F.col("session").alias("decision_date"), F.col("target_h2").alias("intended_exit_date")
        )
        base = signals.candidates(base.join(exits, "decision_date", "left"))
        out = scoring.attach_outcomes(base, self.surface, {"entry_date": "actual_iv_entry", "intended_exit_date": "actual_iv_exit"})
        return cut(out.withColumn("actual_holding_change", F.col("actual_iv_exit") - F.col("actual_iv_entry")))

    # ------------------------------------------------------------ scoring to portfolios

    @cached_property
    def common(self) -> DataFrame:
        return self.journal.where("common_sample_4models")

    @cached_property
    def daily_losses(self) -> DataFrame:
        return cut(scoring.daily_losses(self.common))

    @cached_property
    def signals(self) -> DataFrame:
        ranked = signals.rank_signals(self.economic, self.rules)
        outcomes = self.economic.select("decision_date", "node", "actual_iv_entry", "actual_iv_exit", "actual_holding_change")
        return cut(ranked.join(outcomes, ["decision_date", "node"]))

    @cached_property
    def signal_daily(self) -> DataFrame:
        return cut(signals.signal_daily(self.signals, self.rules.min_ic_nodes))

    @cached_property
    def trades(self) -> DataFrame:
        """Selections with both a session to enter and one to exit."""
        usable = self.signals.where(F.col("intended_exit_date").isNotNull())
        return cut(mapping.assemble_trades(usable, self.market, self.calendar, self.rules))

    @cached_property
    def net(self) -> DataFrame:
        return cut(signals.net_contracts(self.trades))

    @cached_property
    def required(self) -> DataFrame:
        return cut(quotes.required_pairs(self.net))

    @cached_property
    def processed(self) -> DataFrame:
        return cut(quotes.processed_pairs(self.market, self.required))

    @cached_property
    def recovered(self) -> DataFrame:
        missing = cut(quotes.absent_pairs(self.required, self.processed))
        if self.archive:
            return cut(archive.recover(self.spark, self.archive, missing, self.rates))
        return cut(quotes.recover_raw(self.raw_quotes, missing, self.rates))

    @cached_property
    def exit_quotes(self) -> DataFrame:
        return cut(quotes.choose_quotes(self.required, self.processed, self.recovered, self.calendar))

    @cached_property
    def ready(self) -> DataFrame:
        return cut(quotes.join_trades(self.net, self.exit_quotes))

    @cached_property
    def audit(self) -> DataFrame:
        usable = self.signals.where(F.col("intended_exit_date").isNotNull())
        return cut(pnl.calendar_audit(usable, self.ready, self.calendar))

    @cached_property
    def eligible(self) -> DataFrame:
        return pnl.eligible_contracts(self.ready, self.audit)

    @cached_property
    def active(self) -> DataFrame:
        """Contracts held after netting on eligible days, with or without an exit book.
        Stored, so that the check for a missing book sees these rows and no others."""
        return cut(self.eligible.where("nonzero_net_position"))

    @cached_property
    def contracts(self) -> DataFrame:
        """Valued contracts of eligible days; one without an exit book, or with an
        improper one, is an error, so that no position can silently drop out."""
        books = N.two_sided("entry_bid", "entry_ask") & N.two_sided("exit_bid", "exit_ask")
        covered = refuse(self.active, F.col("BASE"), "a held contract of an eligible day has no exit quote")
        valued = risk.greek_quality(pnl.contract_pnl(refuse(covered, books, "a held contract has no usable entry or exit book")))
        return cut(risk.without_gaps(valued))

    @cached_property
    def daily(self) -> DataFrame:
        selection = self.audit.select("model", "entry_date", "number_selected_nodes")
        return cut(pnl.daily_pnl(self.contracts, self.eligible, selection))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return cut(pnl.signal_diagnostics(self.daily, self.signal_daily, self.signals))

    @cached_property
    def controls(self) -> DataFrame:
        return cut(risk.entry_controls(self.contracts))

    @cached_property
    def spots(self) -> DataFrame:
        """One entry and exit spot per model-day; contracts that disagree are an error here."""
        found = cut(risk.spot_by_day(self.contracts))
        return refuse(found, F.col("spot_valid"), "contracts of one day disagree on the underlying price")

    @cached_property
    def attribution(self) -> DataFrame:
        return cut(risk.attribution(self.contracts, self.spots, self.processed))

    @cached_property
    def states(self) -> DataFrame:
        return cut(risk.portfolio_states(self.contracts, self.controls, self.spots, self.daily))

    @cached_property
    def live_states(self) -> DataFrame:
        """State rows of the days on which that model's state is available."""
        return self.states.where("available")

    @cached_property
    def eligible_days(self) -> int:
        """Dates on which any model holds contracts: a complete paired panel has them all for every model."""
        return self.active.select("entry_date").distinct().count()

    @cached_property
    def performance(self) -> DataFrame:
        return cut(pnl.performance(self.states, ["model", "portfolio_state"], self.inference, with_bootstrap=self.bootstrap))

    # ------------------------------------------------------------ report tables

    def report_tables(self) -> dict[str, DataFrame]:
        """All result tables by name, lazily planned."""
        ic = scoring.daily_rank_ic(self.common, minimum=self.rules.min_ic_nodes)
        ic_summary = scoring.rank_ic_summary(ic)
        panel = stats.loss_panel(self.daily_losses, list(FORECAST_MODELS))
        comparison = scoring.comparison_table(self.journal, self.daily_losses, inference=self.inference)
        signal_summary = signals.signal_summary(self.signal_daily, self.signals, self.inference)
        exposure = risk.exposures(self.controls, self.daily)
        state_keys = ["model", "portfolio_state"]
        perf = self.performance
        multiple = robustness.multiple_testing(perf)
        even = robustness.hedge_break_even(self.live_states, self.spots)
        stress = robustness.hedge_stress(self.live_states, self.spots)
        levels = robustness.iv_levels(self.surface)
        regimes = robustness.iv_regimes(self.live_states, levels, self.splits.fit_end)
        years = self.live_states.withColumn("decision_year", F.year("decision_date"))
        chain = robustness.full_chain(comparison, ic_summary, signal_summary, perf, multiple, even)
        long = pnl.by_implementation(self.daily, ["model", "entry_date"], ("Return",))
        return {
            "data_cleaning": self.funnel,
            "iv_counts": implied_vol.inversion_counts(self.iv_quotes, self.clean),
            "iv_grid_summary": surface.surface_summary(surface.kept_nodes(self.grid_surface, self.day_stats)),
            "iv_grid_day_stats": self.day_stats,
            "forecast_model_comparison": reports.forecast_sheet(comparison, ic_summary),
            "forecast_metrics_by_region": scoring.metrics_by_region(self.common),
            "rank_ic_summary": ic_summary,
            "diebold_mariano": stats.diebold_mariano(panel, list(FORECAST_MODELS)),
            "model_confidence_set": stats.model_confidence_set(panel, list(FORECAST_MODELS), reps=self.inference.forecast_reps).unionByName(
                stats.model_confidence_set(panel, list(FORECAST_MODELS), block=self.inference.blocks[1], reps=self.inference.forecast_reps)
            ),
            "economic_signal": reports.signal_sheet(signal_summary, self.economic, self.signals),
            "candidate_counts": signals.candidate_counts(self.economic),
            "contract_collisions": signals.collisions(self.trades, self.net),
            "exit_coverage": quotes.coverage(self.ready),
            "recovery_reasons": quotes.recovery_reasons(self.exit_quotes, self.ready),
            "quote_quality": quotes.quote_quality(self.exit_quotes, self.ready),
            "exit_missingness": quotes.missingness(self.ready, self.grid),
            "economic_calendar": self.audit,
            "implementation": reports.implementation_summary(self.signals, self.trades, self.ready, self.contracts, self.audit),
            "original_performance": pnl.performance(self.daily, ["model"], self.inference, self.contracts),
            "original_bootstrap": stats.bootstrap_sensitivity(long, ["model", "implementation"], "Return", "entry_date", self.inference.blocks, reps=self.inference.reps),
            "model_return_comparison": pnl.pairwise_returns(self.daily),
            "transaction_cost_wedge": pnl.cost_wedge(self.daily),
            "quote_source_attribution": pnl.contribution(self.contracts),
            "quote_quality_sensitivity": pnl.contribution(self.contracts, quality=True),
            "signal_pnl_correlations": pnl.signal_correlations(self.diagnostics),
            "greek_quality": risk.greek_quality_summary(risk.greek_quality(self.contracts)),
            "spot_consistency": risk.spot_by_underlying(self.contracts),
            "greek_exposure_summary": risk.exposure_summary(exposure),
            "vega_balance_diagnostics": risk.balance_diagnostics(exposure),
            "pnl_attribution": risk.attribution_summary(self.attribution),
            "exact_vega_subset": risk.attribution_summary(self.attribution, subset=True),
            "state_performance": perf,
            "state_bootstrap": stats.bootstrap_sensitivity(
                pnl.by_implementation(self.live_states, [*state_keys, "entry_date"], ("Return",)),
                [*state_keys, "implementation"], "Return", "entry_date", self.inference.blocks, reps=self.inference.reps,
            ),
            "paired_bootstrap": robustness.paired_bootstrap(self.states, self.inference, self.eligible_days),
            "exposure_reduction": risk.exposure_reduction(self.states),
            "signal_alignment": risk.signal_alignment(self.states, self.diagnostics),
            "multiple_testing": multiple,
            "paired_control_effects": robustness.paired_effects(self.states, self.inference, self.eligible_days),
            "greek_component_inference": robustness.component_inference(self.attribution),
            "normalization": robustness.normalisation(self.live_states, self.daily),
            "hedge_costs": robustness.hedge_report(even, stress),
            "subperiods": robustness.stability(years, "decision_year", self.decision_years, strict=False),
            "iv_regimes": robustness.stability(self.live_states.join(regimes, "decision_date"), "IV_regime", ["LOW_IV", "HIGH_IV"], strict=False),
            "inference_sensitivity": robustness.lag_sensitivity(self.live_states),
            "full_chain": chain,
            "model_ranks": robustness.model_ranks(chain),
            "checks": self.invariants(multiple, exposure),
        }

    @cached_property
    def decision_years(self) -> list[int]:
        """All years with decisions (one row each)."""
        years = self.live_states.select(F.year("decision_date").alias("y")).distinct()
        return sorted(r["y"] for r in years.collect())

    def invariants(self, multiple: DataFrame, exposure: DataFrame) -> DataFrame:
        return checks.invariants(
            self.journal,
            self.economic,
            self.signals,
            self.trades,
            self.ready,
            self.active,
            self.contracts,
            self.attribution,
            exposure,
            self.states,
            multiple,
            lambda economic: signals.rank_signals(economic, self.rules),
        )

    def close(self) -> None:
        """Delete the stored stages of this session; results that were written elsewhere stay."""
        drop_stages(self.spark)

    def write_reports(self, folder: str) -> list[str]:
        """Write every report table as CSV; returns the table names."""
        written = []
        for name, frame in self.report_tables().items():
            tables.write_report(frame, f"{folder}/{name}")
            written.append(name)
        return written
