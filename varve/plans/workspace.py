"""Builders: from a profile to every section, with the shared stages computed once.

A ``Workspace`` holds lazy DataFrames over all tables and versions of a profile. The stages that
many sections read (scores, grid, pair metrics) are cut with ``checkpoint()`` so that no section
replans or recomputes the raw scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from varve.config import Thresholds
from varve.operators import cards, compare, drift, interpret_single, narrative, pairs, signals, single, themes
from varve.operators import interpret_compare as interpret
from varve.sources.shared import ensure_checkpoint_dir


class Workspace:
    def __init__(self, profiles: DataFrame, cfg: Thresholds = Thresholds(), cut: bool = True):
        self.source, self.cfg, self.cut = profiles, cfg, cut
        if cut:
            ensure_checkpoint_dir(profiles.sparkSession)

    def _stage(self, df: DataFrame) -> DataFrame:
        return df.checkpoint() if self.cut else df

    @cached_property
    def profiles(self) -> DataFrame:
        return self._stage(self.source)

    @cached_property
    def scored(self) -> DataFrame:
        return self._stage(single.scored(self.profiles, self.cfg))

    # single-version sections (S10 is this group of properties)
    @cached_property
    def s0(self) -> DataFrame:
        return single.dataset_readiness(self.scored)

    @cached_property
    def s1(self) -> DataFrame:
        return single.health_summary(self.scored, self.cfg)

    @cached_property
    def s2(self) -> DataFrame:
        return single.blockers(self.scored)

    @cached_property
    def s3(self) -> DataFrame:
        return single.warnings(self.scored)

    @cached_property
    def s4(self) -> DataFrame:
        return single.governance(self.scored)

    @cached_property
    def s5(self) -> DataFrame:
        return single.readiness(self.scored)

    @cached_property
    def s6(self) -> DataFrame:
        return single.target_analysis(self.scored, self.cfg)

    @cached_property
    def s7(self) -> DataFrame:
        return single.distribution_health(self.scored, self.cfg)

    @cached_property
    def s8(self) -> DataFrame:
        return single.health_scores(self.scored)

    @cached_property
    def s9(self) -> DataFrame:
        return single.action_list(self.scored)

    @cached_property
    def k1(self) -> DataFrame:
        return single.analysis_export(self.scored)

    # shared comparison stages
    @cached_property
    def grid(self) -> DataFrame:
        return self._stage(pairs.grid(self.scored))

    @cached_property
    def metrics(self) -> DataFrame:
        """Consecutive pairs with all their metrics."""
        return self._stage(drift.pair_metrics(pairs.consecutive(self.grid), self.cfg))

    @cached_property
    def baseline(self) -> DataFrame:
        return self._stage(drift.baseline_pairs(pairs.against_first(self.grid), self.cfg))

    # comparison sections (C11 is this group of properties)
    @cached_property
    def c1(self) -> DataFrame:
        return compare.pair_summary(self.metrics)

    @cached_property
    def c1_versions(self) -> DataFrame:
        return compare.version_summary(self.profiles)

    @cached_property
    def c2(self) -> DataFrame:
        return compare.schema_changes(self.metrics)

    @cached_property
    def c3(self) -> DataFrame:
        return self._stage(compare.completeness_series(self.grid))

    @cached_property
    def c3_changes(self) -> DataFrame:
        return compare.completeness_changes(self.metrics, self.cfg)

    @cached_property
    def c4_flags(self) -> DataFrame:
        return compare.drift_flags(self.metrics, self.cfg)

    @cached_property
    def c4(self) -> DataFrame:
        return self._stage(compare.distribution_drift(self.grid, self.c4_flags))

    @cached_property
    def c5_rates(self) -> DataFrame:
        return self._stage(compare.target_rates(self.grid))

    @cached_property
    def c5(self) -> DataFrame:
        return compare.target_drift(self.c5_rates, self.cfg)

    @cached_property
    def c6(self) -> DataFrame:
        return compare.quality_regression(self.grid)

    @cached_property
    def c7(self) -> DataFrame:
        return compare.readiness_change(self.grid)

    @cached_property
    def c8(self) -> DataFrame:
        return self._stage(compare.psi_worst(self.metrics))

    @cached_property
    def c8_summary(self) -> DataFrame:
        return compare.psi_summary(self.c8)

    @cached_property
    def c9(self) -> DataFrame:
        return compare.health_trend(self.grid)

    @cached_property
    def c9_dataset(self) -> DataFrame:
        return compare.dataset_trend(self.s0)

    @cached_property
    def c10(self) -> DataFrame:
        return compare.cardinality_drift(self.metrics)

    @cached_property
    def c0(self) -> DataFrame:
        return self._stage(compare.verdict(self.c5, self.c8_summary, self.c1, self.c9_dataset))

    @cached_property
    def c12(self) -> DataFrame:
        return compare.overview_matrix(self.c9, self.c3, self.c7, self.c8, self.c4, self.c10)

    # drift suite (D15 is this group together with ``metrics``)
    @cached_property
    def d11(self) -> DataFrame:
        return self._stage(drift.stability(self.metrics, self.cfg))

    @cached_property
    def d13(self) -> DataFrame:
        return drift.baseline_worst(self.baseline)

    # interpretations (I10 is this group of properties)
    @cached_property
    def i1(self) -> DataFrame:
        return interpret_single.feature_verdicts(self.scored)

    @cached_property
    def i2(self) -> DataFrame:
        return interpret_single.training_readiness(self.s1, self.s0, self.s6)

    @cached_property
    def i3(self) -> DataFrame:
        return interpret_single.preprocessing_checklist(self.i1)

    @cached_property
    def places(self) -> DataFrame:
        return pairs.column_universe(self.profiles)

    @cached_property
    def i4(self) -> DataFrame:
        return self._stage(interpret.population_shift(self.c9_dataset, self.c1, self.c4, self.places, self.d13))

    @cached_property
    def i5(self) -> DataFrame:
        return self._stage(interpret.target_stability(self.c9_dataset, self.c5_rates, self.c5, self.c3, self.c6))

    @cached_property
    def i6(self) -> DataFrame:
        return self._stage(interpret.feature_impact(self.c8, self.c3, self.c4, self.metrics))

    @cached_property
    def i7(self) -> DataFrame:
        return self._stage(interpret.model_action(self.c0, self.i5, self.i6, self.d11, self.places))

    @cached_property
    def i8(self) -> DataFrame:
        return self._stage(interpret.break_risks(self.c2, self.c10, self.metrics))

    @cached_property
    def i9(self) -> DataFrame:
        return self._stage(interpret.feed_health(self.c3, self.c6, self.c9_dataset))

    @cached_property
    def i4c(self) -> DataFrame:
        return interpret.population_refined(self.i4)

    @cached_property
    def i5c(self) -> DataFrame:
        return interpret.target_refined(self.i5)

    @cached_property
    def i6c(self) -> DataFrame:
        return interpret.feature_refined(self.i6)

    @cached_property
    def i7c(self) -> DataFrame:
        return interpret.action_refined(self.i7, self.i5c, self.i6c)

    @cached_property
    def i8c(self) -> DataFrame:
        return interpret.risks_refined(self.i8)

    @cached_property
    def i9c(self) -> DataFrame:
        return interpret.feed_refined(self.i9)

    @cached_property
    def history(self) -> DataFrame:
        return interpret.dataset_history(self.s0)

    @cached_property
    def i4b(self) -> DataFrame:
        return interpret.population_history(self.i4c, self.history, self.c9_dataset)

    @cached_property
    def i5b(self) -> DataFrame:
        return interpret.target_history(self.i5c, self.c5_rates)

    @cached_property
    def i6b(self) -> DataFrame:
        return interpret.feature_history(self.i6c, self.metrics)

    @cached_property
    def i7b(self) -> DataFrame:
        return interpret.with_history(self.i7c, self.history)

    @cached_property
    def i8b(self) -> DataFrame:
        return self.i8

    @cached_property
    def i9b(self) -> DataFrame:
        return interpret.with_history(self.i9c, self.history)

    # signals, themes, cards
    @cached_property
    def facts(self) -> DataFrame:
        return self._stage(
            signals.raw_facts(
                self.metrics, self.d11, self.baseline, self.c3, self.c4, self.c10, signals.private_columns(self.scored)
            )
        )

    @cached_property
    def signals_v1(self) -> DataFrame:
        return self._stage(signals.collect_signals(self.facts, self.c2, self.i4, cfg=self.cfg))

    @cached_property
    def signals_v2(self) -> DataFrame:
        return self._stage(signals.collect_signals(self.facts, self.c2, self.i4, composite=True, cfg=self.cfg))

    @cached_property
    def c0_issues(self) -> DataFrame:
        return compare.verdict_issues(self.c0, self.c5, self.c1)

    @cached_property
    def rules(self) -> DataFrame:
        return self._stage(
            signals.rule_signals(
                self.c0_issues, self.c0, self.i4, self.i5, self.i6, self.i7, self.i8, self.i9, self.c8
            )
        )

    @cached_property
    def themes(self) -> DataFrame:
        return self._stage(themes.themes(themes.assign_themes(self.signals_v2)))

    @cached_property
    def theme_cards(self) -> DataFrame:
        return themes.theme_cards(self.themes, self.i7)

    def decision_view(self, stage: str = "back_testing") -> DataFrame:
        """The ordered cards of every table."""
        return cards.ordered_cards(
            cards.drift_stories(self.signals_v1, stage),
            [
                cards.target_card(self.i5, self.c5, stage),
                cards.feed_card(self.i9, self.signals_v1, stage),
                cards.risk_card(self.i6, self.i7, self.i8, self.signals_v1, stage),
                cards.governance_card(self.c0, self.signals_v1, stage),
            ],
        )

    @cached_property
    def cards(self) -> DataFrame:
        return self._stage(self.decision_view())

    @cached_property
    def validated_cards(self) -> DataFrame:
        """V1."""
        return cards.validated(self.cards, self.i7, self.c0)

    @cached_property
    def narratives(self) -> DataFrame:
        return narrative.narratives(self)


def run_analysis(profiles: DataFrame, cfg: Thresholds = Thresholds(), target_col: str | None = None) -> dict[str, DataFrame]:
    """Sections of every version of every table as lazy DataFrames."""
    ws = Workspace(profiles, cfg)
    names = ["s0", "s1", "s2", "s3", "s4", "s5", "s7", "s8", "s9", "i1", "i2", "i3"]
    out = {n: getattr(ws, n) for n in names}
    out["s6"] = single.target_analysis(ws.scored, cfg, target_col)
    return out


def run_comparison(profiles: DataFrame, cfg: Thresholds = Thresholds(), stage: str = "back_testing") -> dict[str, DataFrame]:
    """Comparison, drift suite, interpretations and cards of every table."""
    ws = Workspace(profiles, cfg)
    sections = ["c0", "c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9", "c10"]
    suite = {"consecutive": ws.metrics, "baseline": ws.baseline, "fsi_velocity": ws.d11}
    tiers = [f"i{k}{tier}" for k in range(4, 10) for tier in ("", "b", "c")]
    return {
        **{n: getattr(ws, n) for n in sections},
        **suite,
        **{n: getattr(ws, n) for n in tiers},
        "signals": ws.signals_v1,
        "themes": ws.themes,
        "fallback_cards": themes.fallback_cards(ws.rules),
        "cards": cards.validated(ws.decision_view(stage), ws.i7, ws.c0),
    }
