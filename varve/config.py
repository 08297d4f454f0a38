"""Tunable thresholds. Every builder takes a ``Thresholds`` and turns its values into literals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Thresholds:
    blocker_completeness: float = 50.0
    blocker_mismatch_rate: float = 0.15
    skew_symmetric: float = 0.5
    leakage_cardinality: int = 50
    imbalance_notable: float = 1.5
    imbalance_severe: float = 4.0
    drift_notable: float = 0.20
    drift_severe: float = 0.50
    completeness_delta_min: float = 5.0
    target_drift_notable: float = 0.03
    target_drift_critical: float = 0.08
    psi_stable: float = 0.10
    psi_monitor: float = 0.25
    w_completeness: float = 0.35
    w_variance: float = 0.20
    w_mismatch: float = 0.20
    w_governance: float = 0.15
    w_distribution: float = 0.10

    @classmethod
    def from_mapping(cls, values: dict) -> "Thresholds":
        """Build from loose values: blanks and junk fall back, weights and orderings are repaired."""
        base = cls()
        parsed = {}
        for f in fields(cls):
            default = getattr(base, f.name)
            try:
                number = float(str(values.get(f.name, "")).strip())
            except ValueError:
                number = default
            parsed[f.name] = int(number) if isinstance(default, int) else number
        return cls(**parsed).repaired()

    def repaired(self) -> "Thresholds":
        weights = [f.name for f in fields(self) if f.name.startswith("w_")]
        total = sum(getattr(self, w) for w in weights)
        scaled = (
            {w: getattr(self, w) / total for w in weights}
            if total > 0 and abs(total - 1.0) > 0.01
            else {}
        )
        return replace(
            self,
            psi_stable=min(self.psi_stable, self.psi_monitor - 0.01),
            drift_notable=min(self.drift_notable, self.drift_severe - 0.01),
            target_drift_notable=min(self.target_drift_notable, self.target_drift_critical - 0.001),
            imbalance_notable=min(self.imbalance_notable, self.imbalance_severe - 0.1),
            **scaled,
        )

    @property
    def is_default(self) -> bool:
        return self == Thresholds()
