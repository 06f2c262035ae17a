"""Shared hyperparameters of a run."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Settings that several operators share; operator-specific ones are keyword arguments."""

    # Fixed default values, equal to the published settings of the method.
    seed: int = 42
    iqr_multiplier: float = 1.5
    z_threshold: float = 3.0
    contamination: float = 0.02
    test_window_days: int = 30
    val_size: int = 30
    max_cardinality: int = 50

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Defaults overridden by ``values``; a key that is no setting is an error."""
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown config keys: {unknown}")
        return cls(**values)
