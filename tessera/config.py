"""One frozen configuration; variants by ``dataclasses.replace``."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Config:
    seed: int = 42
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    folds: int = 5
    augmented: str = "auto"
    augmented_threshold: int = 100
    duplicate_bits: int = 5
    min_side: int = 32
    min_blur: float = 100.0
    ece_bins: int = 10
    alpha: float = 0.10
    min_calibration: int = 10
    arm_margin: float = 0.005
    max_pca: int = 32

    def experiment_id(self, backbone: str) -> str:
        """Backbone and 16 hex digits of the sorted fields' SHA-256."""
        fields = json.dumps(asdict(self) | {"backbone": backbone}, sort_keys=True)
        return f"{backbone}_{hashlib.sha256(fields.encode()).hexdigest()[:16]}"


REGISTRIES = {
    "backbone": {"precomputed"},
    "classifier": {"random_forest", "logistic_regression", "gradient_boosting", "linear_svm", "centroid"},
    "selector": {"none", "importance", "rfe", "ga", "bda"},
    "mode": {"standard", "conditional"},
}


def check_domain(**choice: str) -> None:
    """Raise for a component that no registry knows."""
    for kind, name in choice.items():
        if name not in REGISTRIES[kind]:
            raise ValueError(f"unknown {kind} {name!r}; known: {sorted(REGISTRIES[kind])}")
