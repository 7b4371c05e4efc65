"""Hyper-parameters of a model tree."""

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class TreeParams:
    # Production settings.
    min_samples_leaf: int = 4
    max_depth: int = 10
    min_std_reduction: float = 0.05
    smoothing: int = 15
    pruning_factor: float = 2.0
    pruning_method: str = "mse"
    ridge_alpha: float = 0.01
    percentiles: int = 32
    prune: bool = True

    def quantiles(self):
        """Interior percentiles as fractions, lowest first."""
        return [float(q) for q in np.linspace(0, 100, self.percentiles + 2)[1:-1] / 100]


# A node whose target or feature spread is below this is constant.
FLAT = 1e-10
