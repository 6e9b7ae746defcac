"""All registered queries."""

from . import (build_plans, curate_plans, evaluate_plans, fit_plans, grid_plans, harvest_plans, labels_plans, prepare_plans, scene_plans,  # noqa: F401
               sampling_plans, source_plans, spectral_plans)
from .registry import ORACLES, QUERIES  # noqa: F401
