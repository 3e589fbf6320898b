"""Numeric functions: distributions, conditional-independence tests and scores, with registries."""

from .citests import CI_TESTS, register_ci_test
from .scores import SCORES, register_score

__all__ = ["CI_TESTS", "SCORES", "register_ci_test", "register_score"]
