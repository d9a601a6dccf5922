"""Registered queries over the benchmark tables."""

from . import quotes_cases  # noqa: F401, I001
from . import forecast_cases  # noqa: F401
from . import portfolio_cases  # noqa: F401
from . import inference_cases  # noqa: F401
from . import model_cases  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
