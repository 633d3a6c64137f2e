"""Named query plans; importing this package registers all of them."""

from . import q_explore, q_forecast, q_models, q_series, q_sources  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
