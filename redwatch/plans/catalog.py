"""All registered queries; later modules use the SQL blocks of earlier ones."""

from . import telemetry_queries  # noqa: F401  isort: skip
from . import detection_queries  # noqa: F401  isort: skip
from . import report_queries  # noqa: F401  isort: skip
from .registry import ORACLES, QUERIES  # noqa: F401
