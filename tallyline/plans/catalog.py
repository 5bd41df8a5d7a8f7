"""All registered queries, family by family."""

from tallyline.plans import aggregates, club, expressions, histories, joins, learning, scans  # noqa: F401
from tallyline.plans.registry import ORACLES, QUERIES  # noqa: F401
