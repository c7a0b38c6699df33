"""All checks, registered by importing them."""

from checks import ingest, rollups, sentiment, text, topics  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
