"""Registered queries; importing the modules fills the registry."""

from snippetry.checks import feature_checks, model_checks, text_checks  # noqa: F401
from snippetry.checks.registry import ORACLES, QUERIES  # noqa: F401
