"""Point-in-time training data on Spark: build, audit, explain and diff."""

from .errors import ChronoweaveError, ConfigError, DuplicateError, LeakageError, SchemaError, TimezoneError, ValidationError
from .model import CSVSource, Feature, FeatureSet, Labels, ParquetSource, Source, SQLSource
from .operators.audit import audit
from .operators.build import VERSION as __version__
from .operators.build import build
from .operators.diff import diff
from .operators.explain import explain
from .operators.results import AuditReport, BuildResult, DiffResult, ExplainResult
from .store import Store


def from_dbt(*_: object, **__: object) -> None:
    """Reading dbt projects is not supported."""
    raise NotImplementedError("Reading dbt projects is not supported; declare sources and features instead.")


__all__ = [
    "AuditReport", "BuildResult", "CSVSource", "ChronoweaveError", "ConfigError", "DiffResult", "DuplicateError", "ExplainResult", "Feature", "FeatureSet",
    "Labels", "LeakageError", "ParquetSource", "SQLSource", "SchemaError", "Source", "Store", "TimezoneError", "ValidationError",
    "__version__", "audit", "build", "diff", "explain", "from_dbt",
]
