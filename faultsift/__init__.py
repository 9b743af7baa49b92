"""faultsift: error-event triage analytics as PySpark DataFrame jobs."""

from faultsift.contracts import DEFAULTS, Params
from faultsift.session import build_session, prepare_session

__all__ = ["DEFAULTS", "Params", "build_session", "prepare_session"]
