"""factorframe: panel and factor analytics as PySpark DataFrame operators."""

from factorframe.session import build_session, materialize

__all__ = ["build_session", "materialize"]
