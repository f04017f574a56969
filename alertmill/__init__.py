"""Log alerting and lookup as Spark DataFrame operators."""

from alertmill.session import build_session, prepare

__all__ = ["build_session", "prepare"]
