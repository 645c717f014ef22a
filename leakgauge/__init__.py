"""DNS-exfiltration analytics written as Spark DataFrame, MLlib and streaming jobs."""

from leakgauge.session import build_session

__all__ = ["build_session"]
