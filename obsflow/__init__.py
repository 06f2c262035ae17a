"""Spark-native operators for tables of timestamped observations."""

from obsflow.config import Config

__all__ = ["Config"]
