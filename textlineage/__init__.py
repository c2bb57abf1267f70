"""PySpark-native engine for similarity lineage over a dated document corpus."""

from textlineage.config import Settings

__all__ = ["Settings"]
