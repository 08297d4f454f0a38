"""varve: profile, score and compare layered versions of modelling tables on Spark."""

from varve.config import Thresholds

__all__ = ["Thresholds"]
