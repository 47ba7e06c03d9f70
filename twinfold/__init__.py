"""Near-duplicate clustering of articles as Spark jobs."""

from twinfold.params import Params

__all__ = ["Params"]
