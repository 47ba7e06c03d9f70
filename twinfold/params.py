"""Tuning parameters; the defaults are the documented ones."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    shingle_size: int = 5
    bands: int = 20
    rows: int = 6
    threshold: float = 0.8
    hamming: int = 3

    @property
    def permutations(self) -> int:
        return self.bands * self.rows


DEFAULT = Params()
