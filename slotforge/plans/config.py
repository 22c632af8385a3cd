"""Build options."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.bucketers import NAMES as BUCKETERS
from ..functions.hashing import FAMILIES
from .sizing import MIN_PARTITION

#: Encoders of one sequence per partition, and of sequences across dense partitions.
PLAIN_ENCODERS = ("C", "PC", "D", "EF", "R", "C-C", "D-D", "R-R")
DENSE_ENCODERS = ("C", "D", "R", "EF", "C-int", "D-int", "R-int")
MODES = ("single", "partitioned", "dense")


@dataclass(frozen=True)
class MphConfig:
    """mode: single (one partition), partitioned, or dense (4096 slots each, one table of free slots).

    lam: keys per bucket on average. alpha: share of slots in use (not for
    dense). seed: None draws one, and draws again after a failure, up to
    ``max_attempts``; a given seed is never changed. avg_partition_size: 0
    takes ``min_partition_size``. most_keys: what a single task may hold.
    """

    mode: str = "single"
    lam: float = 4.5
    alpha: float = 0.94
    seed: int | None = None
    bucketer: str = "skew"
    hash_family: str = "xx64x2"
    encoder: str = "C"
    minimal: bool = True
    avg_partition_size: int = 0
    min_partition_size: int = MIN_PARTITION
    max_attempts: int = 10
    max_pilot: int = 1 << 34
    on_duplicates: str = "error"
    most_keys: int = 20_000_000

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {MODES}")
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be above 0 and at most 1")
        if not self.lam > 0:
            raise ValueError("lam must be positive")
        if self.bucketer not in BUCKETERS:
            raise ValueError(f"bucketer {self.bucketer!r} is none of {BUCKETERS}")
        if self.hash_family not in FAMILIES:
            raise ValueError(f"hash family {self.hash_family!r} is none of {FAMILIES}")
        known = DENSE_ENCODERS if self.mode == "dense" else PLAIN_ENCODERS
        if self.encoder not in known:
            raise ValueError(f"encoder {self.encoder!r} is none of {known} for {self.mode} functions")
        if self.on_duplicates not in ("error", "drop"):
            raise ValueError("on_duplicates is error or drop")
        if self.avg_partition_size < 0 or self.min_partition_size < 1 or self.max_attempts < 1:
            raise ValueError("sizes and attempts must be positive")

    def but(self, **changes) -> MphConfig:
        return replace(self, **changes)


def compact_preset(**changes) -> MphConfig:
    """Dense partitions, optimal bucketing, interleaved Rice codes, minimal."""
    return MphConfig(mode="dense", bucketer="opt", encoder="R-int", lam=7.0, minimal=True).but(**changes)
