"""How many buckets, partitions and slots a key set gets."""

from __future__ import annotations

import math

#: Fixed values.
MIN_PARTITION, DENSE_SLOTS = 100_000, 4096


def num_buckets(n: int, lam: float) -> int:
    return math.ceil(n / lam)


def num_partitions(n: int, average: int) -> int:
    if average < 1:
        raise ValueError("the average partition size must be positive")
    return math.ceil(n / average)


def clamped_partition_size(n: int, average: int, least: int = MIN_PARTITION) -> int:
    """A partition size of at least ``least`` (or all keys, if fewer) and at most n."""
    return max(1, min(n, max(average, least)))


def largest_partition(average: float, partitions: int) -> int:
    """A likely bound on the fullest of ``partitions`` when keys fall at random, ``average`` each."""
    return math.floor(average + math.sqrt(2 * average * math.log(partitions))) if partitions > 0 else 0


def dense_partition_size(n: int) -> int:
    """The first average, from seven eighths of the slots up, whose fullest partition about fills its slots."""
    if n < DENSE_SLOTS:
        raise ValueError(f"dense partitioning needs at least {DENSE_SLOTS} keys")
    for average in range(3596, DENSE_SLOTS):
        if largest_partition(average, num_partitions(n, average)) + 0.5 >= DENSE_SLOTS:
            return average
    return DENSE_SLOTS - 1


def table_size(n: int, alpha: float) -> int:
    return int(n / alpha)


def kernel_bytes(n: int, m: int, buckets: int) -> int:
    """About what the search of n keys at once holds: rows and sorted copies (5 words a key), slots, pilots."""
    return n * 40 + m + buckets * 8
