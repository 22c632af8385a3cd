import pytest

from slotforge.plans import sizing
from slotforge.plans.config import MphConfig, compact_preset


def test_dense_plan():
    for n, average, partitions in [(4096, 4022, 2), (4599, 4022, 2), (10_000, 4003, 3), (15_000, 3991, 4), (45_832, 3956, 12), (100_000, 3936, 26), (150_000, 3927, 39), (456_861, 3904, 118), (10**6, 3889, 258), (10**8, 3818, 26192)]:
        assert sizing.dense_partition_size(n) == average
        assert sizing.num_partitions(n, average) == partitions
    with pytest.raises(ValueError):
        sizing.dense_partition_size(4095)


def test_clamp_and_table_size():
    assert sizing.clamped_partition_size(50, 10) == 50
    assert sizing.clamped_partition_size(10**6, 10) == 100_000
    assert sizing.clamped_partition_size(10**6, 10**7) == 10**6
    assert sizing.table_size(1500, 0.94) == 1595


@pytest.mark.parametrize("bad", [{"alpha": 0}, {"alpha": -1}, {"alpha": 1.1}, {"lam": 0}, {"mode": "x"}, {"encoder": "R-int"}, {"mode": "dense", "encoder": "PC"}, {"bucketer": "x"}, {"hash_family": "x"}, {"on_duplicates": "x"}])
def test_config_refuses(bad):
    with pytest.raises(ValueError):
        MphConfig(**bad)


def test_preset():
    assert (compact_preset().mode, compact_preset().encoder, compact_preset().bucketer) == ("dense", "R-int", "opt")
