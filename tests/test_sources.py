import json

import pytest
from pyspark.sql import functions as F

from slotforge.operators.build import build
from slotforge.plans import report
from slotforge.plans.bench import measure, write_records
from slotforge.plans.config import MphConfig
from slotforge.sources import keys as K
from slotforge.streaming.lookup import stream_lookup


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\nthree\n")
    lines = K.read_lines(spark, str(tmp_path / "a.txt"))
    row = K.line_stats(lines).first()
    assert (row["n"], row["longest"], row["total"], row["blank"]) == (3, 5, 8, 1)
    (tmp_path / "b.txt").write_text("\n\nx\n")
    with pytest.raises(ValueError):
        K.read_lines(spark, str(tmp_path / "b.txt"))


def test_generators(spark):
    assert K.random_longs(spark, 5000, 1).distinct().count() == 5000
    strings = K.random_strings(spark, 5000, 1)
    row = strings.agg(F.count_distinct("key"), F.min(F.length("key")), F.max(F.length("key"))).first()
    assert row[0] == 5000 and row[1] >= 10 and row[2] <= 49


def test_iterator_and_cache(spark, tmp_path):
    got = K.from_iterator(spark, (str(i) for i in range(25)), str(tmp_path / "it"), rows=10)
    assert sorted(int(r[0]) for r in got.collect()) == list(range(25))
    calls = []

    def make(s, n, seed):
        calls.append(1)
        return K.random_longs(s, n, seed)

    assert K.cached(spark, str(tmp_path / "c"), make, 10, 1).count() == K.cached(spark, str(tmp_path / "c"), make, 10, 1).count() == 10
    assert len(calls) == 1


def test_records(spark, tmp_path):
    records = measure(K.random_longs(spark, 300, 1), ["key"], MphConfig(seed=1), ["C", "EF"], runs=1, verify=True)
    write_records(spark, records, str(tmp_path / "r"))
    back = K.read_records(spark, str(tmp_path / "r"))
    assert back.count() == 2 and back.first()["n"] == 300
    assert report.averages(report.filled_alpha(back), "space").count() == 2
    assert report.averages(back, "build").count() == 1
    json.dumps(records)


def test_stream(spark, tmp_path):
    keys = spark.range(200)
    model = build(keys, "id", MphConfig(seed=1))
    keys.write.parquet(str(tmp_path / "in"))
    stream = stream_lookup(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), model)
    query = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["pos"] for r in spark.sql("SELECT pos FROM found").collect()) == list(range(200))


def test_command_line(spark, tmp_path, capsys):
    from slotforge import cli
    from slotforge.sources.model_io import load

    (tmp_path / "keys.txt").write_text("".join(f"key number {i}\n" for i in range(300)))
    records = cli.main(["-i", str(tmp_path / "keys.txt"), "-s", "1", "-e", "all", "--check", "-o", str(tmp_path / "f")])
    assert [r["encoder_type"] for r in records] == ["C", "PC", "D", "EF", "R", "C-C", "D-D", "R-R"]
    assert len(capsys.readouterr().out.strip().splitlines()) == 8
    keys = K.read_lines(spark, str(tmp_path / "keys.txt"))
    assert load(spark, str(tmp_path / "f")).check(keys).first()["ok"]


def test_new_seeds_until_one_works(spark, monkeypatch):
    from slotforge.operators import build as B

    tried = []

    def seeds(bits):
        tried.append(bits)
        return len(tried)

    monkeypatch.setattr(B.random, "getrandbits", seeds)
    real = B.kernel

    def failing(*a):
        run = real(*a)
        bad = len(tried) < 3

        def once(group):
            out = run(group)
            if bad:
                import pyarrow as pa

                out = out.set_column(out.schema.get_field_index("problem"), "problem", pa.array(["pilot"] * out.num_rows, pa.string()))
            return out

        return once

    monkeypatch.setattr(B, "kernel", failing)
    model = build(spark.range(200), "id", MphConfig(max_attempts=5))
    assert len(tried) == 3 and model.seed == 3
    with pytest.raises(B.BuildError):
        tried.clear()
        build(spark.range(200), "id", MphConfig(max_attempts=2))
