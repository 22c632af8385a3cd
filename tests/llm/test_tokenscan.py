import numpy as np
import pytest

from slotforge.llm import tokenscan
from slotforge.llm.common import written
from slotforge.llm.queries import op2_separator_scan

SEP = tokenscan.SEPARATOR


def brute(flat, sep):
    out, start = [], 0
    for i, t in enumerate(flat):
        if t == sep:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(flat):
        out.append((start, len(flat) - start, False))
    return [(k, *x) for k, x in enumerate(out)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_raw_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {
        "a": rng.integers(0, 4, 500), "b": np.full(9, 3), "c": np.array([], int), "d": np.array([3]), "e": np.array([1]), "f": np.concatenate([np.zeros(100, int), [3], np.ones(50, int)]), "g": np.array([3, 1, 3]),
    }
    for name, flat in files.items():
        (tmp_path / f"{name}.bin").write_bytes(flat.astype("<u2").tobytes())
    rows = tokenscan.scan(tokenscan.read_flat(spark, str(tmp_path / "*.bin"), block), separator=3).collect()
    got = {}
    for r in rows:
        got.setdefault(r["file"].rsplit("/", 1)[-1][0], []).append((r["ordinal"], r["start"], r["n_tokens"], r["closed"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(v.tolist(), 3) for k, v in files.items() if len(v)}


def test_odd_byte(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole tokens"):
        tokenscan.scan(tokenscan.read_flat(spark, str(tmp_path / "x.bin"))).collect()


def test_documents_round_trip(make_docs):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "<|endoftext|> is text here"), (4, "same id"), (5, "many words " * 20_000)]
    blocks = written(tokenscan.flat_blocks(make_docs(rows), block_tokens=50, file_tokens=500), "blocks")
    made = tokenscan.encoder(tokenscan.TOKENIZER)
    want = sorted(((i, len(made.encode_ordinary(t or ""))) for i, t in rows), key=str)
    got = tokenscan.scan(blocks).collect()
    assert sorted(((r["id"], r["n_tokens"]) for r in got), key=str) == want and all(r["closed"] for r in got)
    files = {r["file"]: b"" for r in blocks.collect()}
    for r in sorted(blocks.collect(), key=lambda r: (r["file"], r["block"])):
        files[r["file"]] += r["data"]
    texts = [t for f in files.values() for t in decoded(np.frombuffer(f, "<u2"), made)]
    assert sorted(texts) == sorted(t or "" for _, t in rows)
    assert tokenscan.scan(tokenscan.flat_blocks(make_docs([]))).count() == 0


def decoded(flat, made):
    ends = np.flatnonzero(flat == SEP)
    return [made.decode(part[:-1].tolist()) for part in np.split(flat, ends + 1)[:-1]]


def test_query(spark, sf):
    rows = op2_separator_scan(spark, sf).collect()
    made = tokenscan.encoder(tokenscan.TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(made.encode_ordinary(t or "")) for i, t in texts.items()}
