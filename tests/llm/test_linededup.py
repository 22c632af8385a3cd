import hashlib
import random

from slotforge.llm.linededup import CuckooFilter, LineStore, digest
from slotforge.llm.queries import op4_line_dedup

LONG = "this line is certainly longer than forty code points"


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    hot = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in hot and hot[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def result(store, docs):
    return sorted(((r["doc_id"], r["__sf_lines"], r["__sf_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in store.apply(docs).collect()), key=str)


ROWS = (
    [(i, f"{LONG}\nown line of document number {i} that is long enough to count\n  {LONG.upper()} \r\nshort") for i in range(1, 9)]
    + [(20, None), (21, ""), (22, "\n\n"), (7, f"{LONG}\nagain the same id in another row"), (None, LONG), (30, f"é{LONG}\n\x85{LONG}"), (31, ("z" * 39 + "\n") * 3)]
    + [(40 + i, "é" * 40 + "\nx") for i in range(5)] + [(50 + i, "é" * 39) for i in range(5)]
    + [(60, "\n".join([LONG] * 30_000))]
)


def test_equals_brute_force(make_docs):
    docs = make_docs(ROWS)
    assert result(LineStore.build(docs), docs) == brute(ROWS)


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, op4_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == brute(rows)


def test_insert_and_delete_are_reversible(make_docs, spark):
    first, more = [r for r in ROWS if r[0] is None or r[0] < 30], [r for r in ROWS if r[0] is not None and r[0] >= 30]
    docs, extra = make_docs(first), make_docs(more)
    store = LineStore.build(docs)
    grown = store.insert(extra)
    assert result(grown, make_docs(ROWS)) == brute(ROWS)
    shrunk = grown.delete(extra.select("doc_id"))
    assert result(shrunk, docs) == result(store, docs) == brute(first)
    gone = spark.createDataFrame([(i,) for i in range(3, 9)], "i long")
    left = [r for r in ROWS if r[0] is None or not 3 <= r[0] <= 8]
    assert result(grown.delete(gone), make_docs(left)) == brute(left)


def test_empty(make_docs):
    docs = make_docs([])
    assert LineStore.build(docs).apply(docs).count() == 0


def test_filter():
    rng = random.Random(3)
    keys = [digest(str(rng.random()).encode()) for _ in range(5000)]
    f = CuckooFilter.of(keys)
    assert f.holds(keys).all()
    others = [digest(b"o%d" % i) for i in range(20_000)]
    assert f.holds(others).mean() < 0.01
    for k in keys[:2500]:
        assert f.remove(k)
    assert CuckooFilter.loads(f.dumps()).holds(keys[2500:]).all()
    assert f.holds(keys[:2500]).mean() < 0.01
