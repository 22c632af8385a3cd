import random

from slotforge.llm import decontaminate as d
from slotforge.llm.queries import op10_benchmark_decontamination

ITEM = "A farmer sells 12 apples to Mary for 3 dollars each and then buys 7 more from John at the village market on Sunday."
REWORDED = "A farmer sells 45 apples to Alice for 9 dollars each and then buys 8 more from Peter at the village market on Sunday."
JUMBLED = "We met. A farmer sells 12 apples to Mary for 12 dollars each and then buys 12 more from Mary at the village market on Sunday."


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, id string, slots string")


def test_reparameterised_and_jumbled(spark, make_docs):
    docs = make_docs([(1, f"before it. {ITEM} After it."), (2, f"Intro words here. {REWORDED} Closing."), (3, JUMBLED), (4, "nothing of the kind is said in this text at all"), (5, None), (6, ""), (None, ITEM), (1, ITEM), (7, ("filler text " * 50_000) + ITEM)])
    rows = {(r["id"], r["item_id"]): r for r in d.contaminated(docs, bench(spark, [(10, ITEM, "x", "y"), (11, None, "x", "y"), (12, "", "x", "y"), (10, ITEM, "x", "y")])).collect()}
    assert set(rows) == {(1, 10), (2, 10), (None, 10), (7, 10)}
    assert rows[1, 10]["verbatim"] and not rows[2, 10]["verbatim"]
    kept = d.without_leaks(docs, bench(spark, [(10, ITEM, "x", "y")]))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]


def test_short_items(spark, make_docs):
    docs = make_docs([(1, "so the quick brown fox jumped again"), (2, "far too short")])
    rows = d.contaminated(docs, bench(spark, [(1, "the quick brown fox jumped", "", ""), (2, "too short", "", "")])).collect()
    assert [(r["id"], r["item_id"]) for r in rows] == [(1, 1)]


def test_empty_tables(spark, make_docs):
    assert d.contaminated(make_docs([]), bench(spark, [(1, ITEM, "", "")])).count() == 0
    docs = make_docs([(1, ITEM)])
    assert d.contaminated(docs, bench(spark, [])).count() == 0 and d.without_leaks(docs, bench(spark, [])).count() == 1


def brute(texts, items):
    """Every window of canonical tokens of every text against every one of the items."""

    def windows(text):
        words = (text or "").encode().split()
        forms, start = [], True
        for w in words:
            f = d.canonical(w)
            forms.append((f[0] if start else f[1], f[2]))
            start = f[3]
        width = d.WIDTH
        for i in range(len(forms) - width + 1):
            part = forms[i : i + width]
            if sum(t not in d.PLACES for t, _ in part) >= d.PLAIN:
                yield tuple(t for t, _ in part)

    index = {}
    for i, t in items:
        for w in windows(t):
            index.setdefault(w, set()).add(i)
    return {(i, item) for i, t in texts for w in windows(t) for item in index.get(w, ())}


def test_query_equals_brute_force(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op10_benchmark_decontamination(spark, sf).collect()}
    assert got == brute(texts, items) and got


def test_planted_passages_are_found(spark, make_docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(30)]
    docs = [(i, " ".join([word() for _ in range(50)] + ([items[i // 2][1]] if i % 2 else []) + [word() for _ in range(50)])) for i in range(60)]
    got = {r["id"] for r in d.contaminated(make_docs(docs), bench(spark, [(*x, "", "") for x in items])).collect()}
    assert got == {i for i in range(60) if i % 2}


def test_items_without_plain_windows(spark, make_docs):
    """Sums, lists of names and items of a few words: a word-for-word copy is found, other numbers or names are not."""
    items = [(1, "12 + 30 = 42 and 7 * 8 = 56 and 90 / 3 = 30"), (2, "they are Anna Bert Carla Dora Emil Frida Gustav Hanna Ida"), (3, "2 cups 3 Eggs 40 grams"), (4, "Why not ?")]
    docs = make_docs([
        (1, f"see here {items[0][1]} and so on"), (2, f"we know that {items[1][1]} came"), (3, f"take {items[2][1]} now"), (4, "why not ?"), (5, "13 + 31 = 44 and 6 * 9 = 54 and 80 / 4 = 20"),
        (6, "they are Otto Paul Rosa Sven Tina Udo Vera Willi Xaver"), (7, "so why not ? he said"), (8, "take 5 cups 6 Eggs 70 grams now"),
    ])
    got = {(r["id"], r["item_id"], r["verbatim"]) for r in d.contaminated(docs, bench(spark, [(*i, "", "") for i in items])).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True)}


def test_one_of_two_equal_values_edited(spark, make_docs):
    """An edit that breaks the one-to-one slots of the whole occurrence loses neither its verbatim windows nor the consistent ones; a jumble is still none."""
    tail = " and then everybody walked slowly home along the river bank while it was getting dark over the hills and the fields"
    item = f"we saw 2 boats near the old bridge and we heard 2 dogs behind the barn{tail} at about 5 in the evening"
    docs = make_docs([(1, item.replace("2 dogs", "3 dogs")), (2, item.replace("2", "4")), (3, JUMBLED), (4, item.replace("2 boats", "5 boats").replace("2 dogs", "3 dogs"))])
    rows = {(r["id"], r["item_id"]): r for r in d.contaminated(docs, bench(spark, [(1, item, "", ""), (2, ITEM, "", "")])).collect()}
    assert set(rows) == {(1, 1), (2, 1), (4, 1)} and rows[1, 1]["verbatim"]


def test_what_counts_of_an_occurrence():
    def windows(*slots):
        return [{"item_pos": k, "pos": k + 5, "b": b.split(), "d": t.split()} for k, (b, t) in enumerate(slots)]

    assert d.counted(windows(("2", "3"), ("2 7", "3 8"), ("7", "8")), 40) == (3, 5, False)
    assert d.counted(windows(("2", "2"), ("2 2", "2 3"), ("2", "3"), ("2", "3")), 4) == (2, 7, False)
    assert d.counted(windows(("2 7", "3 3"), ("2 7", "3 3"), ("2", "2")), 3) is None
    assert d.counted(windows(*[("2 7", "3 3")] * 9, *[("2", "2")] * 6), 15) == (6, 14, True)
    assert d.counted(windows(("", ""), ("2", "2")), 40) == (2, 5, True)
