"""Benchmark decontamination by template windows: numbers, names and units become typed slots."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, written

WIDTH = 8  #: tokens of a window
PLAIN = 5  #: tokens of a window that must be words as they stand
VERBATIM = 6  #: neighbouring windows with equal slots that count whatever is around them: 13 tokens as they stand
SLOTS_LOG = 22  #: the filter broadcast to all tasks has 2^22 bits, whatever the benchmark's size

UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons tonne tonnes "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees metre metres meter meters".split()
)
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
PLACES = frozenset(("<num>", "<unit>", "<name>"))
_NUMBER = re.compile(r"[+$€£-]*\d[\d.,:/]*(?:%|st|nd|rd|th|[a-z]{1,3})?")
_EDGE = re.compile(r"^[^\w+$€£-]+|[^\w%]+$")


def canonical(word: bytes) -> tuple[str, str, str, bool]:
    """(what stands for the word at the start of a sentence, elsewhere, its slot value, whether a sentence ends with it)."""
    text = word.decode("utf-8", "replace")
    if text.isalpha() and text.islower() and text not in NUMBER_WORDS and text not in UNITS:  # most words
        return text, text, "", False
    core = _EDGE.sub("", text)
    low = core.lower()
    ends = text.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
    if not core:
        return text, text, "", ends
    if low in NUMBER_WORDS or _NUMBER.fullmatch(low):
        return "<num>", "<num>", low, ends
    if low in UNITS:
        return "<unit>", "<unit>", low, ends
    if core[0].isupper() and any(c.islower() for c in core[1:]):
        return low, "<name>", low, ends
    return low, low, "", ends


class _Words(dict):
    """Word -> number, with the canonical forms as arrays; forgets all beyond ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.forms: list[tuple[str, str, str, bool]] = []
        self.hashes = np.zeros((1024, 3), np.uint64)  # at the start of a sentence, elsewhere, of the word itself
        self.slots = np.zeros((1024, 2), bool)
        self.ends = np.zeros(1024, bool)

    def __missing__(self, word: bytes) -> int:
        form = canonical(word)
        self[word] = at = len(self.forms)
        if at == len(self.ends):
            self.hashes, self.slots, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.slots, self.ends))
        self.forms.append(form)
        one = xxhash.xxh64_intdigest(form[0])
        self.hashes[at] = one, one if form[1] == form[0] else xxhash.xxh64_intdigest(form[1]), xxhash.xxh64_intdigest(form[2]) if form[2] else one
        self.slots[at] = form[0] in PLACES, form[1] in PLACES
        self.ends[at] = form[3]
        return at

    def trim(self) -> None:
        if len(self) > self.most:
            self._reset()


def _windows(words: _Words, texts: list[bytes], widths: list[int], bitmap: np.ndarray | None) -> Iterator[tuple[int, int, int, int, str, list[str]]]:
    """(text, width, position, hash, template, slot values) of the windows that the bitmap may hold.

    A window with too few plain words has its words as they stand for a
    template, and so has a text of fewer words than PLAIN, as a whole.
    """
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.fromiter(map(words.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
    n = len(codes)
    if not n:
        return
    text = np.repeat(np.arange(len(split)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    later = np.ones(n, np.int64)  # 0 at the start of a sentence
    later[1:] = ~words.ends[codes[:-1]]
    later[first[sizes > 0]] = 0
    h, slot = words.hashes[codes, later], words.slots[codes, later]
    plain = np.concatenate(([0], np.cumsum(~slot)))

    def rows(starts: np.ndarray, width: int, seed: int, hashes: np.ndarray, literal: str | None) -> Iterator[tuple[int, int, int, int, str, list[str]]]:
        mixed = np.full(len(starts), np.uint64(seed))
        for j in range(width):
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed += hashes[starts + j]
            mixed ^= mixed >> np.uint64(31)
        if bitmap is not None:
            may = bitmap[(mixed >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)]
            starts, mixed = starts[may], mixed[may]
        for at, key in zip(starts.tolist(), mixed.astype(np.int64).tolist(), strict=True):
            span = range(at, at + width)
            forms = [words.forms[codes[i]] for i in span]
            template = " ".join(f[later[i]] for f, i in zip(forms, span, strict=True)) if literal is None else literal + " ".join(f[2] or f[0] for f in forms)
            yield int(text[at]), width, at - int(first[text[at]]), key, template, [f[2] for f, i in zip(forms, span, strict=True) if slot[i]]

    words_as_they_stand = words.hashes[codes, 2]
    for width in widths:
        m = n - width + 1
        if m < 1 or width < PLAIN:
            continue
        inside, enough = text[:m] == text[width - 1 :], plain[width:] - plain[:m] >= PLAIN
        yield from rows(np.flatnonzero(inside & enough), width, width, h, None)
        yield from rows(np.flatnonzero(inside & ~enough), width, width + 256, words_as_they_stand, "= ")
    for width in range(1, PLAIN):
        yield from rows(first[sizes == width], width, width + 512, words_as_they_stand, "== ")


def template_windows(rows: DataFrame, id_col: str, text_col: str, widths: list[int], bitmap: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """(id, width, pos, h, template, slots). With ``whole``, a text shorter than a width is one window."""
    schema = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("pos", pa.int64()), ("h", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string()))])
    packed = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if packed is None else np.unpackbits(packed.value).astype(bool)
        words = _Words()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in slices(as_bytes(batch.column(1)), 1 if whole else 1_000_000):
                words.trim()
                wide = [min(w, max(1, len(texts[0].split()))) for w in widths] if whole else widths
                out = [(ids[start + k], *rest) for k, *rest in _windows(words, texts, wide, bits)]
                for at in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 20_000], strict=True), schema, strict=True)], schema=schema)

    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, width int, pos long, h long, template string, slots array<string>")


def counted(windows: list[dict], item_windows: int) -> tuple[int, int, bool] | None:
    """(windows, first position, verbatim) of what counts of an occurrence, whose windows come in the item's order; None: nothing."""
    same = [w["b"] == w["d"] for w in windows]
    pairs = [set(zip(w["b"], w["d"], strict=True)) for w in windows]
    held: Counter[tuple[str, str]] = Counter()
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    best, left = (0, 0), 0
    for right, own in enumerate(pairs):
        if len({b for b, _ in own}) < len(own) or len({d for _, d in own}) < len(own):  # jumbled in itself
            held.clear(), there.clear(), back.clear()
            left = right + 1
            continue
        while any(there.get(b, d) != d or back.get(d, b) != b for b, d in own):
            for b, d in pairs[left]:
                held[b, d] -= 1
                if not held[b, d]:
                    del there[b], back[d]
            left += 1
        for b, d in own:
            held[b, d] += 1
            there[b], back[d] = d, b
        if right + 1 - left > best[1] - best[0]:
            best = left, right + 1
    verbatim, start = (0, 0), 0
    for at, equal in enumerate(same):
        if not equal:
            start = at + 1
        elif at > start and windows[at]["item_pos"] > windows[at - 1]["item_pos"] + 1:
            start = at
        if at + 1 - start > verbatim[1] - verbatim[0]:
            verbatim = start, at + 1
    long = verbatim[1] - verbatim[0] >= VERBATIM
    if all(same):
        best = 0, len(windows)
    elif best[1] - best[0] < min(len(windows), item_windows / 2):
        if not long:
            return None
        best = verbatim
    run = windows[best[0] : best[1]]
    return len({w["item_pos"] for w in run}), min(w["pos"] for w in run), long or all(same)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_windows: int = 1) -> DataFrame:
    """(id, item_id, n_windows, item_windows, verbatim, first_pos): a row for each document and item that meet.

    Windows of WIDTH canonical tokens (an item with fewer: all of it) are
    hash-joined, then compared in full. A window with fewer plain words than
    PLAIN must meet its own words, numbers and names; an item of fewer words
    than PLAIN only meets a document of just these. Windows on one diagonal
    (position in the document less that in the item) are one occurrence. Of
    it counts the longest run of windows whose slots map one to one between
    item and document if that is all of them or half of the item's windows or
    more, so another set of numbers or names still matches and a jumbled one
    does not; failing that, the longest run of VERBATIM or more neighbouring windows with equal slots.
    Verbatim: some occurrence has such a run, or only the item's own slot values.

    Null texts have no windows; null ids stay as they are; repeated rows add
    nothing; an empty benchmark gives no rows.
    """
    items = written(template_windows(benchmark, item_id_col, item_text_col, [WIDTH], whole=True).distinct(), "template-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # 1..WIDTH at most
    sizes = items.groupBy("id").agg(F.count("*").alias("item_windows")).withColumnRenamed("id", "item_id")
    slots = items.select(F.shiftrightunsigned("h", 64 - SLOTS_LOG).alias("s")).distinct().toArrow().column("s").to_numpy()  # 2^22 at most
    bitmap = np.zeros(1 << SLOTS_LOG, bool)
    bitmap[slots] = True
    found = template_windows(docs, id_col, text_col, widths, bitmap)
    item = items.select("h", "template", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    window = F.struct("item_pos", "pos", F.col("item_slots").alias("b"), F.col("slots").alias("d"))
    met = found.join(item, ["h", "template"]).select("id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), window.alias("window"))
    runs = met.groupBy("id", "item_id", "diagonal").agg(F.sort_array(F.collect_set("window")).alias("windows")).join(sizes, "item_id").select("id", "item_id", "windows", "item_windows")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [(i, item, *found) for i, item, *seen in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (found := counted(*seen))]
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*good, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["id", "item_id", "n", "first_pos", "same"])

    good = runs.mapInArrow(judge, "id long, item_id long, n long, first_pos long, same boolean")
    pairs = good.groupBy("id", "item_id").agg(F.max("n").alias("n_windows"), F.max("same").alias("verbatim"), F.min("first_pos").alias("first_pos"))
    return pairs.join(sizes, "item_id").where(F.col("n_windows") >= F.least(F.lit(min_windows), "item_windows")).select("id", "item_id", "n_windows", "item_windows", "verbatim", "first_pos")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that meet no benchmark item, with all their columns."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("__sf_bad")).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__sf_bad")), "left_anti")
