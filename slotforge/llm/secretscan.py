"""Secret scan in DataFrame functions: candidates, features, and a random forest that removes false positives."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, written

#: A run of 16 or more characters of keys and encodings, with a digit in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
CONTEXT = 48  #: characters looked at on either side
#: Common words and word parts (fixed values) whose share of a candidate is its dictionary coverage.
DICTIONARY = (
    "about above access account address after again api app array auth back base because before below between black blue book build cache case change check class client "
    "clear close code color config content control copy count create data date default delete demo design device direct disable display document dummy edit element enable "
    "end error event example fake field file filter first float folder format frame from function general get global green group handler hash head height hello help home host "
    "http https icon image index info init input insert integer item java json key label large last layer layout left length level light line link list load local lock log login "
    "long main manager map master match menu message method mode model module mount name network next node none normal null number object offset option order output page panel "
    "param parent password path placeholder plugin point port post prefix private process profile project public query random range read record red remote render request reset "
    "resource response result right role root route sample save schema script search secret section select server service session setting short show size small source stack "
    "start state static status stream string style submit switch system table target task template test text the theme this time title token tool total tree trigger type unique "
    "update upload url user utils value vector version view white width window word world write xml your"
).split()
#: Pairs of letters that words of the corpus' languages are made of (fixed values).
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
ASSIGNED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|credential|auth|bearer)[\"'\]]?\s*(?:=|:|=>|\s)\s*[\"']?$"
PROVIDER = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^sk_live_|^xox[abprs]-|^AIza[0-9A-Za-z_\-]{30,}"
UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
FEATURES = [
    "length", "digit_share", "upper_share", "lower_share", "other_share", "class_changes", "pair_share", "vowel_share", "distinct_share", "entropy", "dictionary", "hex_only",
    "path_test", "path_depth", "near_key", "near_assign", "near_benign", "quoted", "aws_like",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, ordinal, finding, before, after): every candidate of every whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text.alias("text"))
    found = found.where(F.col("text").rlike(CANDIDATE)).select("id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("findings"), F.split("text", CANDIDATE, -1).alias("pieces"))
    pairs = F.arrays_zip(F.col("findings").alias("f"), F.slice("pieces", F.lit(1), F.size("findings")).alias("b"), F.slice("pieces", F.lit(2), F.size("findings")).alias("a"))
    one = found.select("id", "path", F.posexplode(pairs).alias("ordinal", "x"))
    return one.select("id", "path", F.col("ordinal").cast("long").alias("ordinal"), F.col("x.f").alias("finding"), F.right(F.col("x.b"), F.lit(CONTEXT)).alias("before"), F.left(F.col("x.a"), F.lit(CONTEXT)).alias("after"))


def features(found: DataFrame) -> DataFrame:
    """``found`` with one double column per feature."""
    text, low = F.col("finding"), F.lower("finding")
    n = F.length(text)

    def share(pattern: str, of: Column = text) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    counts = F.transform(letters, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    made = {
        "length": n,
        "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"), "lower_share": share("[a-z]"), "other_share": share("[^A-Za-z0-9]"),
        "class_changes": share(changes), "pair_share": share("(?=" + "|".join(PAIRS) + ")", low), "vowel_share": share("[aeiou]", low),
        "distinct_share": F.size(letters) / n,
        "entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
        "dictionary": (n - F.length(F.regexp_replace(low, words, ""))) / n,
        "hex_only": text.rlike("^[0-9a-fA-F]+$"),
        "path_test": F.col("path").rlike("(?i)test|example|sample|fixture|mock|demo|doc"),
        "path_depth": F.regexp_count(F.col("path"), F.lit("/")),
        "near_key": F.col("before").rlike(r"(?i)pass|pwd|secret|token|key|credential|auth|bearer"),
        "near_assign": F.col("before").rlike(r"[=:]\s*[\"']?$"),
        "near_benign": F.concat_ws(" ", "before", "after").rlike(r"(?i)uuid|sha\d|md5|hash|commit|phone|card|order|invoice|isbn|example|sample|dummy|placeholder"),
        "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "aws_like": text.rlike(PROVIDER),
    }
    return found.select("*", *[F.coalesce(made[c].cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def seed_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where nobody has judged any: ``found`` with is_secret where rules are sure, 1.0 or 0.0.

    Sure secrets: a provider's key format, or a value assigned to a password,
    token or key. Sure false positives: digits only (numbers of cards, orders,
    phones), UUIDs, and texts made of dictionary words for the most part.
    """
    text = F.col("finding")
    sure = text.rlike(PROVIDER) | F.col("before").rlike(ASSIGNED)
    false = text.rlike(r"^[0-9\-]+$") | text.rlike(UUID) | ((F.col("dictionary") > 0.6) & ~F.col("before").rlike(ASSIGNED))
    return found.withColumn("is_secret", F.when(false, 0.0).when(sure, 1.0)).where("is_secret is not null")


def fit(labelled: DataFrame, most_rows: int = 20_000, trees: int = 40, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest over at most ``most_rows`` labelled findings (those with the smallest hash); None unless both kinds occur."""
    sample = hashed_sample(labelled, most_rows, "id", "ordinal", "finding").select(*FEATURES, F.col("is_secret").cast("double").alias("label"))
    sample = sample.cache()
    try:
        if sample.select("label").distinct().limit(2).count() < 2:
            return None
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample)
        return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(vectors)
    finally:
        sample.unpersist()


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5, most_rows: int = 20_000) -> DataFrame:
    """(id, ordinal, finding, before, after, probability, secret): one row per candidate, in the order of its text.

    ``labelled`` has (id, path, ordinal, finding, before, after, is_secret) as judged by people;
    without it the sure cases of ``seed_labels`` train the forest. ``secret``
    is the verdict after false-positive removal. Without labels of both kinds
    there is no model: probability is null and every candidate stays a secret.
    Null texts have no candidates, null paths count as empty, repeated rows
    are scanned each. Columns other than the three named are not read.
    """
    found = features(written(candidates(docs, id_col, text_col, path_col), "secret-candidates"))
    model = fit(features(labelled) if labelled is not None else seed_labels(found), most_rows)
    if model is None:
        scored = found.withColumn("probability", F.lit(None).cast("double"))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(found))
        scored = scored.withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    secret = F.coalesce(F.col("probability") >= threshold, F.lit(True))
    return scored.select("id", "ordinal", "finding", "before", "after", "probability", secret.alias("secret"))
