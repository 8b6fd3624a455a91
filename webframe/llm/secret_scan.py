"""Secret scan with a random forest that removes false positives; DataFrame operations and Spark ML only.

Candidates are runs of at least twelve key-like characters with a digit among
them. Each gets features: length, character classes and transitions between
them, the share that dictionary words cover (words that the corpus itself holds
often), its path, and its neighbouring words. The forest is trained on labelled
findings; ``label_findings`` makes such labels where none are at hand, from
formats that can be told for certain, and leaves all other candidates open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import held_out, saved

LEAST = 12
VALUE = r"(?:^|[^A-Za-z0-9+/_.@\-])([A-Za-z0-9+/_.@\-]{12,}={0,2})"
KEY_WORD = r"(?i)(passw|pwd|secret|token|api.?key|access.?key|auth|credential|bearer|private)"
SAMPLE_WORD = r"(?i)(example|sample|dummy|test|placeholder|your|xxx|todo|changeme)"
SAMPLE_PATH = r"(?i)(test|spec|mock|fixture|example|sample|docs?/|\.lock$|vendor|node_modules)"
#: Labelled findings that the forest is fitted on: a bounded sample, the first of each label by a hash.
SAMPLE = 10_000
TREES, DEPTH, SEED = 20, 6, 7
#: A letter run counts as a dictionary word if at least so many documents hold it.
COMMON = 20

FEATURES = (
    "length", "digits", "uppers", "hexes", "marks", "vowels", "distinct", "transitions", "digit_runs", "covered",
    "sample_path", "path_depth", "key_near", "assigned", "sample_near", "quoted",
)


def _share(value: Column, drop: str) -> Column:
    """Share of the characters that the pattern does not match."""
    return F.length(F.regexp_replace(value, drop, "")) / F.length(value)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, path, pos, nth, value, before, word, after`` of every candidate in whole texts.

    ``pos`` is the place of the word between blanks, ``nth`` that of the value within the word.
    """
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")
    d = docs.select(F.col(key).alias("doc_id"), where.alias("path"), words.alias("words"))
    d = d.select("doc_id", "path", "words", F.posexplode("words").alias("pos", "word"))
    d = d.where((F.octet_length("word") >= LEAST) & F.col("word").rlike("[0-9]"))
    near = [F.coalesce(F.get("words", F.col("pos") + k), F.lit("")) for k in (-2, -1, 1)]
    d = d.select("doc_id", "path", "pos", "word", F.concat_ws(" ", near[0], near[1]).alias("before"), near[2].alias("after"))
    found = F.posexplode(F.regexp_extract_all("word", F.lit(VALUE), 1)).alias("nth", "value")
    return d.select("doc_id", "path", "pos", "before", "word", "after", found).where(F.col("value").rlike("[0-9]"))


def with_features(found: DataFrame, docs: DataFrame, text: str = "text", common: int = COMMON) -> DataFrame:
    """Candidates with the columns of ``FEATURES``; the dictionary is counted over all texts of *docs*."""
    found = saved(found)
    runs = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"), 1))
    parts = found.select("value", F.explode(runs).alias("run")).distinct()
    wanted = saved(parts.select("run").distinct())
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"))).alias("run"))
    known = words.join(wanted, "run").groupBy("run").count().where(F.col("count") >= common)
    covered = parts.join(known, "run").groupBy("value").agg(F.sum(F.length("run")).alias("known"))
    v = F.col("value")
    classes = F.translate(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "0123456789", "1111111111")
    collapsed = F.regexp_replace(F.regexp_replace(classes, "[^aB1]", "-"), r"(.)\1+", "$1")
    context = F.concat_ws(" ", "before", "word")
    d = found.join(saved(covered), "value", "left")
    return d.select(
        *found.columns,
        F.length(v).cast("double").alias("length"), _share(v, "[^0-9]").alias("digits"), _share(v, "[^A-Z]").alias("uppers"),
        _share(v, "[^0-9a-fA-F]").alias("hexes"), _share(v, "[A-Za-z0-9]").alias("marks"), _share(v, "[^aeiouAEIOU]").alias("vowels"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).alias("distinct"),
        ((F.length(collapsed) - 1) / F.length(v)).alias("transitions"),
        (F.length(F.regexp_replace(collapsed, "[^1]", "")) / F.length(v)).alias("digit_runs"),
        F.least(F.coalesce(F.col("known") / F.length(v), F.lit(0.0)), F.lit(1.0)).alias("covered"),
        F.col("path").rlike(SAMPLE_PATH).cast("double").alias("sample_path"),
        (F.size(F.split("path", "/")) - 1).cast("double").alias("path_depth"),
        context.rlike(KEY_WORD).cast("double").alias("key_near"),
        (F.col("word").rlike("[=:]") | F.col("before").rlike("[=:>]$")).cast("double").alias("assigned"),
        F.concat_ws(" ", context, "after").rlike(SAMPLE_WORD).cast("double").alias("sample_near"),
        F.col("word").rlike("[\"']").cast("double").alias("quoted"),
    )


def label_findings(found: DataFrame) -> DataFrame:
    """*found* with ``label``: 1 for formats that are certainly keys, 0 for ones that certainly are not, else null."""
    v, quiet = F.col("value"), ~F.concat_ws(" ", "before", "word", "after").rlike(SAMPLE_WORD)
    key = v.rlike("^AKIA[0-9A-Z]{16}$") | (F.concat_ws(" ", "before", "word").rlike(KEY_WORD) & v.rlike("^[0-9a-fA-F]{16,}$"))
    harmless = reduce(lambda a, b: a | b, [
        v.rlike(r"^[A-Za-z0-9._\-]+@[A-Za-z0-9.\-]+$"), v.rlike(r"^[0-9.\-/]+$"), v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
        F.col("word").rlike(r"^[a-z]+://"), v.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
    ])
    return found.withColumn("label", F.when(key & quiet, 1).when(harmless, 0))


def _vectors(d: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(d)


def train(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | float:
    """A forest from findings with features and ``label`` (0, 1); with labels of one kind only, that kind (0 for none)."""
    d = labelled.where(F.col("label").isin(0, 1)).select(*FEATURES, F.col("label").cast("double").alias("label"), "value", "pos")
    spread = F.xxhash64("value", "pos")
    d = saved(reduce(DataFrame.union, [d.where(F.col("label") == k).orderBy(spread).limit(sample) for k in (0.0, 1.0)]))
    kinds = [r["label"] for r in d.select("label").distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(_vectors(d))


def judge(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """*found* with ``score``, the forest's probability that it is a secret, and ``is_secret`` (from 0.5 on)."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_vectors(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per candidate: ``doc_id, path, pos, nth, value``, the context, the features, ``score, is_secret``.

    ``labelled`` are findings with features and ``label``; without it the
    certain findings of the documents that are not held out are used. Null and
    empty texts have no candidates. Repeated rows repeat their findings; null
    keys pass. Only key, text and path are read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *([] if path is None else [F.col(path).alias("path")]))
    found = saved(with_features(candidates(docs, path=None if path is None else "path"), docs))
    if labelled is None:
        labelled = label_findings(found).where(~held_out(F.col("doc_id")))
    return judge(found, train(labelled))
