"""Secret scans: candidate strings scored by a random forest, in DataFrame operations.

Candidates are what is assigned to a key word, of any length, and all other runs of TOKEN or more key characters. Their features
are length, transitions between kinds of characters, coverage by dictionary words, how path-like they are and what path they come
from, and the words beside them. The forest is trained by Spark on labelled findings and sorts false positives out; no format is
taken for a secret or for harmless by itself. Without other findings, those of findings.labelled() are taken.

Texts that are null or empty have no candidates. Repeated rows give their candidates again, ids may be null or repeated, and columns
of any name may stand beside doc_id, text and the path. An empty table has no candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm import findings as fixture
from ledgersift.llm.common import pack, store, unpack

#: Words that name a secret beside it.
KEY_WORDS = "pass|passwd|password|pwd|secret|token|key|apikey|api_key|auth|credential|bearer"
#: Least length of a candidate that nothing is assigned to.
TOKEN = 16
_CHAR = "[A-Za-z0-9_./+@-]"
#: A value behind a key word and a sign (or behind "bearer"), or a long run of key characters. What is quickest to rule out is looked for first.
CANDIDATE = (
    rf"(?<=[=:\s\"'])(?:(?<=[=:]\s{{0,3}}[\"']?)(?<=(?i:{KEY_WORDS})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)|(?<=[rR] )(?<=(?i:bearer) ))[^\s\"'`,;=:][^\s\"'`,;]*+"
    rf"|(?<!{_CHAR}){_CHAR}{{{TOKEN},}}+={{0,2}}"
)
#: Training findings and dictionary words are bounded; the words are the commonest around all candidates.
SAMPLE_ROWS, DICTIONARY_WORDS, TREES, DEPTH = 20_000, 200, 30, 8
#: Characters of context on either side. The features ask for what touches the value: a sign, a quote and the one key word before them.
CONTEXT = 48
FEATURES = (
    "f_length", "f_digit", "f_upper", "f_lower", "f_hex", "f_symbol", "f_distinct", "f_letter_digit", "f_digit_letter", "f_case", "f_dictionary", "f_path", "f_slashes", "f_at", "f_assigned", "f_key_word", "f_quoted", "f_longest_run", "f_entropy", "f_sum_word", "f_mixed",
)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, start (code points from 0), value, before, after of all candidates."""
    base = docs.select("doc_id", F.col(path).cast("string").alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split("text", CANDIDATE, -1).alias("_parts"))
    base = base.filter(F.size("_found") > 0)
    # starts are running sums of lengths; sums over 1, 2, 4, ... neighbours at once, so a text with many candidates costs little more a candidate
    lengths = F.transform("_found", lambda _, i: F.length(F.get("_parts", i)) + F.coalesce(F.length(F.get("_found", i - 1)), F.lit(0)))

    def double(sums: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2), k).cast("int")
        return F.when(reach < F.size(sums), F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - reach), F.lit(0)))).otherwise(sums)

    starts = F.aggregate(F.sequence(F.lit(0), F.lit(30)), lengths, double)
    beside = F.transform("_parts", lambda x: F.struct(F.left(x, F.lit(CONTEXT)).alias("l"), F.right(x, F.lit(CONTEXT)).alias("r")))
    ready = base.select("doc_id", "path", "_found", starts.alias("_starts"), beside.alias("_beside"))
    rows = F.transform("_found", lambda v, i: F.struct(F.get("_starts", i).alias("start"), v.alias("value"), F.get("_beside", i)["r"].alias("before"), F.get("_beside", i + 1)["l"].alias("after")))
    return ready.select("doc_id", "path", F.inline(rows))


def dictionary(found: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The commonest words of 3 or more ASCII letters around candidates."""
    near = found.select(F.explode(F.split(F.lower(F.concat_ws(" ", "before", "after")), "[^a-z]+")).alias("w")).filter(F.length("w") >= 3)
    return [r["w"] for r in near.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()]


def features(found: DataFrame, words: list[str]) -> DataFrame:
    v, n = F.col("value"), F.length("value").cast("double")
    many = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    listed = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    value = {
        "f_length": n,
        "f_digit": many("[0-9]") / n,
        "f_upper": many("[A-Z]") / n,
        "f_lower": many("[a-z]") / n,
        "f_hex": many("[0-9a-f]") / n,
        "f_symbol": many("[^A-Za-z0-9]") / n,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "f_letter_digit": many("[A-Za-z](?=[0-9])") / n,
        "f_digit_letter": many("[0-9](?=[A-Za-z])") / n,
        "f_case": many("[a-z](?=[A-Z])") / n,
        "f_dictionary": (n - F.length(F.regexp_replace(F.lower(v), listed, ""))) / n,
        "f_path": F.coalesce(F.col("path"), F.lit("")).rlike("(?i)test|example|sample|doc|fixture").cast("double"),
        "f_slashes": many("[/.]"),
        "f_at": many("@"),
        "f_assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "f_key_word": F.lower("before").rlike(rf"({KEY_WORDS})\W*$").cast("double"),
        "f_sum_word": F.lower("before").rlike(r"(commit|revision|sha1|sha256|md5|checksum|digest|hash|etag|id|order|invoice|version)\W*$").cast("double"),
        "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "f_longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "f_entropy": entropy(v),
        "f_mixed": (v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")).cast("double"),
    }
    return found.withColumns({k: F.coalesce(x, F.lit(0.0)) for k, x in value.items()})


def entropy(v: Column) -> Column:
    """Bits a character."""
    n = F.length(v).cast("double")
    share = lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n
    return F.aggregate(F.filter(F.array_distinct(F.split(v, "")), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def train(findings: DataFrame, words: list[str], rows: int = SAMPLE_ROWS) -> RandomForestClassificationModel | None:
    """Fit on at most ``rows`` findings (columns of candidates() and a double label), chosen by a hash; None without findings."""
    sample = findings.filter(F.col("label").isNotNull()).orderBy(F.xxhash64("doc_id", "start", "value"), "doc_id", "start", "value", "label").limit(rows)
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(features(sample, words)).select("_x", "label").cache()
    try:
        if x.isEmpty():
            return None
        return RandomForestClassifier(featuresCol="_x", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_best", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(x)
    finally:
        x.unpersist()


def score(found: DataFrame, words: list[str], model: RandomForestClassificationModel | None) -> DataFrame:
    """Columns of candidates() and score, the share of secrets (0 where there is no model or it knows no secrets)."""
    if model is None or model.numClasses < 2:
        return found.withColumn("score", F.lit(0.0))
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(features(found, words))
    return model.transform(x).withColumn("score", F.get(vector_to_array("_p"), F.lit(1))).drop("_x", "_raw", "_p", "_best", *FEATURES)


def scan(docs: DataFrame, path: str = "source", findings: DataFrame | None = None) -> DataFrame:
    """All candidates with scores, the forest trained on labelled findings (columns of candidates() and label)."""
    found = store(candidates(docs, path))  # a small part of the texts, and read twice
    words = dictionary(found)
    return score(found, words, train(fixture.labelled(docs.sparkSession).filter("NOT held_out") if findings is None else findings, words))


def redact(docs: DataFrame, scored: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with the found secrets' characters replaced by asterisks; doc_id must be unique, rows with a null one stay as they are."""
    hits = scored.filter(F.col("score") >= least).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", F.length("value").alias("n")))).alias("spans"))
    both = pack(docs).join(hits, F.col("_row.doc_id") == F.col("doc_id"), "left")
    cover = F.aggregate("spans", F.col("_row.text"), lambda t, s: F.overlay(t, F.repeat(F.lit("*"), s["n"]), s["start"] + 1, s["n"]))
    return unpack(both, docs, text=F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(cover))
