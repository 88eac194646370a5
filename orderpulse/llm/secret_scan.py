"""Secret scan: candidate strings, and a random forest that removes false positives.

Everything runs as SQL functions and Spark ML in the JVM. Candidates are cut from
every whole text by one pattern; the text parts between them give each
candidate's neighbours and its place. Features: length, character classes and
transitions, dictionary coverage, path shape and neighbouring words. The forest
is trained on labelled findings; by default those are a bounded sample of the
table's own findings that carry a vendor's key format or stand in an assignment
to a credential name (secret), or have the form of an address, number, date,
path or identifier (no secret).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import stage

CREDENTIAL = r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|auth)"
#: What stands before the value of a credential: its name, an assignment, perhaps a quote.
_GIVEN = CREDENTIAL.replace("(?i)(?:", "(?i:") + r"\w{0,20}[\"'`]?\s{0,3}(?:=>?|:)\s{0,3}"
#: The whole value of a credential assignment (4 characters or more of any kind: up to the closing
#: quote, or up to a blank), or a run of 12 characters or more, not inside a longer run, that has a
#: digit in it or starts like a vendor's key.
CANDIDATE = (r"(?<=[=:>\s\"'`])(?:"
             r"(?<=[=:>\s]\")(?<=" + _GIVEN + r"\")[^\"\r\n]{4,}(?=\")"
             r"|(?<=[=:>\s]')(?<=" + _GIVEN + r"')[^'\r\n]{4,}(?=')"
             r"|(?<=[=:>]\s{0,3})(?<=" + _GIVEN + r")[^\s\"'`,;<>(){}\[\]]{4,})"
             r"|(?<![A-Za-z0-9_+/.@%-])(?:(?=[A-Za-z_+/.@%-]{0,80}[0-9])|(?=AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_|AIza|eyJ))"
             r"[A-Za-z0-9_+/-][A-Za-z0-9_+/.@%-]{10,}[A-Za-z0-9_+/-]={0,2}")
#: Key formats that vendors document.
VENDOR = (r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{22,}|xox[abprs]-[\w-]{10,}"
          r"|sk_(?:live|test)_\w{16,}|AIza[\w-]{35}|glpat-[\w-]{20}|npm_\w{36}|eyJ[\w-]+\.[\w-]+\.[\w-]+)$")
ASSIGNED = CREDENTIAL + r"\w{0,20}[\"']?\s{0,3}(?:=|:|=>)\s{0,3}[\"']?$"
#: Numbers, mail and network addresses, identifiers, versions and urls, wherever they stand ...
HARMLESS = (r"(?i)^(?:[0-9][0-9 .:/-]*|[\w.+%-]+@[\w-]+\.[\w.-]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
            r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|v?[0-9]+(?:\.[0-9]+)+[\w.-]*"
            r"|[a-z]{2,8}://\S*|(?:[\w-]+\.)+[a-z]{2,8}[0-9]?)$")
#: ... and words with a number or paths where no credential is assigned.
PLAIN = r"(?i)^(?:[a-z]+[0-9]{1,4}|(?:[\w.%+-]*/)+[\w.%+-]*)$"
FEATURES = ["length", "digits", "upper", "lower", "symbols", "changes", "distinct", "hard_runs", "covered",
            "slashes", "dots", "at_sign", "scheme", "credential_near", "assigned", "quoted", "words_near"]


def findings(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, text_hash, ordinal, start, value, before, after.

    ``start`` counts characters from 0; ``before`` and ``after`` are up to 60
    characters of text on either side, not beyond the next candidate.
    """
    parts = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE)).select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("m"), F.split("text", CANDIDATE, -1).alias("p"))
    begins = F.aggregate(
        F.zip_with(F.slice("p", 1, F.size("m")), "m", lambda a, b: F.char_length(a) + F.char_length(b)),
        F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return (parts.withColumn("s", begins)
            .select("doc_id", "text_hash", "p", "s", F.posexplode("m").alias("ordinal", "value"))
            .select("doc_id", "text_hash", "ordinal",
                    (F.col("s")[F.col("ordinal")] + F.char_length(F.col("p")[F.col("ordinal")])).cast("long").alias("start"),
                    "value", F.expr("right(p[ordinal], 60)").alias("before"),
                    F.substring(F.col("p")[F.col("ordinal") + 1], 1, 60).alias("after")))


def dictionary(docs: DataFrame, words: int = 400) -> list[str]:
    """The words of 4 to 12 letters that most documents have."""
    found = docs.select(F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{4,12}\b"), 0))).alias("w"))
    top = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(words)
    return sorted(r["w"] for r in top.collect())


def _count(value: Column, pattern: str) -> Column:
    return F.char_length(value) - F.char_length(F.regexp_replace(value, pattern, ""))


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with one double column per feature, named f_..."""
    v, n = F.col("value"), F.char_length("value").cast("double")
    change = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    known = "|".join(sorted([*words, "http", "https", "www", "com", "org", "net", "mail", "example", "html",
                             "index", "image", "file", "user", "version", "data", "page"], key=lambda w: (-len(w), w)))
    near = F.lower(F.concat("before", F.lit(" ")))
    column = {
        "length": n,
        "digits": _count(v, "[0-9]") / n, "upper": _count(v, "[A-Z]") / n, "lower": _count(v, "[a-z]") / n,
        "symbols": _count(v, "[^A-Za-z0-9]") / n,
        "changes": (F.char_length(F.regexp_replace(v, change, "|")) - n) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hard_runs": _count(F.lower(v), "[bcdfghjklmnpqrstvwxz]{4,}") / n,
        "covered": _count(F.lower(v), known) / n,
        "slashes": _count(v, "/"), "dots": _count(v, r"\."), "at_sign": _count(v, "@"),
        "scheme": F.col("before").rlike(r"(?i)[a-z]{2,8}:/{0,2}$"),
        "credential_near": F.col("before").rlike(CREDENTIAL),
        "assigned": F.col("before").rlike(ASSIGNED),
        "quoted": F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"),
        "words_near": _count(near, r"\b[a-z]{2,}\b") / (F.char_length(near) + 1),
    }
    return found.select("*", *(column[f].cast("double").alias(f"f_{f}") for f in FEATURES))


def labels() -> Column:
    """1 secret, 0 harmless, null unknown, by the rules of the labelled findings."""
    v, before = F.col("value"), F.col("before")
    return (F.when(v.rlike(VENDOR), 1).when(v.rlike(HARMLESS), 0)
            .when(before.rlike(ASSIGNED) & v.rlike("[0-9]") & v.rlike("[A-Za-z]"), 1).when(v.rlike(PLAIN), 0)
            .when(before.rlike(ASSIGNED) & v.rlike("^[A-Za-z]+[.?!]?$"), 0))


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 30, depth: int = 6,
          seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (feature columns and ``label``); None without both labels.

    About ``sample`` findings of each label are used, by hash, dealt to a fixed
    number of partitions in a fixed order, so the forest does not depend on the
    cluster.
    """
    count = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not count.get(0) or not count.get(1):
        return None
    unit = F.xxhash64("value", "before", "ordinal") / F.lit(2.0**64) + 0.5
    rate = F.when(F.col("label") == 1, sample / count[1]).otherwise(sample / count[0])
    rows = labelled.where(unit < rate).withColumn("h", F.xxhash64("value", "before", "ordinal"))
    rows = stage(rows.select("h", "label", *(f"f_{f}" for f in FEATURES)), "labelled-findings")
    rows = rows.repartition(8, "h").sortWithinPartitions("h", *(f"f_{f}" for f in FEATURES))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    # a copy has no training summary, which holds the session and, once a query of it
    # was observed, cannot be sent to tasks
    return forest.fit(_vectors(rows)).copy()


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="x").transform(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings of ``docs`` (doc_id, text) with ``score`` and ``is_secret``.

    ``labelled`` may bring findings (value, before, after, ordinal, label) of its
    own. Without both kinds of label to learn from, the label rules decide alone.
    Null and empty texts have no findings; repeated rows (equal id and text) are
    scanned once; null ids are kept; an empty table gives an empty table.
    """
    found = stage(findings(docs).dropDuplicates(["doc_id", "text_hash", "ordinal"]), "findings")
    words = dictionary(docs)
    known = found.withColumn("label", labels()) if labelled is None else labelled
    model = train(features(known.where("label is not null"), words))
    if model is None:
        scored = found.withColumn("score", F.coalesce(labels().cast("double"), F.lit(0.0)))
    else:
        scored = model.transform(_vectors(features(found, words))).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select("doc_id", "text_hash", "ordinal", "start", F.char_length("value").cast("long").alias("length"),
                         F.sha2("value", 256).alias("value_sha256"), "score",
                         (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; a column ``n_chars`` follows.

    Rows without a secret stay as they are, nulls and empty texts included, and
    all columns are kept, whatever their names. Texts of any length are searched
    whole; an empty table gives an empty table.
    """
    names, chars_type = docs.columns, dict(docs.dtypes).get("n_chars")
    secret = scan(docs.select("doc_id", "text")).where("is_secret").groupBy("doc_id", "text_hash").agg(
        F.collect_set("ordinal").alias("__at"))
    secret = stage(secret.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__at"), "secrets")
    own = [c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(names)]
    docs = docs.toDF(*own)
    hit = docs.join(secret, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    values, parts = F.regexp_extract_all("text", F.lit(CANDIDATE), 0), F.split("text", CANDIDATE, -1)
    shown = F.transform(values, lambda x, i: F.when(F.array_contains(F.col("__at"), i), mark).otherwise(x))
    whole = F.array_join(F.zip_with(parts, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = F.when(F.col("__at").isNull(), F.col("text")).otherwise(whole)
    out = hit.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__at").isNull(), F.col("n_chars")).otherwise(
            F.char_length("text")).cast(chars_type))
    return out.select(*own).toDF(*names)
