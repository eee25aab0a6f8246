"""Secret scan with a random forest that removes false positives, in DataFrame
expressions only.

Candidates are long runs of key characters with a digit.  Findings whose
surroundings settle the matter are labelled (an assignment to a word for a
secret, a known key prefix; or a number, a date, an address, an identifier named as such),
a forest learns from them on length, character transitions, dictionary
coverage, path and neighbouring words, and then scores all candidates.

Null and empty texts have no findings.  Repeated rows are findings each by
itself.  Without labelled findings of both kinds, those labelled secret are reported with
score 1.  Empty tables give an empty result; extra columns are ignored."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.llm.common import weighted_sample
from dipsift.llm.pii import spans_of
from dipsift.operators.lineage import materialise

_KEY = "[A-Za-z0-9+/_=-]"
#: Runs of at least 16 key characters, one of them a digit; looked at from the start of a run only, so in linear time.
CANDIDATE = rf"(?<!{_KEY})(?=[A-Za-z+/_=-]*+[0-9]){_KEY}{{16,}}+"
# Words that name a secret, words that name an identifier, common key prefixes, a small dictionary.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential")
OTHER_WORDS = ("sha1", "sha256", "md5", "checksum", "commit", "digest", "hash", "uuid", "guid", "isbn", "id", "ref", "etag", "build", "version", "order")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "npm_", "eyJ")
DICTIONARY = ("the", "and", "ing", "ion", "ent", "ter", "est", "der", "ver", "ein", "sch", "ung", "con", "que", "los", "las", "est", "ment", "page", "item",
              "user", "name", "data", "file", "test", "index", "image", "html", "http", "www", "com", "example")
FEATURES = ("length", "transitions", "digit_share", "upper_share", "hex_only", "distinct_share", "coverage", "quoted", "assigned", "secret_word", "other_word",
            "known_prefix", "digits_only", "path_depth", "path_code", "path_digits", "separators", "longest_letters")


def _share(text: Column, but: str) -> Column:
    return F.length(F.regexp_replace(text, but, "")) / F.greatest(F.length(text), F.lit(1))


def _word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(rf"(?i)(?:{'|'.join(words)})[\"']?\s*(?:[=:]|=>|is)?\s*[\"']?$")


def candidates(text: Column) -> Column:
    """Array of (start, end, hit, before, after): code points, end exclusive; up to 32 characters before, one after."""
    return spans_of(text, CANDIDATE, F.coalesce(text.rlike(CANDIDATE), F.lit(False)), lambda hit, start, end, before, after: F.struct(
        start.alias("start"), end.alias("end"), hit.alias("hit"), before.alias("before"), after.alias("after")), left=32)


def described(found: DataFrame) -> DataFrame:
    """Append the features to rows with hit, before, after and path, and the label of settled findings."""
    hit, before, after, path = F.col("hit"), F.col("before"), F.col("after"), F.coalesce(F.col("path"), F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[+/_=-]+", "_")
    made = {
        "length": F.length(hit), "transitions": F.length(shape) / F.length(hit), "digit_share": _share(hit, "[^0-9]"), "upper_share": _share(hit, "[^A-Z]"),
        "hex_only": hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "distinct_share": F.size(F.array_distinct(F.split(hit, ""))) / F.length(hit),
        "coverage": 1 - _share(hit, f"(?i){'|'.join(sorted(DICTIONARY, key=len, reverse=True))}"),
        "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), "assigned": before.rlike("[=:]\\s*[\"'`]?$"),
        "secret_word": _word(before, SECRET_WORDS), "other_word": _word(before, OTHER_WORDS),
        "known_prefix": hit.rlike("^(?:" + "|".join(PREFIXES) + ")"), "digits_only": hit.rlike("^[0-9_+/=-]+$"),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"))), "path_code": path.rlike(r"\.(?:py|js|ts|go|java|rb|env|ya?ml|json|toml|cfg|ini)$"),
        "path_digits": _share(path, "[^0-9]"), "separators": _share(hit, "[^+/_=-]"),
        "longest_letters": F.array_max(F.transform(F.split(hit, "[^A-Za-z]+"), lambda x: F.length(x))),
    }
    rows = found.withColumns({k: v.cast("double") for k, v in made.items()})
    sure = (F.col("secret_word") == 1) & (F.col("assigned") == 1) & (F.col("digits_only") == 0) | (F.col("known_prefix") == 1)
    never = ((F.col("digits_only") == 1) | (F.col("other_word") == 1) | hit.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
             | hit.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") | (F.col("coverage") > 0.6) | (F.col("longest_letters") > 0.8 * F.col("length")))
    return rows.withColumn("label", F.when(sure, 1.0).when(never & (F.col("secret_word") == 0), 0.0))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = 0.5, per_label: int = 5000,
             trees: int = 40, depth: int = 6) -> DataFrame:
    """(key, start, end, score): the candidates that the forest takes for secrets.

    The forest is fitted on about ``per_label`` labelled findings of each kind (a bounded sample;
    the bound is this parameter), alike ones as one row with a weight; all candidates are scored."""
    found = docs.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.explode(candidates(F.col(text))).alias("c")).select("key", "path", "c.*")
    rows = described(materialise(found, "secret-candidates"))
    sample = weighted_sample(rows, list(FEATURES), "label", per_label).coalesce(4)
    columns = [F.col("key").alias(key), "start", "end"]
    if sample.select("label").distinct().count() < 2:
        return rows.where("label = 1").select(*columns, F.lit(1.0).alias("score"))
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=7).fit(gather.transform(sample))
    scored = model.transform(gather.transform(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.where(F.col("score") >= threshold).select(*columns, "score")
