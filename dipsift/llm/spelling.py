"""Groups of spelling variants by asymmetric chunks, in DataFrame expressions.

Two words are near if one letter is inserted, deleted or replaced.  The longer word (or
either of two equally long) is cut into two disjoint chunks, its halves.  One edit leaves
one of them whole: the first then opens the other word, the last closes it, shifted by
their difference in length, so by one at most.  The other word offers its grams of these
lengths at these places, for each length a partner may have.  A half is shared by very many
words; the other half, in which the edit lies, is therefore chunked in the same way, down to
leaves of two letters (a sixteenth of words beyond 32).  A join key is all that stays
whole around one leaf, so words of one key differ in that leaf only: a key of words up to 32
letters has at most 90 ** 2 of them, however large the vocabulary.  A pair is verified by its edit
distance, and taken at the leaf of its first difference, so that it comes once.

Texts that are null, empty or without words give nothing; a null id counts as an empty one
where ids are hashed; repeated rows count as often as they occur; equal counts are
decided by code-point order; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.operators.lineage import materialise

LEAST = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_LEAVES = 16


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, damage: int = 31) -> DataFrame:
    """(word, n): words of at least ``least`` letters that occur at least twice.

    Runs of letters A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased.  A run loses one letter where
    ``damage`` divides the crc32 of ``key:run``, as wear of the text by rule (0: none does)."""
    # A shorter run gives no word, so only runs of enough letters are taken.
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    rows = rows.select("key", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if damage:
        rows = rows.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return rows.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def leaves(length: Column) -> Column:
    """Ends of the leaves of a word of ``length`` letters: halved until none has more than two."""
    count = F.least(F.lit(MOST_LEAVES), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(length, F.lit(2)) / 2.0))).cast("int"))
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.floor(k * length / count).cast("int"))


def _keys(words: DataFrame, longer: int) -> DataFrame:
    """One row for each leaf of a word of ``longer`` more letters: what stays whole around it, as this word has it."""
    size = F.length("word")
    rows = words.select("word", "n", F.posexplode(leaves(size + longer)).alias("leaf", "to"), leaves(size + longer).alias("ends"))
    begin = F.when(F.col("leaf") == 0, 0).otherwise(F.get("ends", F.col("leaf") - 1))
    rest = size + longer - F.col("to")  # letters after the leaf
    whole = F.concat(F.substring("word", F.lit(1), begin), F.lit(" "), F.substring("word", size - rest + 1, rest))
    return rows.select((size + longer).alias("size"), "leaf", F.xxhash64(whole).alias("chunks"), "to", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, once in each direction."""
    chunks = _keys(words, 0)
    grams = _keys(words, 0).unionByName(_keys(words, 1)).select("size", "leaf", "chunks", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = chunks.join(grams, ["size", "leaf", "chunks"]).where(
        # Equally long words meet in both roles.
        ((F.length("near") < F.col("size")) | (F.col("word") < F.col("near")))
        & ~F.startswith("near", F.substring("word", F.lit(1), F.col("to")))
        & (F.levenshtein("word", "near", 1) == 1))
    pairs = pairs.select("word", "n", "near", "near_n")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends, by doubling.  Counts grow
    tenfold along it, so a chain is short; every round is one join."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = 10, **limits) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is the most frequent near word, if at least ``ratio`` times as frequent; its
    root is where following forms ends."""
    words = materialise(vocabulary(docs, key, text, **limits), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    kept = form_n >= ratio * F.col("n")
    found = materialise(found.select("word", "n_near", F.when(kept, F.col("best.near")).alias("form"), F.when(kept, form_n).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
