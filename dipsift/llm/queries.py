"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dipsift.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
entries AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM entries GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM entries a JOIN entries b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
lowest AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m, d.doc_id) AS BIGINT) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark, sf_dir):
    from dipsift.llm.jaccard_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    from dipsift.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_language_id")
def op10(spark, sf_dir):
    from pyspark.sql import functions as F

    from dipsift.llm.common import crc_bucket
    from dipsift.llm.langid import fit, predict
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_bucket(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held & F.col("lang").isNotNull()))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


@query("op2_token_files")
def op2(spark, sf_dir):
    import uuid

    import public_tokenizers

    from dipsift.llm import token_files
    from dipsift.operators.lineage import scratch_dir
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(files, with_ids=False)


@query("op3_personal_data")
def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    from dipsift.llm import pii
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op4_quality_score")
def op4(spark, sf_dir):
    from pyspark.sql import functions as F

    from dipsift.llm import quality
    from dipsift.llm.common import crc_bucket
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels.where(crc_bucket(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 5) == 0), machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_sequence_packing")
def op5(spark, sf_dir):
    import public_tokenizers

    from dipsift.llm import packing
    return packing.sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
          FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10"""


@query("op6_exact_top_k", OP6_SQL)
def op6(spark, sf_dir):
    from pyspark.sql import functions as F

    from dipsift.llm import topk
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("key") % 100 == 0)


@query("op8_secret_scan")
def op8(spark, sf_dir):
    from dipsift.llm import secrets
    return secrets.findings(table(spark, sf_dir, "documents"))


@query("op9_url_filter")
def op9(spark, sf_dir):
    from dipsift.llm import urls
    rules = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"),
             urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block")]
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op11_token_alignment")
def op11(spark, sf_dir):
    import public_tokenizers

    from dipsift.llm import alignment
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP12_SQL = """
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
met AS (SELECT id, run, count(*) AS m FROM runs GROUP BY id, run),
hashed AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END))),
           lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)]))) AS h FROM met, crc),
worn AS (SELECT m, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM worn WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
replaced AS (SELECT x.word, y.word AS near FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
shorter AS (SELECT DISTINCT x.word, w.word AS near FROM holes x JOIN words w ON w.word = x.a || x.b),
near AS (SELECT word, near FROM replaced UNION SELECT word, near FROM shorter UNION SELECT near, word FROM shorter),
ranked AS (SELECT p.word, p.near, v.n AS near_n, w.n, count(*) OVER (PARTITION BY p.word) AS n_near,
           row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS k FROM near p JOIN words v ON v.word = p.near JOIN words w ON w.word = p.word),
best AS (SELECT word, n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM ranked WHERE k = 1),
path AS (SELECT word, word AS root, 0 AS d FROM words
         UNION ALL SELECT p.word, b.form, d + 1 FROM path p JOIN best b ON b.word = p.root WHERE b.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, d) AS root FROM path GROUP BY word)
SELECT w.word, form, root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n FROM words w LEFT JOIN best USING (word) JOIN ends USING (word)"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark, sf_dir):
    from dipsift.llm import spelling
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13(spark, sf_dir):
    import public_tokenizers

    from dipsift.llm import token_counts
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
