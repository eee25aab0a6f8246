"""The pipeline, stage by stage, against plain Python on a small corpus."""

import re

import numpy as np
import pytest

from test_llm import BASE, brute_classes, s, words  # noqa: F401

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(s, tmp_path_factory):  # noqa: F811
    rng = np.random.default_rng(20)
    rows = [(i, f"{words(rng, int(rng.integers(20, 80)))} mail joe{i}@example.com now", ["xx", "yy"][i % 2], f"src{i % 3}", 0) for i in range(80)]
    passage = words(rng, 40)
    rows += [(100, rows[3][1], "xx", "src0", 0), (101, rows[3][1] + " more", "xx", None, 0), (102, f"{words(rng, 30)} {passage.upper()} {words(rng, 30)}", None, "src1", 0),
             (103, None, None, None, None), (104, "", "xx", "src0", 0), (105, "12 34 --", "xx", "src0", 0), (106, words(rng, 9000), "xx", "src0", 0)]
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source, _ in rows]
    top = tmp_path_factory.mktemp("corpus")
    s.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    s.createDataFrame([(0, passage), (1, words(rng, 40))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return rows, str(top)


def test_each_stage(s, corpus, tmp_path):  # noqa: F811
    rows, top = corpus
    text = {r[0]: r[1] for r in rows}
    frame = s.read.parquet(f"{top}/documents.parquet")
    columns = frame.columns
    kept = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(s, frame, top).write.parquet(f"{tmp_path}/{k}")
        frame = s.read.parquet(f"{tmp_path}/{k}")
        assert name == pipeline.STAGES[-1][0] or frame.columns == columns
        kept.append({r.doc_id: r for r in frame.collect()})
    language, distinct, clean, private, packed = kept
    assert set(language) == {i for i, t in text.items() if t and re.search(r"[^\W\d_]", t)}
    classes = brute_classes([(i, text[i]) for i in sorted(language)])
    assert set(distinct) == {i for i, (_, c) in classes.items() if c == i} and 100 not in distinct and 101 not in distinct
    assert set(distinct) - set(clean) == {102}
    for i, r in private.items():
        want = re.sub(BASE["email"], "<EMAIL>", text[i])
        assert r.text == want and r.n_chars == len(want) and r.source == language[i].source
    assert set(private) == set(clean) == set(packed)


def test_run_equals_the_stages_and_takes_empty_tables(s, corpus, tmp_path):  # noqa: F811
    rows, top = corpus
    out = pipeline.run(s, top).collect()
    assert {r.doc_id for r in out} == {i for i in {r[0] for r in rows} - {100, 101, 102, 103, 104, 105}}
    for name in ("documents", "benchmark"):
        s.read.parquet(f"{top}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(s, str(tmp_path)).count() == 0


def test_stages_keep_extra_columns_of_any_name(s, corpus, tmp_path):  # noqa: F811
    from pyspark.sql import functions as F
    rows, top = corpus
    names = ["_id", "_ID2", "spans", "base", "row", "clean", "_language", "_certainty", "component_id", "found", "key"]
    more = [(5, rows[5][1] + " again", "xx", "s", 1), (None, rows[3][1], "xx", None, None), (None, "mail joe@example.com now or never " * 9, "yy", "s", 1)]
    extra = s.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    frame = s.read.parquet(f"{top}/documents.parquet").unionByName(extra).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    columns = frame.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(s, frame, top).write.parquet(f"{tmp_path}/x{k}")
        frame = s.read.parquet(f"{tmp_path}/x{k}")
        if name != pipeline.STAGES[-1][0]:
            assert frame.columns == columns
            for r in frame.collect():
                assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in names)
    kept = [r.doc_id for r in frame.collect()]
    assert kept.count(None) >= 2 and kept.count(5) >= 2  # rows of one id stay or go together, those without stay
