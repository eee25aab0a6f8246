"""Small cases and brute-force comparisons for the training-data operators."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipsift.llm import decontaminate, jaccard_join, langid, packing, pii, quality, secrets, token_files, tokens, topk, urls
from dipsift.llm.common import crc_bucket, weighted_sample
from dipsift.llm.graph import components
from dipsift.llm.shingles import shingle_sets
from dipsift.llm.ship import ship

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    ship(spark)
    return spark


def docs(s, rows):
    return s.createDataFrame([(i, t, None, "a", len(t or "")) for i, t in rows], DOCS)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                parent[top(b)] = top(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[top(k)] = min(low.get(top(k), i), i)
    return {i: (len(sets[k]), low[top(k)]) for k, (i, _) in enumerate(rows)}


def test_shingles_count_as_words_do():
    texts = ["", "  ", "A b", "a B c d e", "a b c d e f a b c d e f", "x" * 3000 + " y", "é\u00a0è x y z q"]
    got = [len(x) for x in shingle_sets([t.encode() for t in texts])]
    assert got == [0, 0, 1, 1, 6, 1, 1]


def test_jaccard_join_equals_brute_force(s):
    rng = np.random.default_rng(1)
    rows = [(i, words(rng, int(rng.integers(1, 60)))) for i in range(60)]
    base = words(rng, 120).split()
    for i in range(100, 190):  # one large group of near copies, far more than SMALL
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[at] = f"z{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(200, 260):  # a chain: each is near the next only
        w = list(base[:60]) + [f"c{k}" for k in range(i, i + 60)]
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One Two"), (304, "one two"), (305, words(rng, 30000)), (306, "one  TWO"), (307, None)]
    rows += [(400 + k, rows[5][1]) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(s, rows)).collect()}
    assert got == brute_classes(rows)


def test_jaccard_join_of_odd_tables(s):
    assert jaccard_join.near_duplicates(docs(s, []).limit(0)).count() == 0
    same = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u v")]
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(docs(s, same)).collect() if r.doc_id or r.component_id)
    assert got == [(False, 1, 1), (False, 1, 1), (True, None, 1)]


def test_links_equal_brute_force_above_small_groups(s, monkeypatch):
    rng = np.random.default_rng(12)
    base = words(rng, 120).split()
    rows = [(i, words(rng, 40)) for i in range(20)]
    for i in range(100, 190):  # one group, far more than SMALL, in which not all are linked
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[at] = f"z{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(300, rows[25][1].upper()), (301, ""), (302, None)]
    first, sets = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        first.setdefault(sets[i], i)
    one = [i for g, i in first.items() if g]
    want = {(a, b) for a in one for b in one if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    count = {i: sum(first[sets[i]] in p for p in want) for i, _ in rows}
    assert max(count.values()) > jaccard_join.SMALL and len(want) < 80 * 79 // 2
    monkeypatch.setattr(jaccard_join, "TILE", 16)  # several blocks of a band
    assert sorted((r.x, r.y) for r in jaccard_join.link_table(docs(s, rows)).collect()) == sorted(want)
    monkeypatch.undo()
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs(s, rows), count_links=True).collect()}
    assert {i: r.links for i, r in got.items()} == count
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_classes(rows)
    assert jaccard_join.link_table(docs(s, [])).count() == 0


def test_components_of_a_path_and_a_star(s):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.component for r in components(s.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 101


def test_language_id(s):
    rng = np.random.default_rng(2)
    parts = {"xx": ["ab", "ba", "bo", "ob"], "yy": ["ki", "ik", "ku", "uk"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x], 3)) for _ in range(int(rng.integers(3, 40)))), x) for i, x in
            enumerate(rng.choice(list(parts), 400))]
    frame = s.createDataFrame([(i, t, x, "s") for i, t, x in rows] + [(1000, None, "xx", "s"), (1001, "", None, "s"), (1002, "12 ... 3", "yy", None),
                                                                      (1003, "kiku " * 60000, None, "s")], "doc_id long, text string, lang string, score string")
    model = langid.fit(frame.where((crc_bucket(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()))
    out = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert sum(out[i].lang_pred == x for i, _, x in rows) >= 0.98 * len(rows)
    assert [out[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yy"]
    assert all(0 <= r.score <= 1 for r in out.values())
    none = langid.fit(frame.limit(0))
    assert {r.lang_pred for r in langid.predict(frame, none).collect()} == {"und"} and langid.predict(frame.limit(0), model).count() == 0


def test_language_statistics_cover_all_labelled_rows(s):
    rows = [(i, "ab ba" if i % 10 else "ab zz", "xx") for i in range(400)] + [(500 + i, "ki ku", "yy") for i in range(40)] + [(900, None, "yy"), (901, "..", "yy")]
    frame = s.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, texts = langid.frequencies(frame)
    want = np.zeros(1 << langid.BITS)
    for _, t, _ in rows[:440]:
        want[np.unique(langid.grams(t))] += 1
    assert texts == 440 and (seen == want).all()
    # A bucket that no sampled row has keeps its count: the rows of one language weigh as they are.
    whole, few = langid.fit(frame, per_label=1000), langid.fit(frame, per_label=25)
    assert whole.labels == few.labels == ["xx", "yy"]


def test_decontamination_finds_edited_passages_only(s):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(n))
    items = [(k, text(30)) for k in range(20)]
    edited = list(items[3][1])
    for at in range(12, 120, 15):  # seven or eight edits a window
        edited[at] = "#"
    rows = [(1, text(50)), (2, f"{text(20)} {items[2][1].upper()}\n{text(20)}"), (3, text(9) + "".join(edited)), (4, None), (5, ""), (6, "ab"),
            (7, text(3000) + items[7][1].replace(" ", "\n  ") + text(3000)), (8, items[8][1]), (8, items[8][1]), (9, items[9][1][:60])]
    bench = s.createDataFrame([*items, (50, None), (51, ""), (52, "abc"), (2, items[2][1])], "item_id long, text string")
    found = decontaminate.contamination(docs(s, rows), bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in found}) == [(2, 2), (3, 3), (7, 7), (8, 8)]
    hit = next(r for r in found if r.doc_id == 2)
    assert rows[1][1][hit.start:hit.end].lower() == items[2][1]
    left = decontaminate.clean(docs(s, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 6, 9] and left.columns == docs(s, rows).columns
    assert decontaminate.contamination(docs(s, rows), bench.limit(0)).count() == 0
    small = decontaminate.contamination(docs(s, rows), bench, block_chars=500)  # many blocks
    assert {(r.doc_id, r.item_id) for r in small.collect()} == {(2, 2), (3, 3), (7, 7), (8, 8)}


def test_decontamination_finds_stretches_at_any_offset(s):
    rng = np.random.default_rng(13)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(n))
    item, rows = text(80), []
    for at in range(0, len(item) - 160, 7):
        for size in (80, 100, 150):
            part = item[at:at + size].strip()
            rows.append((len(rows), text(20) + " qq " + (part + item[at + len(part):][:2]).strip() + " qq " + text(20), len(part)))
    edited = list(item[15:115])
    edited[20] = edited[45] = edited[70] = "#"
    rows.append((len(rows), text(20) + "".join(edited) + text(20), 100))
    clean = [(1000 + at, text(20) + item[at:at + 50] + text(20)) for at in range(0, 100, 9)]
    bench = s.createDataFrame([(1, item), (2, text(40))], "item_id long, text string")
    found = decontaminate.contamination(docs(s, [r[:2] for r in rows] + clean), bench).collect()
    got = {r.doc_id for r in found}
    assert {i for i, _, n in rows if n >= 80} <= got and not any(i >= 1000 for i in got) and {r.item_id for r in found} == {1}


def test_banded_alignment_equals_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        p, t = rng.integers(0, 3, 12), rng.integers(0, 3, 20)
        row = np.zeros(21, int)
        for i in range(1, 13):
            new = [i]
            for j in range(1, 21):
                new.append(min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[-1] + 1))
            row = np.array(new)
        got = decontaminate.distance_at(p, t, 12)
        assert got[0] == row.min()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
    return sum(v - 9 if v > 9 else v for v in t) % 10 == 0


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_spans_of_a_text_with_many_hits_in_blocks(s, monkeypatch):
    """40,000 addresses and 3,000 further candidates in one text, in blocks of every size."""
    rng = np.random.default_rng(15)
    pool = ["a@b.c", "joe (at) example (dot) com", "212-555-1234", "+1 (555) 123-4567", "4111 1111 1111 1111", "x", "é", "Mr. John Smith", "1.2.3.4", "😀@b.cd"]
    mixed = [" ".join(rng.choice(pool, n)) for n in (1, 2, 3, 7, 40, 41, 300)]
    model = pii.SpanModel({}, 1.0)  # takes every candidate, so that overlaps are met

    def all_of(texts):
        found = pii.find(docs(s, list(enumerate(texts))), model)
        return {r.doc_id: r for r in found.select("doc_id", "spans", pii.listed(F.col("base")).alias("b"), pii.redacted(F.col("text"), F.col("spans")).alias("clean"),
                                                  pii.candidates(F.col("text")).alias("all")).collect()}
    names = pii.KINDS + pii.MORE
    for size in (2, 512):
        monkeypatch.setattr(pii, "BLOCK", size)
        for i, r in all_of(mixed).items():
            assert r.b == brute_base(mixed[i])
            base = [x for x in r.spans if x["rank"] < len(pii.KINDS)]
            more = [(c["start"], c["rank"], c["end"]) for c in r.all if not any(b["start"] < c["end"] and c["start"] < b["end"] for b in base)]
            assert [tuple(x) for x in r.spans if x["rank"] >= len(pii.KINDS)] == more
            clean, at = "", 0
            for start, rank, end in map(tuple, r.spans):
                if start >= at:
                    clean += mixed[i][at:start] + f"<{names[rank].upper()}>"
                at = max(at, end)
            assert r.clean == clean + mixed[i][at:]
    long = "a@b.c " * 40_000 + "joe (at) example (dot) com, " * 3000
    began = time.perf_counter()
    got = all_of([long])[0]
    assert len(got.spans) == 43_000 and got.clean == "<EMAIL> " * 40_000 + "<EMAIL_OBFUSCATED>, " * 3000
    assert time.perf_counter() - began < 60  # squares of the hits would take minutes


def test_personal_data(s):
    rng = np.random.default_rng(5)
    pool = ["a@b.c", "a@b.c_d@e.f", "x@y", "@", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
            "+12", "+1234567890123456", " ", "é", "\n", "12", "-", ".", "ü@x-y.z", "4111111111111111", "😀"]
    rows = [(i, "".join(rng.choice(pool, int(rng.integers(0, 14))))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "1" * 60000), (1003, "a" * 60000), (1004, "1 " * 30000), (1005, "a@b.c " * 2000),
             (1006, "call me at 212-555-1234 or joe (at) example (dot) com, Mr. John Smith")]
    frame = docs(s, rows).withColumn("spans", F.lit(1))
    model = pii.fit(frame)
    got = {r.doc_id: r for r in pii.find(frame, model).select("doc_id", "text", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("a"),
                                                              pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    for i, t in rows:
        assert got[i].b == brute_base(t or ""), i
        assert set(filter(None, got[i].b.split(","))) <= set(got[i].a.split(","))
    assert got[1006].clean == "call me at <PHONE_NATIONAL> or <EMAIL_OBFUSCATED>, <NAME>" and got[1000].clean is None
    assert pii.find(frame.limit(0), model).count() == 0 and pii.fit(frame.limit(0)).weights == {}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memoised_tokens_equal_the_library(name):
    e = tokens.encoder(P.path(name))
    for t in ["", " ", "a\n\n  b\tc", "don't I'LL 'S", "<|endoftext|> <|startoftext|>", "ΑΣ ΣΑΣ. İst ² ½ e\u0301", "日本 テスト 😀😀", "x" * 5000, "12345 67"]:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(s, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), words(rng, int(rng.integers(0, 80)))) for i in rng.permutation(300)] + [(1000, None), (1001, ""), (1002, words(rng, 4000)), (7, "again"), (None, "n")]
    path = P.path("byte_bpe_50k.json")
    files = token_files.write(docs(s, rows), str(tmp_path / "t"), path)
    got = token_files.read(files).orderBy("start").collect()
    plain = tokens.encoder(path).tokenizer
    want = sorted(((i is not None, i or 0), plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in want]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert token_files.read(token_files.write(docs(s, []), str(tmp_path / "e"), path)).count() == 0


def test_readers_decompress_only_what_is_asked_for(tmp_path):
    out = token_files.Writer(str(tmp_path / "x.tokens"), frame_bytes=64)
    items = [(k, np.arange(k, k + n, dtype="<u4").tobytes()) for k, n in enumerate([3, 40, 0, 1, 16, 16, 100])]
    for k, ids in items:
        out.add(k, ids)
    out.close()
    reader = token_files.Reader(str(tmp_path / "x.tokens"))
    assert [reader.document(k) for k in range(7)] == [x for _, x in items] and list(reader.documents()) == [x for _, x in items]
    one = token_files.Reader(str(tmp_path / "x.tokens"))
    assert one.document(3) == items[3][1] and one.frames_read == 1
    raw = bytearray((tmp_path / "x.tokens").read_bytes())
    raw[10] ^= 1
    (tmp_path / "y.tokens").write_bytes(raw)
    with pytest.raises(Exception):
        token_files.Reader(str(tmp_path / "y.tokens")).document(0)


def test_packing(s):
    rng = np.random.default_rng(7)
    rows = [(i, words(rng, int(rng.integers(0, 300)))) for i in range(200)] + [(500, None), (501, ""), (502, words(rng, 9000)), (3, "again a row")]
    out = packing.sequences(docs(s, rows), P.path("word_bpe_49k.json"), block_tokens=30_000).collect()
    plain = tokens.encoder(P.path("word_bpe_49k.json")).tokenizer
    want = sorted((i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows if i != 3)
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        if r.doc_id != 3:
            assert r.start == len(got.setdefault(r.doc_id, []))
            got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert sorted(got.items()) == want
    by = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096
    assert packing.sequences(docs(s, []), P.path("word_bpe_49k.json")).count() == 0


def test_differencing_is_nearly_equal_and_whole():
    rng = np.random.default_rng(8)
    for n, k in ((0, 3), (1, 1), (2, 5), (500, 40)):
        sizes = rng.integers(1, 1025, n).tolist()
        out = packing.differencing(sizes, k)
        assert sorted(i for w in out for i in w) == list(range(n)) and len(out) == k
        if n > 100:
            totals = [sum(sizes[i] for i in w) for w in out]
            assert max(totals) - min(totals) < 30
    assert [sum(p[2] for p in w) for w in packing.pack([4096, 4097, 5000, 1])] == [4096, 4096, 4096, 906]


def test_top_k_equals_brute_force(s):
    rng = np.random.default_rng(9)
    v = np.concatenate((rng.normal(0, 0.2, (300, 10)), np.tile(rng.normal(0, 0.2, 10), (60, 1))))  # many equal vectors: ties
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)] + [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 10), (1300, [float("inf")] * 10), (None, [0.1] * 10)]
    frame = s.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    q = np.floor(1024 * v.astype(np.float32).astype(float)).astype(int)
    want = []
    for i in range(0, 360, 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(360) if j != i)[:10]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(order)]
    for block in (1024, 3):
        got = topk.search(frame, F.col("key") % 50 == 0, block=block).collect()
        assert sorted(tuple(r) for r in got) == want
    few = topk.search(frame.where("vec_id < 4"), F.col("key") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3]
    assert topk.search(frame.limit(0), F.col("key") == 0).count() == 0


def test_quality(s):
    rng = np.random.default_rng(10)
    rows = [(i, words(rng, 60) if i % 3 else " | ".join(words(rng, 1) + "!!" for _ in range(40))) for i in range(300)]
    frame = docs(s, rows + [(900, None), (901, ""), (902, "word " * 60000)]).withColumn("score", F.lit("old"))
    labels = s.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5000, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    machine = quality.fit(frame, labels.where(~held))
    out = {r.doc_id: r.score for r in quality.score(frame, machine).collect()}
    assert min(out[i] for i in range(300) if i % 3) > max(out[i] for i in range(300) if i % 3 == 0) and all(0 <= x <= 1 for x in out.values())
    assert {r.score for r in quality.score(frame, quality.fit(frame, labels.limit(0))).collect()} == {0.5}
    assert quality.score(frame.limit(0), machine).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(11)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    at, x = rng.choice(quality.SIZE, 9, replace=False), rng.normal(size=9)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i + 1, 9))
    assert abs(m.logit(at, x) - (0.3 + m.linear[at] @ x + pairs)) < 1e-9


def test_secrets(s):
    secret = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    rows = [(i, f'words here token = "{secret[:i % 7 + 30]}{i}" and more') for i in range(60)]
    rows += [(100 + i, f"the number {10**19 + i} and thetheandandtionionmentment{i} or commit {secret}{i} here") for i in range(60)]
    rows += [(300, None), (301, ""), (302, "a1" * 50000), (303, f'password: "{secret}"')]
    out = secrets.findings(docs(s, rows)).collect()
    text = dict(rows)
    assert {r.doc_id for r in out if r.doc_id < 100} == set(range(60)) and not any(100 <= r.doc_id < 160 for r in out)
    assert next(text[303][r.start:r.end] for r in out if r.doc_id == 303) == secret
    assert secrets.findings(docs(s, [])).count() == 0
    assert sorted(r.doc_id for r in secrets.findings(docs(s, rows[:3])).collect()) == [0, 1, 2]


def test_samples_survive_hot_values_and_few_distinct_ones(s):
    rows = [("a", "hot")] * 30_000 + [("a", f"v{k}") for k in range(30_000)] + [("b", f"t{k % 3}") for k in range(20_000)] + [("c", "x"), (None, "y")]
    frame = s.createDataFrame(rows, "g string, v string")
    for seed in range(3):
        got = {}
        for r in weighted_sample(frame, ["v"], "g", 500, seed).collect():
            got.setdefault(r.g, {})[r.v] = r.weight
        assert set(got) == {"a", "b", "c"} and got["c"] == {"x": 1}
        assert len(got["b"]) == 3 and 498 <= sum(got["b"].values()) <= 503
        assert 249 <= got["a"]["hot"] <= 251 and 150 < len(got["a"]) < 350 and 400 < sum(got["a"].values()) < 600


def test_secrets_of_one_token_copied_everywhere_keep_their_kind(s):
    one = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    rows = [(i, f'token = "{one}"') for i in range(400)] + [(1000 + i, f"the number {10**19 + i} here") for i in range(100)]
    rows += [(2000 + i, f'value = "{one[i:]}{one[:i]}"') for i in range(30)]  # unsettled, and like the token
    found = {r.doc_id for r in secrets.findings(docs(s, rows), per_label=20).collect()}
    assert set(range(400)) | set(range(2000, 2030)) <= found and not any(1000 <= i < 1100 for i in found)


RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"),
         urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block")]


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = host.translate(FOLD)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_urls(s):
    given = [None, "", "no scheme", "http://", "http://Example.COM", "http://a.example.com/en/1?x=1#y", "https://www.example.com/en/", "https://m.www.example.com/en/x",
             "http://x.net/es/", "http://x.net/es", "http://notexample.com/en/", "http://b.org/?q=http://c.com/en/", "http://x.net#/es/", "a://b://c/d", "http://É.com/é\n/x",
             "http://x.com/" + "ab" * 20000, "https://cheap.org/en/1"] + [f"http://s{k}.com/p/{k}" for k in range(40)] + [f"http://t{k}.net/fr/{k}?u=1&v=2" for k in range(40)]
    frame = s.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit("old"))
    out = {r.page_id: r for r in urls.judge(frame, RULES, rounds=3).collect()}
    for k, url in enumerate(given):
        host, path, rule, verdict = brute_rule(url)
        assert (out[k].host, out[k].path, out[k].rule) == (host, path, rule), url
        assert out[k].verdict == verdict or verdict is None and out[k].verdict in ("allow", "block")
    assert urls.judge(frame.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge(frame.where("page_id < 4"), RULES).collect()} == {"allow"}


def test_suffixes_are_counted_over_all_labelled_urls(s):
    rows = [(f"http://h{k}.s{k % 150}/?{k}", f"h{k}.s{k % 150}", "/", "block" if k % 150 < 75 else "allow") for k in range(1500)]
    frame = s.createDataFrame(rows, "url string, host string, path string, verdict string")
    model = urls.fit(frame, per_verdict=60, rounds=1)
    got = {r["_suffix"]: (r["_share"], r["_blocked"]) for r in model.suffixes.collect()}
    assert got == {f"s{k}": (10 / 1500, (11 if k < 75 else 1) / 12) for k in range(150)}
    other = s.createDataFrame([("x", "a.zz", "/", None), (None, "b.s149", "", None)], frame.schema)
    seen = {r.url: (r["_suffix_share"], r["_suffix_blocked"]) for r in urls.lexical(other, "url", model.suffixes).collect()}
    assert seen == {"x": (0.0, 0.5), None: (10 / 1500, 1 / 12)}


def test_decontamination_equals_brute_force_over_documents(s):
    rng = np.random.default_rng(31)
    text = lambda n: " ".join("".join(rng.choice(list("abcde"), int(rng.integers(1, 4)))) for _ in range(n))
    items = [(k, text(int(n))) for k, n in enumerate(rng.integers(2, 70, 12))] + [(None, text(40)), (3, "la " * 60)]
    rows = []
    for k in range(160):
        name, item = items[int(rng.integers(len(items)))]
        at, size = int(rng.integers(0, max(1, len(item) - 60))), int(rng.integers(50, 160))
        part = list(item[at:at + size])
        for e in rng.integers(0, len(part), int(rng.integers(0, 14))):
            part[e] = rng.choice(["", "zz", "z"])
        rows.append((k, f"{text(30)} {''.join(part)} {text(30)}"))
    rows += [(None, f"{text(20)} {items[12][1]} {text(20)}"), (7, items[4][1]), (500, "la " * 1500), (501, "\xe9" * 50 + items[0][1].upper())]

    def plain(t):
        folded = decontaminate.normal(np.frombuffer(t.encode(), np.uint8))[0].tobytes()
        return np.frombuffer(folded.strip(b" "), np.uint8)

    def within(pattern, folded, k):  # least edits of the pattern against any stretch
        row = np.zeros(len(folded) + 1, np.int64)
        steps = np.arange(len(folded) + 1)
        for i, c in enumerate(pattern, 1):
            best = np.concatenate(([i], np.minimum(row[:-1] + (folded != c), row[1:] + 1)))
            row = np.minimum.accumulate(best - steps) + steps
        return row.min() <= k
    want = set()
    for name, item in items:
        folded = plain(item)
        for i, t in rows:
            for size, every in ((decontaminate.WINDOW, decontaminate.STEP), (decontaminate.SHORT, decontaminate.SHORT_STEP)):
                last = max(0, len(folded) - size)
                for at in {*range(0, last, every), last}:
                    w = folded[at:at + size]
                    k = min(int(len(w) * decontaminate.EDIT_RATE), max(0, (len(w) - decontaminate.Q) // decontaminate.Q))
                    if len(w) >= decontaminate.Q and (i, name) not in want and within(w, plain(t), k):
                        want.add((i, name))
    bench = s.createDataFrame(items, "item_id long, text string")
    frame = docs(s, rows).withColumn("item_id", F.lit("x")).repartition(3)
    found = decontaminate.contamination(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and (None, None) in want and 30 < len(want) < 160
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((i is None, i or 0) for i, t in rows if not any(
        x == i for x, _ in want) or (i == 7 and t != items[4][1]))


def test_decontamination_of_a_repetitive_text_keeps_memory_bounded():
    import tracemalloc
    w = decontaminate.windows_of([(1, "la " * 60)])
    tracemalloc.start()
    got = decontaminate.batch_hits([b"x y z " * 10, ("la " * 30_000).encode()], w)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert [(r[0], r[1]) for r in got] == [(1, 0)] and got[0][2] == 0 and got[0][3] >= 89_990


def test_secret_candidates_equal_plain_python_at_any_length(s):
    rng = np.random.default_rng(41)
    run = lambda n, signs: "".join(rng.choice(list(signs), n))
    texts = ["x " + run(230, "abcXYZ/_") + "7" + run(20, "ab9"), run(5000, "abc-=") + "1", run(5000, "abc"), run(15, "a1"), "é" + run(16, "a1") + "é" + run(40, "+/0Z"), "", None,
             " ".join(run(int(rng.integers(1, 40)), "ab1_ =,") for _ in range(300))]
    frame = s.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = frame.select("doc_id", F.explode(secrets.candidates(F.col("text"))).alias("c")).select("doc_id", "c.start", "c.end", "c.hit").collect()
    want = [(k, m.start(), m.end(), m.group()) for k, t in enumerate(texts) for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", t or "") if re.search("[0-9]", m.group())]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 4
