"""Token alignment, spelling variants and token counts against plain Python and the libraries."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from dipsift.llm import alignment, spelling, token_counts
from test_llm import s  # noqa: F401

P = pytest.importorskip("public_tokenizers")
SIGNS = list("ab  \n\tTé'sslle日本1２٣\x1c\x85 ́ǅ!?--🙂\x0b\x0c\r\x1f²½ß") + ["<|endoftext|>", "<|endof", "<s>", " the and", " the"]


def texts(seed, n, longest=60, signs=SIGNS):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


# Token counts

def test_counts_equal_the_library(library, monkeypatch):
    tokens = token_counts.Merger(P.path("byte_bpe_50k.json"))
    rows = texts(1, 3000)
    library[0].encode_special_tokens = False
    assert [tokens.count(t) for t in rows] == [len(e.ids) for e in library[0].encode_batch(rows, add_special_tokens=False)]
    for t in ("a" * 30_000 + "ba" * 30_000, " ".join(rows[:500]), "the " * 50_000):
        assert tokens.count(t) == len(library[0].encode(t, add_special_tokens=False).ids)
    monkeypatch.setattr(token_counts, "MEMO", 50)  # forgets again and again
    assert [tokens.count(t) for t in rows[:300]] == [len(e.ids) for e in library[0].encode_batch(rows[:300], add_special_tokens=False)]
    for t in rows[:200]:
        assert "".join(token_counts.blocks(t, 7)) == t
        part = t.replace("<|endoftext|>", "")
        assert sum(map(tokens.count, token_counts.blocks(part, 7))) == tokens.count(part)


def test_counts_of_odd_rows(s):  # noqa: F811
    rows = [(1, "a b", 5), (1, "a b", 5), (None, "é", 6), (2, None, 7), (3, "", 8), (4, "x " * 2000, 9)]
    got = sorted(map(tuple, token_counts.counts(s.createDataFrame(rows, "doc_id long, text string, n_tokens long"), P.path("byte_bpe_50k.json")).collect()), key=repr)
    assert got == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 2, 1, False), (2, 0, 0, False), (3, 0, 0, False), (4, 4000, 2001, True)], key=repr)
    assert token_counts.counts(s.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).count() == 0


# Alignment

def brute_alignment(rows, library):
    first, second = library
    first.encode_special_tokens = True
    decode = {c: b for b, c in enumerate(token_counts.byte_symbols())}
    counts, out = collections.Counter(), []
    for key, text in rows:
        links, digest, n_a, n_b = [], "", 0, 0
        if text:
            e, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
            a_bytes = [bytes(decode[c] for c in t) for t in e.tokens]
            names = [second.id_to_piece(k) for k in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, names)]
            if b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
                n_a, n_b = len(a_bytes), len(b_bytes)
                ends, at = {}, 0
                for k, t in enumerate(a_bytes):
                    ends[at := at + len(t)] = k
                at = a0 = b0 = 0
                groups = []
                for k, t in enumerate(b_bytes):
                    at += len(t)
                    if at in ends:
                        groups.append(",".join(map(str, e.ids[a0:ends[at] + 1])) + "|" + ",".join(map(str, b[b0:k + 1])))
                        a0, b0 = ends[at] + 1, k + 1
                        links.append((e.ids[ends[at]], b[k]))
                digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        counts.update(links)
        out.append((key, n_a, n_b, links, digest))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(key, n_a, n_b, len(x), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), d) for key, n_a, n_b, x, d in out]


def alignment_rows():
    rows = list(enumerate(texts(2, 400, 80)))
    rows += [(k, t + "▁") for k, t in enumerate(texts(3, 20), 1000)]  # a sign that the second side gives back as a blank
    return rows + [(2000, None), (2001, ""), (2002, " "), (2003, "   "), (None, "a b"), (None, None), (1, "twice"), (1, "twice"), (2004, "tail  "),
                   (2005, "x" * 3000), (2006, "ab cde\n" * 3000)]


def test_alignment_equals_brute_force(s, library):  # noqa: F811
    rows = alignment_rows()
    frame = s.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_a int, block string").repartition(5)
    got = [tuple(r) for r in alignment.align(frame, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()]
    assert sorted(got, key=repr) == sorted(brute_alignment(rows, library), key=repr)
    none = alignment.align(frame.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_long_texts_are_aligned_in_steps(s, library, monkeypatch):  # noqa: F811
    rows, p = alignment_rows(), alignment.pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "STEP_CHARS", 12)
    got = alignment.block([k for k, _ in rows], [t for _, t in rows], p)
    want = brute_alignment(rows, library)
    assert list(zip(got["keys"], got["n_a"], got["n_b"], got["n_groups"], got["sha"])) == [(*w[:4], w[7]) for w in want]
    assert sum(got["times"]) == sum(got["n_groups"])


def test_groups_cover_the_text(s):  # noqa: F811
    rows = [(1, "anticonstitutionally naïve 12345"), (2, None), (3, "x▁y")]
    got = alignment.token_groups(s.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id for r in got} == {1} and max(r.end for r in got) == len(rows[0][1].encode()) + 1
    p = alignment.pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    for r in got:
        assert b"".join(p.a_bytes[k] for k in r.a_ids) == b"".join(p.b_bytes[k] for k in r.b_ids)


# Spelling variants

def brute_variants(rows):
    counts = collections.Counter()
    upper = {c: c + 32 for c in range(65, 91)}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if a == b or len(a) > len(b) + 1:
            return False
        k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
        return a[k + 1:] == b[k + (len(a) == len(b)):]
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(close[w]), n.get(form.get(w))))
    return sorted(out)


def test_variants_equal_brute_force(s):  # noqa: F811
    rng = random.Random(5)
    stems = ["".join(rng.choice("abné×ß") for _ in range(rng.choice((7, 7, 8, 9, 12, 17, 35)))) for _ in range(12)]
    words = []
    for stem in stems:
        word, times = stem, 400
        for _ in range(3):  # a chain of forms, and words around each
            words += [word] * times
            for _ in range(12):
                k, kind = rng.randrange(len(word)), rng.randrange(3)
                words += [word[:k] + ("" if kind == 0 else rng.choice("abcé")) + word[k + (kind < 2):]] * rng.randrange(1, 4)
            k, times = rng.randrange(len(word)), times // 12
            word = word[:k] + rng.choice("xyz") + word[k + (rng.random() < 0.5):]
    words += ["a" * 40] * 50 + ["a" * 41] * 3 + ["b" * 70 + "c"] * 40 + ["b" * 70] * 2 + ["ABCDEFG"] * 3 + ["abcdefg"] * 2
    rng.shuffle(words)
    rows = [(k, " ".join(words[a:a + 50]) + "1kurz, Ωabcdefg") for k, a in enumerate(range(0, len(words), 50))]
    rows += [(None, "abcdefgh abcdefgh"), (7, rows[7][1]), (-1, None), (-2, ""), (-3, "12 .. x")]
    got = spelling.variants(s.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n long, word string").repartition(4))
    got = sorted(map(tuple, got.collect()), key=lambda r: r[0])
    want = brute_variants(rows)
    assert got == want and any(w[1] and w[2] != w[1] for w in want) and len(want) > 200


def test_variants_of_an_empty_table(s):  # noqa: F811
    got = spelling.variants(s.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_leaves_of_two_letters(s):  # noqa: F811
    from pyspark.sql import functions as F
    for r in s.range(2, 120).select("id", spelling.leaves(F.col("id").cast("int")).alias("to")).collect():
        sizes = [b - a for a, b in zip([0, *r.to], r.to)]
        assert r.to[-1] == r.id and min(sizes) >= 1 and (max(sizes) <= 2 or r.id > 32)
