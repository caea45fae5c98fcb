"""Pieces of SentencePiece, fill-in-the-middle and phrases against the libraries, plain loops and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from helixframe.llm import common, fill_in_middle, phrases, pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases, with extra columns whose names clash with what the operators add."""
    rng = random.Random(8)
    texts = [None, "", " ", "one", "one", "  two  blanks ", "<P>x", "a<S", "tab\there.\n\nAnd É漢😀 ▁ marks▁", "<s></s><unk><0x41>", "x" * 20_000, " " * 3000, " ".join(f"w{i % 977}" for i in range(30_000))]
    texts += ["".join(rng.choice(["the ", "cat", " ", "é", "\n", "<M>"[: rng.randint(0, 2)], "Zz9"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, None if i % 5 == 0 else "en", "x", 1) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", None, None), (3, "one", "en", "x", 1), (3, "one", "en", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("n", "w1", "part", "ids", "score", "form", "phrase", "c")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_library(docs, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encode_documents(docs, MODEL).collect()
    want = Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in got:  # spans tile the text, and a piece's bytes are those of its span
        assert r.begins[0] == 0 and r.ends[-1] == len(text[r.doc_id]) and r.begins[1:] == r.ends[:-1]
        for i, a, b in zip(r.ids, r.begins, r.ends):
            shown = lib.id_to_piece(i)
            if i not in (1, 2) and not shown.startswith("<0x") and b > a:
                assert text[r.doc_id][a:b].decode().replace(" ", "▁") in (shown, shown[1:])
        assert r.spans_crc32 == zlib.crc32(np.array(r.begins + r.ends, "<i8").tobytes())
    assert pieces.encode_documents(empty, MODEL).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_maps(rule):
    """Compiled maps of the library, with every setting of blanks, against its own normaliser, ids and spans."""
    spec = next(v for k, v in pieces.wire_fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3)
    rng = random.Random(1)
    parts = ["a", "Z", " ", "  ", "\n", "é", "漢", "\t", "the", "\0", "😀", "　", "ﬁ", "①", "é", "１", "​", "½", "ｶﾞ", "Å", " "]
    for flags in range(8):
        code = pieces.Codec(MODEL, spec + bytes([0x18, flags & 1, 0x20, flags >> 1 & 1, 0x28, flags >> 2 & 1]))
        for _ in range(120):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
            ids, begins, ends = code.encode(text)
            assert ids == code.lib.encode(text, add_eos=True)
            for p, a, b in zip(code.lib.encode(text, return_type="proto").pieces, begins, ends):
                assert p.piece.startswith("<0x") or (p.begin, p.end) == (a, b)


# ---------------------------------------------------------------- fill in the middle


def plain_cut(text, key):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    d = sha(f"1:{key}")
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), sha(out), sha(text)


def test_cuts(docs, empty):
    got = Counter(tuple(r)[:7] for r in fill_in_middle.cut_documents(docs).collect())
    assert got == Counter((r.doc_id, *plain_cut(r.text or "", "" if r.doc_id is None else r.doc_id)) for r in docs.collect())
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.cut_documents(empty).count() == 0


def test_cuts_of_blocks():
    rng = random.Random(2)
    for k in range(3000):
        text = "".join(rng.choice(["ab", "Z", "é", "\n", " ", "<", "P>", "S>", "M>", "<S", "漢", "😀", "9", "\0", "_", "K", "abcdefghijklmnop"]) for _ in range(rng.randint(0, 30)))
        cut = fill_in_middle.transform(text, str(k), rng.choice((3, 7, 200)))
        assert (cut.n, cut.form, cut.prefix, cut.middle, sha(cut.output), sha(text)) == plain_cut(text, k)
        assert fill_in_middle.restore(cut.output, cut.form) == text
    with pytest.raises(ValueError, match="not of the form"):
        fill_in_middle.restore("x", "psm")


# ---------------------------------------------------------------- phrases


def brute(rows, least, first):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (g, v), b in cand.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)}


def phrase_rows(rng, n):
    words = ["a", "b", "c", "dd", "É", "é", "İ", "x\x1cy", "The", "the", " "]
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", ";"]) for _ in range(rng.randint(0, 40)))
        yield (i, rng.choice([text, text, "A b c dd a b. The line again: " + text, None if i % 50 == 0 else text]), rng.choice([None, "und", "en", "en", "de"]), "x", 1)


@pytest.mark.parametrize("held", [50, 400_000])
def test_phrases(spark, monkeypatch, held):
    """Small tables with ties, overlaps and hot prefixes; tasks that hold few rows give the same."""
    monkeypatch.setattr(phrases, "BLOCK", 100 if held == 50 else 1 << 20)
    rows = list(phrase_rows(random.Random(held), 160))
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("n", F.lit(1))
    for least, first in ((4, 2000), (9, 7)):
        want = brute([(r[1], r[2]) for r in rows], least, first)
        assert {tuple(r) for r in phrases.mine_phrases(df, least, first).collect()} == want and len(want) > 10


def test_prefixes_in_runs_and_parts(spark):
    """A prefix of more rows than a task holds, and one that is dealt in parts."""
    rng = random.Random(4)
    rows = [("en", 1 + i % 2, 5, *(rng.randint(1, 3) for _ in range(2)), rng.choice([0, 1, 2]), 0 if i % 2 else rng.randint(1, 3), rng.randint(1, 4)) for i in range(4000)]
    schema = "lang string, w1 long, w2 long, w3 long, w4 long, w5 long, part int, c long"
    want = Counter()
    for lang, a, b, c, d, e, _, n in rows:
        for w in {(a, b, c, 0, 0), (a, b, c, d, 0), (a, b, c, d, e)}:
            want[lang, *w] += n
    want = {k: v for k, v in want.items() if v >= 300}
    for held in (80, 10_000):
        got = phrases.grow_prefixes(spark.createDataFrame(rows, schema).repartition(5), 300, held)
        got = got.groupBy("lang", *phrases.WORDS).agg(F.sum("c").alias("c")).where("c >= 300")
        assert {tuple(r)[:6]: r.c for r in got.collect()} == want


def test_rows_behind_prefixes(spark, monkeypatch):
    """Frequent pairs in a row whose runs of three are rare send no row to a prefix's task; frequent runs send theirs."""
    sent, project = [], phrases.project
    monkeypatch.setattr(phrases, "project", lambda *a: sent.append(project(*a)) or sent[-1])
    rng = random.Random(6)
    # each of 16 pairs of words some 250 times, each run of three some 60 times
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(5)), "en", "x", 1) for i in range(1000)]
    for more, some in (([], False), ([(i, "p q r s t", "en", "x", 1) for i in range(1000, 1150)], True)):
        df = spark.createDataFrame(rows + more, DOCS).repartition(3)
        want = brute([(r[1], r[2]) for r in rows + more], 150, 2000)
        assert {tuple(r) for r in phrases.mine_phrases(df, 150).collect()} == want and len(want) >= 16
        got = [(r.c, r.w4 != 0, r.w5 != 0) for r in sent.pop().collect()]
        assert (sum(c for c, _, _ in got), all(d for _, d, _ in got)) == (300 if some else 0, True)


def test_hot_words_are_dealt_in_parts(spark):
    """Two words in most places: their pair comes in parts, which add up."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["x y", "x y z", "y x", f"w{rng.randint(0, 30)}"]) for _ in range(8)) + ".", "en", "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    words = phrases.count_words(df).where("w1 <> 0 and c >= 20")
    n = phrases.count_words(df).where("w1 = 0").first().c
    parts = phrases.project_words(df, words, n).select("w1", "w2", "part").distinct().groupBy("w1", "w2").count()
    assert parts.agg(F.max("count")).first()[0] > 3
    assert {tuple(r) for r in phrases.mine_phrases(df, 20).collect()} == brute([(r[1], r[2]) for r in rows], 20, 2000)


def test_large_numbers_are_exact(spark):
    """Products past 64 bits."""
    h = lambda *w: [*w, *[0] * (5 - len(w))]
    a, left, right, n = 10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 9, 9 * 10**15 + 3
    rows = [("en", *h(1), left), ("en", *h(2), right), ("en", *h(1, 2), a)]
    found = spark.createDataFrame(rows, "lang string, w1 long, w2 long, w3 long, w4 long, w5 long, c long")
    names = spark.createDataFrame([("en", 1, "x"), ("en", 2, "y")], "lang string, w1 long, word string")
    got = phrases.score_phrases(found, names, spark.createDataFrame([("en", n)], "lang string, n long"), common.Scratch(spark, "test")).collect()
    assert [tuple(r) for r in got] == [("en", "x y", a, left, right, n, 1000 * a * n // (left * right))]


def test_phrases_of_nothing(spark, empty):
    assert phrases.mine_phrases(empty).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([(1, None, "en", "x", 1), (2, " . ", None, "x", 1)], DOCS), 1).count() == 0
