"""Pieces of oversized items."""

import random
import unicodedata

import numpy as np

from grafonda.llm import cutting as C


def article(rng, sentences):
    out = []
    for _ in range(sentences):
        out.append(" ".join("".join(rng.choice("abcđeghiêklm") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(4, 25))).capitalize() + rng.choice([".", "?", ". Theo PGS. Lê thì đúng."]))
    return "".join(s + rng.choice([" ", " ", "\n", "\n\n", "  "]) for s in out)


def check(text, limit=2048, overlap=120):
    plain, paragraphs = C.canonical(text)
    spans = C.cuts(plain, paragraphs, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(plain)
    for (a, b), (d, e) in zip(spans, spans[1:]):
        assert a < d <= b + 1 and e > b, "pieces run on without a gap"
    assert all(0 < b - a <= limit for a, b in spans)
    return plain, spans


def test_pieces_cover_within_limit():
    rng = random.Random(1)
    for n in (1, 10, 60, 300):
        plain, spans = check(article(rng, n))
        assert (len(spans) > 1) == (len(plain) > 2048)
        for (a, b), (d, _) in zip(spans, spans[1:]):
            assert plain[b] in " \n" or plain[b - 1] in " \n"  # at word ends
            assert d == 0 or plain[d - 1] in " \n"
            assert abs(b - d - 120) <= 61


def test_no_boundaries():
    for text in ("x" * 9000, "ẹ́" * 4000, "漢" * 5000):
        plain, spans = check(text)
        assert len(spans) > 1
        assert all(not unicodedata.combining(plain[a]) for a, _ in spans)


def test_abbreviations_end_no_sentence():
    _, s, _ = C.boundaries("Ở TP. Huế có PGS. Lê. Hết rồi. và thế.", np.zeros(0, np.int64))
    assert s.tolist() == [len("Ở TP. Huế có PGS. Lê. ")]


def test_edits_stay_local():
    rng = random.Random(2)
    text = article(rng, 600)
    a = {C.canonical(text)[0][x:y] for x, y in C.cuts(*C.canonical(text))}
    middle = len(text) // 2
    changed = text[:middle] + " chen vào đây " + text[middle:]
    b = {C.canonical(changed)[0][x:y] for x, y in C.cuts(*C.canonical(changed))}
    assert len(a - b) <= 4 and len(a & b) >= len(a) - 4


def test_table(spark):
    rng = random.Random(3)
    long = article(rng, 80)
    rows = [("a", long, None, 1), ("a", long, None, 1), ("b", "ngắn", "s", 1), ("c", "", "s", 1), ("d", None, "s", 1), (None, long, "s", 1), ("e", " " * 5000 + "x", "s", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, section string, id int")
    got = C.cut_items(df).collect()
    assert {r["id"] for r in got} == {"a", "b", "e"}
    pieces = sorted((r["seq"], r["text"]) for r in got if r["id"] == "a")
    assert [s for s, _ in pieces] == list(range(len(pieces))) and len(pieces) > 2
    assert {r["id"] for r in C.cut_items(df, keep_small=False).collect()} == {"a"}
    assert C.cut_items(df.limit(0)).count() == 0
