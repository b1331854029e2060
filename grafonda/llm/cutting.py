"""Oversized items cut at natural boundaries, by content-defined chunking.

The size of an item is measured on its canonical text: NFC, every run of blanks, tabs, carriage
returns and line feeds one character (a line feed where the run holds one), none at either end. A
windowed rolling hash of the characters marks landmarks, one in ``1 << mask_bits`` places on
average. After a cut the next one belongs to the first landmark between the least and the greatest
size and snaps to the natural boundary nearest to it there: a paragraph or line end close by, else
a sentence end, else a word end. Without a landmark the last natural boundary before the greatest
size is taken. Landmarks depend on the 32 characters before them only, so after an edit the cuts
fall back into step at the next landmark and only neighbouring pieces change.

Every piece but the first begins ``overlap`` characters before its cut, moved to the nearest word
beginning, and no piece is longer than ``limit``. Where a text has no boundary at all (one endless
word) it is cut hard, never between a base character and its combining marks.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = re.compile(r"[ \t\r\n]+")
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("tp ts ths pgs gs bs ks tt q p h x tx st ô ông mr mrs dr st vv v.v tr no vol cf etc n.v p.v".split())
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=[ \n])")
_HASH_WINDOW = 32


def canonical(text: str | None) -> tuple[str, np.ndarray]:
    """Canonical text and the places of its paragraph ends (runs with two or more line feeds)."""
    if not text:
        return "", np.zeros(0, np.int64)
    text = unicodedata.normalize("NFC", text).strip(" \t\r\n")
    out, paragraphs, at, size = [], [], 0, 0
    for m in _RUN.finditer(text):
        run = m.group()
        out.append(text[at : m.start()])
        size += m.start() - at
        feeds = run.count("\n") or run.count("\r")
        if feeds > 1:
            paragraphs.append(size)
        out.append("\n" if feeds else " ")
        size += 1
        at = m.end()
    out.append(text[at:])
    return "".join(out), np.array(paragraphs, np.int64)


def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 4096, dtype=np.int64).view(np.uint64)


_GEAR = _gear()


def landmarks(points: np.ndarray, mask_bits: int) -> np.ndarray:
    """Places whose rolling hash over the last 32 code points has `mask_bits` leading zero bits."""
    mixed = _GEAR[(points * np.uint32(2654435761) >> np.uint32(20)) & np.uint32(4095)] ^ points.astype(np.uint64)
    h = np.zeros(len(points), np.uint64)
    for j in range(min(_HASH_WINDOW, len(points))):
        h[j:] += mixed[: len(points) - j] << np.uint64(j)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.flatnonzero(h >> np.uint64(64 - mask_bits) == 0)


def boundaries(text: str, paragraphs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut places (the index of the first character after the boundary's blank) of lines and paragraphs, sentences, words."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    words = np.flatnonzero((points == 32) | (points == 10)) + 1
    lines = np.flatnonzero(points == 10) + 1
    sentences = []
    for m in _SENTENCE.finditer(text):
        if text[m.start()] == "." and m.end() == m.start() + 1:
            begin = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
            word = text[begin : m.start()].lower().strip("(\"'“‘«[")
            after = text[m.end() + 1 : m.end() + 2]
            if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or after.islower():
                continue
        sentences.append(m.end() + 1)
    return lines, np.array(sentences, np.int64), words


def _nearest(places: np.ndarray, low: int, high: int, to: int) -> int | None:
    a, b = np.searchsorted(places, low), np.searchsorted(places, high, side="right")
    if a == b:
        return None
    some = places[a:b]
    return int(some[np.abs(some - to).argmin()])


def _hard(text: str, at: int, least: int) -> int:
    while at > least and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def cuts(text: str, paragraphs: np.ndarray, limit: int = 2048, overlap: int = 120, least: int = 900, mask_bits: int = 9, reach: int = 200) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a canonical text; one piece if it is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    marks = landmarks(points, mask_bits)
    lines, sentences, words = boundaries(text, paragraphs)
    pieces, begin, cut = [], 0, 0
    while n - begin > limit:
        most = begin + limit
        low = min(cut + least, most)
        at = np.searchsorted(marks, low)
        mark = int(marks[at]) if at < len(marks) and marks[at] <= most else None
        if mark is not None:
            place = _nearest(lines, max(low, mark - reach), min(most, mark + reach), mark)
            for tier in (sentences, words):
                if place is None:
                    place = _nearest(tier, low, most, mark)
        else:
            place = _nearest(lines, max(low, most - reach), most, most)
            for tier in (sentences, words):
                if place is None:
                    place = _nearest(tier, low, most, most)
        if place is None:  # no boundary between least and limit: any word end after the last cut, else a hard cut
            place = _nearest(words, cut + 1, most, most) or _hard(text, mark or most, cut + 1)
        end = place - 1 if text[place - 1] in " \n" else place
        pieces.append((begin, end))
        cut = place
        wanted = cut - overlap
        start = _nearest(words, max(pieces[-1][0] + 1, wanted - overlap // 2), min(cut - 1, wanted + overlap // 2), wanted)
        begin = start if start is not None else max(pieces[-1][0] + 1, _hard(text, wanted, pieces[-1][0] + 1))
    pieces.append((begin, n))
    return pieces


def _run(limit: int, overlap: int, keep_small: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            row, seq, begin, end, piece = [], [], [], [], []
            for i, text in enumerate(texts):
                plain, paragraphs = canonical(text)
                spans = cuts(plain, paragraphs, limit, overlap)
                if len(spans) < 2 and not keep_small:
                    continue
                for s, (a, b) in enumerate(spans):
                    row.append(i), seq.append(s), begin.append(a), end.append(b), piece.append(plain[a:b])
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(where) for c in ("id", "section", "version")] + [pa.array(seq, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string())],
                names=["id", "section", "version", "seq", "begin", "end", "text"],
            )

    return run


def cut_items(
    rows: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    section_col: str = "section",
    limit: int = 2048,
    overlap: int = 120,
    keep_small: bool = True,
) -> DataFrame:
    """(id, section, version, seq, begin, end, text): the pieces of every item, seq running from 0 within an item.

    Items within the limit give one piece (none with ``keep_small=False``); null and empty texts and
    null ids give none; a null section stays null. Repeated rows count once; an id given with several
    texts gives the pieces of each, told apart by ``version`` (a hash of text and section). Pieces are
    computed where the rows are read; only pieces are exchanged, to drop repeats.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    items = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(section_col).alias("section"), F.xxhash64(F.col(text_col), F.col(section_col)).alias("version"), F.col(text_col).alias("text")
    )
    if not keep_small:  # composing can shorten a text; it lengthens none beyond three times its size
        items = items.where(F.length("text") * 3 > limit)
    pieces = items.mapInArrow(_run(limit, overlap, keep_small), f"id {kind}, section string, version long, seq int, begin int, end int, text string")
    return pieces.dropDuplicates(["id", "version", "seq"])
