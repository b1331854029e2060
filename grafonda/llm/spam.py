"""Filler pages: strung-together keyword phrases, links and product tags.

A text is a sequence of terms. For every content term the *recurrence gap* to its nearest other
occurrence is taken, and for every lag of a window the *positional autocorrelation*, the share of
places whose term stands again exactly that many terms later. Sentences repeat function words, but
their content terms come back rarely and at irregular distances; keyword lists bring the same terms
back within a few places, product rows at a fixed lag. Lists of ever new nouns show neither and are
recognised by what they lack: function words over a long stretch. Link lists are recognised by the
share of addresses. Each place is judged from the window around it, lines follow their majority, and
a document is filler if more than half of its characters are.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that carry sentences (Vietnamese with and without marks, English, French).
FUNCTION_WORDS = frozenset(
    """
    là của được trong và với những các một này đó khi đã từ đến bằng theo có không nhưng vì nên ra sau trước người
    mình rằng bị để lại hơn gần khoảng chủ về vào nằm thành hai ba tư năm nơi giữa trên dưới bởi nhờ do mà thì
    đang sẽ rất cũng vẫn đều chỉ phải khiến khỏi nhiều mỗi qua cùng số ít phần lớn lần đầu ông bà họ nó sinh mất sống làm
    cua duoc trong va voi nhung cac mot nay khi bang theo khong nguoi rang lai hon khoang vao thanh truoc giua tren duoi phai khien khoi nhieu cung so it phan lon lan dau
    the of and a in to for from with was were is are be been by at as which who its it this these their his
    her has had have not but or into when while after before during between about only also than nearly every until
    le la les un une des du de et en au aux par pour dans sur avec est sont était fut ont été qui que dont ce cette ces
    son sa ses il elle ils se ne pas plus entre après avant où leur
    """.split()
)
# Words that open the category lines of an article.
_HEAD_WORDS = frozenset("thể loại the loai category categories catégorie catégories".split())
_TERM = re.compile(r"#\w+|https?://[^\s)\]\"'<>]+|www\.[^\s)\]\"'<>]+|\w[\w-]*(?:\.[\w-]+)*\.[a-z]{2,10}\b(?:/[^\s)\]\"'<>]*)?|\w+|\n|[^\w\s]")
_LINK = re.compile(r"https?:|www\.|[^\W_][\w-]*(?:\.[\w-]+)*\.[a-z]{2,10}(?:/|$)")
_OTHER_LETTERS = re.compile(r"[^\W\d_\u0041-\u024f\u1e00-\u1eff\u0300-\u036f]")
_NEAR, _WINDOW, _LAGS, _ALONE, _ECHO = 24, 20, 16, 14, 9
_WORD, _FUNCTION, _ADDRESS, _BREAK, _MARK, _LONG = 1, 2, 4, 8, 16, 32


class Terms:
    """Numbers of terms, with kind and length; forgets when it has grown large (memory stays bounded, results do not change)."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.kind: list[int] = []
        self.length: list[int] = []

    def of(self, term: str) -> int:
        at = self.number[term] = len(self.kind)
        if term == "\n":
            kind, size = _BREAK, 0
        elif len(term) > 2 and term[0] == "#":
            kind, size = _ADDRESS, len(term)
        elif not (term[0].isalnum() or term[0] == "_"):
            kind, size = _MARK, len(term)
        elif "." in term and _LINK.match(term):
            kind, size = _ADDRESS, len(term)
        else:
            kind, size = _WORD, len(term)
            if term in FUNCTION_WORDS:
                kind |= _FUNCTION
            elif size > 14 or _OTHER_LETTERS.search(term):
                kind |= _LONG
        self.kind.append(kind)
        self.length.append(size)
        return at

    def read(self, text: str) -> list[int]:
        known, make = self.number, self.of
        return [known[t] if t in known else make(t) for t in _TERM.findall(text)]


def _around(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.float64)))
    return total[high] - total[low]


def filler_share(texts: list[str], terms: Terms) -> np.ndarray:
    """Share of the characters of each text (blanks aside) that stand in filler."""
    out = np.zeros(len(texts))
    if len(terms.kind) > terms.limit:
        terms.clear()
    lists = [terms.read(unicodedata.normalize("NFC", t).lower()) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    if not sizes.sum():
        return out
    ids = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    kind, length = np.array(terms.kind)[ids], np.array(terms.length, np.float64)[ids]
    doc = np.repeat(np.arange(len(texts)), sizes)
    everything = np.bincount(doc, length, len(texts))
    # gaps and lags are counted in words and addresses, marks and breaks left out
    body = np.flatnonzero(kind & (_WORD | _ADDRESS))
    if not len(body):
        return out
    t, d, kd, ln = ids[body], doc[body], kind[body], length[body]
    # numbers and addresses are one term each, so that rows differing only in them agree
    digit = np.fromiter((x[0].isdigit() for x in terms.number), bool, len(terms.number))
    t = np.where(kd & _ADDRESS, -1, np.where(digit[t], -2, t))
    n = len(t)
    at = np.arange(n)
    order = np.lexsort((at, t, d))
    gap = np.full(n, 1 << 30)
    since = np.full(n, 1 << 30)
    same = (t[order][1:] == t[order][:-1]) & (d[order][1:] == d[order][:-1])
    between = np.diff(order)
    a, b = order[1:][same], order[:-1][same]
    gap[a] = since[a] = between[same]
    gap[b] = np.minimum(gap[b], between[same])
    start = np.searchsorted(d, np.arange(len(texts)))[d]
    stop = np.searchsorted(d, np.arange(len(texts)), side="right")[d]
    # a line of its own length is judged by itself, short lines together with their neighbours
    row = (np.cumsum((kind & _BREAK) > 0) + doc)[body]
    head, tail = np.searchsorted(row, row), np.searchsorted(row, row, side="right")
    alone = tail - head >= _ALONE
    low = np.maximum(np.where(alone, head, start), at - _WINDOW)
    high = np.minimum(np.where(alone, tail, stop), at + _WINDOW + 1)
    width = high - low
    function = (kd & _FUNCTION) > 0
    content = ~function
    near = content & (gap <= _NEAR)
    n_content = np.maximum(_around(content, low, high), 1)
    recurring = _around(near, low, high) / n_content
    lag_best = np.zeros(n)
    for lag in range(1, _LAGS + 1):
        hit = np.zeros(n, bool)
        hit[:-lag] = (t[lag:] == t[:-lag]) & (d[lag:] == d[:-lag]) & content[:-lag]
        np.maximum(lag_best, _around(hit, low, high) / width, out=lag_best)
    # a function word back within a few places is part of a product's name ("giay do; giay do")
    functional = _around(function & (since > _ECHO), low, high) / width
    distinct = _around(function & (since > _WINDOW), low, high) / width
    # words run together hide their function words, and those of other scripts are not listed: windows of such are not judged by the lack of them
    joined = _around((kd & _LONG) > 0, low, high) / width
    weight = np.maximum(_around(ln, low, high), 1)
    linked = _around(np.where(kd & _ADDRESS, ln, 0), low, high) / weight
    repeats = (recurring > 0.5) & ((functional < 0.08) | (distinct < 0.055)) & (joined < 0.2)
    regular = (lag_best > 0.3) & (functional < 0.1)
    nouns = (functional < 0.03) & (joined < 0.15) & (width > 12)
    links = linked > 0.4
    filler = repeats | regular | nouns | links
    # back to all terms, then line by line
    line = np.cumsum((kind & _BREAK) > 0) + doc
    mask = np.zeros(len(ids))
    mask[body] = filler
    lines = line[-1] + 1
    body_weight = np.where(kind & (_WORD | _ADDRESS), length, 0.0)
    bad, total = np.bincount(line, mask * body_weight, lines), np.bincount(line, body_weight, lines)
    first = np.searchsorted(line, np.arange(lines))
    short = total < 200
    share = np.where(total > 0, bad / np.maximum(total, 1), 0)
    share = np.where(short, np.where(share > 0.5, 1.0, 0.0), share)
    share[_furniture(ids, kind, first, len(ids), terms)] = 0
    return np.bincount(doc, share[line] * length, len(texts)) / np.maximum(everything, 1)


def _furniture(ids, kind, first, n, terms) -> np.ndarray:
    """Lines that belong to an article without being sentences: headings, stubs, references, categories."""
    name = {i: t for t, i in terms.number.items() if t in ("=", "#", "*", "[", "{", ":") or t in _HEAD_WORDS}
    start = first + (kind[np.minimum(first, n - 1)] == _BREAK)
    get = lambda k: np.array([name.get(i, "") for i in ids[np.minimum(start + k, n - 1)]], object)
    one, two, three = get(0), get(1), get(2)
    heading = (one == "=") & (two == "=")
    stub = (one == "{") & (two == "{")
    reference = np.isin(one, ["#", "*"]) & (two == "[")
    category = ((one == "[") & (two == "[")) | ((two == ":") & np.isin(one, ["category", "categories", "catégorie", "catégories"])) | ((three == ":") & (((one == "thể") & (two == "loại")) | ((one == "the") & (two == "loai"))))
    return heading | stub | reference | category


def _run():
    def run(batches):
        terms = Terms()
        for batch in batches:
            if batch.num_rows:
                texts = [x or "" for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(filler_share(texts, terms))], names=["id", "share"])

    return run


def filler_pages(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", above: float | None = 0.5) -> DataFrame:
    """(id, share): documents of whose text more than `above` is filler; with None every document and its share.

    Null and empty texts have share 0; null ids are left out; repeated rows of an id give one row
    with the largest share; texts of any length are read whole; other columns are ignored; an empty
    table gives no row. One pass over the rows and one exchange of flagged ids, no other.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    shares = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_run(), f"id {kind}, share double")
    if above is not None:
        shares = shares.where(F.col("share") > above)
    return shares.groupBy("id").agg(F.max("share").alias("share"))
