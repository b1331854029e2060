"""Broken prompt and response pairs.

One pass over the pairs brings every response to a masked form (plain letters, names as ``@``,
numbers as ``#``) and settles what the pair alone shows: nothing said, the question said again, an end
that breaks off in mid-phrase. What it does not show comes from the collection:

* *Openings.* The distinct masked openings are clustered by MinHash of their character 5-shingles
  (32 hashes, 8 bands), all candidates of a band verified at a Jaccard similarity of 0.8, clusters
  closed over chains. A cluster that recurs over unrelated prompts in whole sentences and whose members *inform* of
  nothing, that is, bring neither a number nor a name that the question does not have, is a refusal
  template in whatever language. Phrases of declining settle clusters of few members and responses
  that recur nowhere; "He refused to answer ... and left in 1960" declines, recurs and informs.
* *Ends.* Masked sentences that end with a stop in many responses are templates. A response
  without a stop whose last sentence is the beginning of one, and not itself a usual way to end,
  is truncated.
* *Words.* What belongs to a language is learnt: words common in the questions of that language, and
  words of responses to them of which enough is made of such. A response with few words that
  belong to the language of its question is in another one, known or not.

Counts run over all rows with partial sums; only distinct openings, sentences and words are clustered
or joined, never rows with rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.functions.plainform import plain
from grafonda.operators.components import connected_components
from grafonda.session import materialise

# What stands for an answer that was never given (plain forms).
PLACEHOLDERS = frozenset("n a|na|null|none|nil|nan|undefined|unknown|tbd|todo|trong|empty|khong co|chua co|chua co cau tra loi|no answer|pending|blank|vide|aucune|de trong|answer|response|tra loi|dap an|cau tra loi|reponse|xxx|lorem ipsum".split("|"))
# Labels in front of a repeated question (plain forms).
LABELS = ("cau hoi", "ban hoi", "tra loi", "hoi", "dap", "question", "q", "answer", "a", "reponse", "cau tra loi", "de bai", "noi dung cau hoi")
# Phrases of declining in plain form.
DECLINING = re.compile(
    r"\b(khong the|khong tra loi|khong biet|khong co (du )?(thong tin|du lieu|quyen|dap an|can cu)|khong du (can cu|thong tin|du lieu)|khong duoc phep|xin phep khong|tu choi|xin loi|rat tiec|tiec la"
    r"|chua (tim|the|co thong tin)|ngoai pham vi|em chiu|minh chiu|mo hinh ngon ngu|tro ly|khong chua du|khong ho tro|khong tim (thay|duoc)|khong ro|chiu thoi"
    r"|sorry|unfortunately|can ?not|can t|unable|not able|as an (ai|assistant|language)|nothing i can|do not know|don t know|not allowed|no information|decline"
    r"|desole|regrette|malheureusement|je ne (peux|sais|suis)|impossible|aucune information"
    r"|leider|kann (ich )?nicht|lo siento|no puedo|no se|maaf|tidak (bisa|dapat|tahu))\b"
)
# Articles, pronouns, prepositions, conjunctions, auxiliaries and question words by language, in plain form; they tell the language of a question.
WORDS = {
    "vi": "la cua duoc trong va voi nhung cac mot nay do khi da tu den bang theo co khong vi nen ra sau truoc nguoi bi de lai hon vao thanh nao gi ai giua o tai cho con se phai thi ma nhu hay neu ve ca deu dang cung thuoc bao nhieu sao",
    "en": "the of and a an in to for from with was were is are be been by as at on that which who what it this his her its their not or into after before between did does do why how when where than has have had",
    "fr": "le la les l un une des du de d et en au aux par pour dans sur avec est sont fut ont qui que quel quelle quels dont ce cette ces son sa ses elle il ne pas apres avant ou comment pourquoi combien entre",
    "de": "der die das und von den dem des ein eine einen ist war im in zu nach mit auf fur aus bei sich nicht wer wie was wann wo warum uber als auch oder hat haben wurde",
    "es": "el la los las un una unos de del y en por para con que fue se su sus al no es son como cual quien cuando donde cuanto entre sin sobre pero",
    "id": "yang dan di ke dari pada untuk dengan ini itu adalah oleh mereka tidak dalam apa siapa bagaimana mengapa kapan berapa antara atau telah akan",
}
LANGUAGE = {name: frozenset(words.split()) for name, words in WORDS.items()}
_LANGUAGES_OF = {w: tuple(name for name, known in LANGUAGE.items() if w in known) for known in LANGUAGE.values() for w in known}
# Words after which a sentence goes on (plain forms of words written as listed).
DANGLING = frozenset(
    "và của là do với vì như khi để tại ở từ theo một trong các những được bị đã sẽ mà nên hoặc hay thì bằng cho về giữa đến qua còn nhưng cùng bởi rằng này mỗi vào khoảng the of and a an to in for with by was were is are at from that which who as or on into because while although le la les de du des et un une en au pour par dans avec que qui der die das und von mit el los y del con por yang dan di dengan untuk".split()
)
_NAME = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?。！？]+[\"'”’»)\]]*$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_TAG = re.compile(r"<[^<>]{0,200}>")
_ASIDE = re.compile(r"\([^()]*\)|\"[^\"]*\"|“[^”]*”|«[^»]*»")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d[\d.,]*\d|\d|[,;:()\"“”«»]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_ONSET = re.compile(r"[bcdfghjklmnpqrstvwxz]{1,4}|qu|gi")
_UNITS = frozenset("m km cm mm g kg mg l ml t h s km² m² w kw".split())
_BEFORE_YEAR = frozenset("vào vao khoảng khoang từ tu trong đến den cuối cuoi đầu dau the in about around".split())
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u03ff\u0590-\u06ff\u0900-\u0dff\u0e00-\u0eff\u10a0-\u10ff\u1780-\u17ff]")
_VIETNAMESE = re.compile(r"[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹĩũ]")


@lru_cache(maxsize=200_000)
def plain_word(word: str) -> str:
    return plain(word).replace(" ", "")


def visible(text: str | None) -> str:
    """NFC text without markup tags and invisible characters, blanks collapsed."""
    if not text:
        return ""
    text = unicodedata.normalize("NFC", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isprintable():
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t\r")
    return " ".join(text.split())


def is_empty(shown: str) -> bool:
    return not any(c.isalnum() for c in shown) or plain(shown) in PLACEHOLDERS


_LABELS = tuple(label + " " for label in sorted(LABELS, key=len, reverse=True))


def is_copy(question: str | None, shown: str) -> bool:
    """Whether the words of the answer, labels aside, are those of the question."""
    return _copies(plain(question), plain(shown))


def _copies(question: str, said: str) -> bool:
    asked = question.split()
    if said.startswith(_LABELS):
        label = next(x for x in _LABELS if said.startswith(x))
        said = said if question.startswith(label) else said[len(label) :]
    words = said.split()
    if len(asked) < 3 or not words:
        return False
    a, b = set(asked), set(words)
    shared = len(a & b)
    return shared >= 0.9 * len(b) and shared >= 0.75 * len(a)


def language_of(words: list[str]) -> str | None:
    """Language of a question from its words (`words_of`); where function words do not tell, Vietnamese marks do. None if neither does."""
    bare = [w.rpartition("|")[2] for w in words]
    counts = dict.fromkeys(LANGUAGE, 0)
    for w in bare:
        for name in _LANGUAGES_OF.get(w, ()):
            counts[name] += 1
    for marks in (0, sum(1 for w in words if _VIETNAMESE.search(w))):
        counts["vi"] += marks
        first, second = sorted(counts.values(), reverse=True)[:2]
        if first >= 2 and first > second:
            return max(counts, key=counts.__getitem__)
    return None


def other_script(question: str | None, shown: str) -> bool:
    """Whether the response is written in letters that the question is not."""
    return any(len(p.findall(shown)) > least and not p.search(question or "") for p, least in ((_CJK, 3), (_CYRILLIC, 5), (_OTHER_SCRIPT, 5)))


def has_marks(shown: str) -> bool:
    """Whether at least a quarter of the words that are no names carry marks that only Vietnamese has."""
    words = [w for w in _NAME.findall(shown) if w[0].islower()]
    return 4 * sum(1 for w in words if _VIETNAMESE.search(w)) >= max(len(words), 1)


def masked(sentence: str) -> str:
    """Plain words with runs of names as @ and numbers as #; marks kept as words."""
    return _masked(_TOKEN.findall(sentence))


def _masked(tokens: list[str]) -> str:
    out: list[str] = []
    for i, token in enumerate(tokens):
        if token[0].isdigit():
            word = "#"
        elif token[0].isalpha():
            word = "@" if token[0].isupper() and i else plain_word(token)
        else:
            word = token
        if word == "@" and out and out[-1] == "@":
            continue
        out.append(word)
    # a first word directly before a name belongs to the name, known openers aside
    if len(out) > 1 and out[1] == "@" and out[0].isalpha() and out[0] not in _LANGUAGES_OF:
        out.pop(0)
    return " ".join(out)


def breaks_off(shown: str) -> bool:
    """Whether the end alone shows that the answer goes on."""
    if shown.endswith("…") or shown.endswith("..."):
        return True
    if shown[-1] in ",;:–-—([{“«/&":
        return True
    if _END.search(shown):
        return False
    if shown.count("(") > shown.count(")") or shown.count("“") > shown.count("”") or shown.count("«") > shown.count("»") or shown.count('"') % 2:
        return True
    words = shown.split()
    if len(words) < 2:
        return False
    last, before = words[-1], words[-2]
    if last in DANGLING or (last in ("năm", "nam", "year") and before.lower() in _BEFORE_YEAR):
        return True
    # the beginning of a syllable: consonants only, unless it is a unit behind a number
    return last.isalpha() and last.islower() and bool(_ONSET.fullmatch(plain(last))) and not (before[-1].isdigit() and last in _UNITS)


def informs(question: str, shown: str) -> bool:
    """Whether the response has a number, or names of two words or more, that the question (plain) does not have."""
    return _informs(question, _TOKEN.findall(shown))


def _informs(question: str, tokens: list[str]) -> bool:
    known = set(question.split())
    new = 0
    for i, token in enumerate(tokens):
        if token[0].isdigit():
            if token not in known and not known.issuperset(plain(token).split()):
                return True
        elif i and token[0].isalpha() and token[0].isupper() and len(token) > 1 and plain_word(token) not in known and not known.issuperset(plain(token).split()):
            new += 1
    return new >= 2


_LOCAL = "id string, kind string, local string, opening string, tail string, sentences array<string>, asked array<string>, spoken array<string>, lang string, declines boolean, informs boolean, ended boolean, prompt long, foreign boolean, native boolean, broken boolean"
_COLUMNS = {"local": pa.string(), "opening": pa.string(), "tail": pa.string(), "sentences": pa.list_(pa.string()), "asked": pa.list_(pa.string()), "spoken": pa.list_(pa.string()), "lang": pa.string(), "declines": pa.bool_(), "informs": pa.bool_(), "ended": pa.bool_(), "prompt": pa.int64(), "foreign": pa.bool_(), "native": pa.bool_(), "broken": pa.bool_()}


@lru_cache(maxsize=200_000)
def _with_plain(token: str) -> str:
    word = token.lower()
    return f"{word}|{plain_word(word)}"


def words_of(text: str) -> list[str]:
    """The words of a text that are no names, in lower case, each with its plain form behind a bar."""
    return _words(_TOKEN.findall(text.lower() if text.isupper() else text))


def _words(tokens: list[str]) -> list[str]:
    out = []
    for i, token in enumerate(tokens):
        if not token[0].isalpha() or token[0].isupper() and (i or len(tokens) > 1 and tokens[1][0].isupper()):
            continue
        out.append(_with_plain(token))
    return out


def _local(batches):
    import xxhash

    for batch in batches:
        cols = {c: [] for c in _COLUMNS}
        for question, answer in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist()):
            shown = visible(answer)
            asked, said = plain(question), plain(shown)
            empty = said in PLACEHOLDERS if said else not any(c.isalnum() for c in shown)
            local = "empty" if empty else "copy" if _copies(asked, said) else None
            row = dict.fromkeys(cols)
            row |= {"local": local, "prompt": xxhash.xxh64_intdigest(asked) >> 1}
            if local is None:
                sentences = _SENTENCE.split(shown)
                tokens = [_TOKEN.findall(x) for x in sentences]
                whole = tokens[0] if len(tokens) == 1 else [t for x in tokens for t in x]
                spoken = [_masked(x) for x in tokens]
                words = words_of(unicodedata.normalize("NFC", question or ""))
                row["declines"] = bool(DECLINING.search(said))
                row["informs"] = _informs(asked, whole)
                row["opening"] = " ".join(spoken[0].split()[:8])
                row["asked"] = list(dict.fromkeys(words))
                row["lang"] = language_of(words)
                row["spoken"] = words_of(shown) if shown.isupper() else _words(whole)
                row["foreign"] = other_script(question, shown)
                row["native"] = row["lang"] == "vi" and has_marks(shown)
                row["broken"] = breaks_off(shown)
                row["ended"] = ended = bool(_END.search(shown)) or shown.endswith(")")
                row["sentences"] = list(dict.fromkeys(spoken if ended else spoken[:-1]))
                row["tail"] = None if ended else spoken[-1]
            for c, v in row.items():
                cols[c].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind")] + [pa.array(v, _COLUMNS[c]) for c, v in cols.items()], names=["id", "kind", *cols])


_HASHES, _BANDS = 32, 8


def _shingles(text: str) -> np.ndarray:
    import xxhash

    padded = text if len(text) >= 5 else text.ljust(5)
    return np.unique(np.array([xxhash.xxh64_intdigest(padded[i : i + 5]) for i in range(len(padded) - 4)], np.uint64))


def _bands(batches):
    rng = np.random.Generator(np.random.PCG64(5))
    mix = rng.integers(1, 1 << 63, _HASHES, dtype=np.int64).view(np.uint64) | np.uint64(1)
    for batch in batches:
        texts, keys = batch.column("opening").to_pylist(), []
        for text in texts:
            h = (_shingles(text)[None, :] * mix[:, None]) >> np.uint64(8)
            low = h.min(1).reshape(_BANDS, -1)
            keys.append([hash((b, *row)) for b, row in enumerate(low.tolist())])
        yield pa.RecordBatch.from_arrays([batch.column("opening"), batch.column("prompts"), pa.array(keys, pa.list_(pa.int64()))], names=["opening", "prompts", "bands"])


#: openings of a band compared at once, and shingles looked at together
_TILE, _SPAN = 512, 4096


def _shared(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles in common, every set of `p` with every set of `q`."""
    rows = [np.repeat(np.arange(len(sets)), [len(x) for x in sets]) for sets in (p, q)]
    at = np.unique(np.concatenate([*p, *q]), return_inverse=True)[1]
    columns = at[: len(rows[0])], at[len(rows[0]) :]
    out = np.zeros((len(p), len(q)), np.float32)
    for first in range(0, int(at.max()) + 1, _SPAN):
        sides = []
        for owner, column, sets in zip(rows, columns, (p, q)):
            here = (column >= first) & (column < first + _SPAN)
            side = np.zeros((len(sets), _SPAN if at.max() >= _SPAN else int(at.max()) + 1), np.float32)
            side[owner[here], column[here] - first] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _met(batches):
    """(src, dst): links of two tiles of a band."""
    known = lru_cache(maxsize=50_000)(_shingles)
    for batch in batches:
        out = []
        for left, right, same in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "same"))):
            if not left or not right:
                continue
            p, q = [known(x) for x in left], [known(x) for x in right]
            shared = _shared(p, q)
            alike = shared >= 0.8 * (np.array([len(x) for x in p])[:, None] + np.array([len(x) for x in q])[None, :] - shared)
            # a tile met with itself has every pair twice
            out += [(left[i], right[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(alike))) if not same or left[i] < right[j]]
        cols = list(zip(*out)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["src", "dst"])


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): every distinct opening with its cluster, openings verified to be alike and chains of such.

    `openings` has (opening, prompts). All openings of a band are compared with one another, in tiles
    of about `_TILE` met by separate tasks, so no band is a bottleneck and no pair of one is left out.
    """
    banded = openings.mapInArrow(_bands, "opening string, prompts long, bands array<long>").select("opening", F.explode("bands").alias("band")).distinct()
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / _TILE).alias("parts"))
    placed = materialise(banded.join(sizes, "band").select("opening", "band", "parts", F.pmod(F.xxhash64("opening"), "parts").alias("part")), "banded")
    left = placed.select("band", F.col("part").alias("lo"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("hi"), F.col("opening").alias("l"), F.lit(None).cast("string").alias("r"))
    right = placed.select("band", F.explode(F.sequence(F.lit(0).cast("bigint"), "part")).alias("lo"), F.col("part").alias("hi"), F.lit(None).cast("string").alias("l"), F.col("opening").alias("r"))
    cells = left.unionByName(right).groupBy("band", "lo", "hi").agg(F.collect_list("l").alias("left"), F.collect_list("r").alias("right"))
    links = cells.select("left", "right", (F.col("lo") == F.col("hi")).alias("same")).mapInArrow(_met, "src string, dst string")
    members = connected_components(links.distinct())
    return openings.join(members.select(F.col("node").alias("opening"), "component"), "opening", "left").select("opening", F.coalesce("component", "opening").alias("cluster"))


def foreign_rows(said: DataFrame, least: int = 3, common: float = 0.001, usual: float = 0.1, belongs: float = 0.4, share: float = 0.45, bare: float = 0.7) -> DataFrame:
    """(id, prompt, strange) of rows (id, lang, prompt, asked, spoken, native) whose words do not belong to the language of their question.

    A word belongs to a language if `least` of its questions and a share of `common` of them have it,
    at a rate of a fifth or more of the greatest any language has, if a share of `usual` of the
    responses to them has it, or if it is one of `WORDS`; so do words of at least `least` responses of
    which `belongs` is made of such. A row is foreign if at least `least` words are said of which less
    than `share` belong, and less than `bare` do when marks are left out on both sides. Names and
    numbers are no words; words are given as "word|plain form".
    """
    known = said.where("lang is not null and not native and size(spoken) > 0")
    totals = materialise(said.where("lang is not null").groupBy("lang").agg(F.count_distinct("prompt").alias("total")), "totals")
    rates = said.where("lang is not null").select("lang", "prompt", F.explode("asked").alias("word")).groupBy("lang", "word").agg(F.count_distinct("prompt").alias("n")).join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rates.groupBy("word").agg(F.max("rate").alias("most"))
    asked = rates.join(most, "word").where((F.col("n") >= least) & (F.col("rate") >= common) & (F.col("rate") >= F.col("most") / 5)).select("lang", "word")
    given = said.sparkSession.createDataFrame([(lang, f"{w}|{w}") for lang, some in LANGUAGE.items() for w in sorted(some)], "lang string, word string")
    texts = materialise(known.groupBy("lang", "spoken").agg(F.count_distinct("prompt").alias("n")), "spoken")
    words = texts.select("lang", "spoken", "n", F.explode(F.array_distinct("spoken")).alias("word"))
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "lang").where(F.col("n") >= usual * F.col("total")).select("lang", "word")
    asked = materialise(asked.union(given).union(often).distinct(), "asked")

    def measured(native: DataFrame) -> DataFrame:
        hit = words.join(native.withColumn("own", F.lit(1)), ["lang", "word"], "left")
        return hit.groupBy("lang", "spoken").agg(F.count("*").alias("words"), F.count("own").alias("own"))

    fitting = measured(asked).where((F.col("words") >= least) & (F.col("own") >= belongs * F.col("words"))).select("lang", "spoken")
    learnt = words.join(fitting, ["lang", "spoken"], "left_semi").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "word")
    native = materialise(asked.union(learnt).distinct(), "native")
    odd = materialise(measured(native).where((F.col("words") >= least) & (F.col("own") < share * F.col("words"))).select("lang", "spoken"), "odd")
    # what is left over is few; it is looked at once more without marks
    plainly = lambda c: F.substring_index(c, "|", -1)
    hit = odd.select("lang", "spoken", F.explode(F.array_distinct("spoken")).alias("word")).select("lang", "spoken", plainly("word").alias("word")).join(native.select("lang", plainly("word").alias("word")).distinct().withColumn("own", F.lit(1)), ["lang", "word"], "left")
    foreign = hit.groupBy("lang", "spoken").agg(F.count("*").alias("words"), F.count("own").alias("own")).where(F.col("own") < bare * F.col("words")).select("lang", "spoken")
    return known.join(foreign, ["lang", "spoken"], "left_semi").select("id", "prompt").distinct().withColumn("strange", F.lit(True))


def broken_pairs(
    rows: DataFrame,
    id_col: str = "qa_id",
    question_col: str = "question",
    answer_col: str = "answer",
    kind_col: str = "question_type",
    unanswerable: str = "unanswerable",
    recurring: int = 3,
) -> DataFrame:
    """(id, defect): one row per defective id; defect is empty, copy, refusal, truncated or language, the first that holds.

    A null answer is empty; a null or empty question can be neither copied nor compared in language;
    refusals to `unanswerable` questions are right. Null ids are left out, repeated rows count once,
    an id with several answers is judged by each and gives its first defect; texts are read whole;
    other columns are ignored; an empty table gives no row.
    """
    pairs = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer"), F.col(kind_col).alias("kind")).distinct()
    seen = materialise(pairs.mapInArrow(_local, _LOCAL), "pairs")
    said = seen.where("local is null")
    per_prompt = said.groupBy("opening", "prompt").agg(*(F.max(c).alias(c) for c in ("declines", "informs", "ended")), F.min(F.get("asked", F.lit(0))).alias("first"))
    openings = materialise(
        per_prompt.groupBy("opening").agg(F.count("*").alias("prompts"), F.count_distinct("first").alias("firsts"), *(F.count_if(c).alias(c) for c in ("declines", "informs", "ended"))),
        "openings",
    )
    members = opening_clusters(openings.select("opening", "prompts"))
    clusters = materialise(openings.join(members, "opening"), "clusters")
    n, declining, informing = F.col("n"), F.col("d"), F.col("i")
    # many unrelated prompts, whole sentences of three words or more, and nothing said: a refusal, whatever its words
    silent = (n >= 2 * recurring) & (F.col("firsts") >= recurring) & (informing < 0.1 * n) & (F.col("e") >= 0.5 * n) & (F.col("longest") >= 3)
    templates = (
        clusters.groupBy("cluster")
        .agg(F.sum("prompts").alias("n"), F.sum("declines").alias("d"), F.sum("informs").alias("i"), F.sum("ended").alias("e"), F.max("firsts").alias("firsts"), F.max(F.size(F.filter(F.split("opening", " "), lambda w: w.rlike("^[a-z]")))).alias("longest"))
        .select("cluster", F.when((n >= recurring) & (declining >= 0.6 * n) & (informing < 0.3 * n), "refusal").when(silent, "refusal").when((n >= recurring) & ((declining < 0.3 * n) | (informing >= 0.3 * n)), "statement").alias("template"))
        .where("template is not null")
    )
    # rows only meet the few openings that decline; others need no label
    label = clusters.select("opening", "cluster").join(templates, "cluster").select("opening", "template")
    labelled = label.where("template = 'refusal'").unionByName(label.where("template = 'statement'").join(clusters.where("declines > 0").select("opening"), "opening", "left_semi"))

    full = said.select("prompt", F.explode("sentences").alias("sentence")).distinct().groupBy("sentence").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * recurring)
    words = F.split("sentence", " ")
    starts = (
        full.withColumn("words", words)
        .select("n", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("k"))
        .select(F.array_join(F.slice("words", 1, F.col("k") - 1), " ").alias("start"), F.element_at("words", F.col("k")).alias("next"), (F.col("k") < F.size("words")).alias("inner"), "n")
        .groupBy("start", "next")
        .agg(F.sum("n").alias("n"), F.max("inner").alias("inner"))
    )
    tails = said.where("tail is not null").groupBy("tail").agg(F.count_distinct("prompt").alias("m"))
    split = tails.select("tail", "m", F.regexp_extract("tail", r"^(.*?) ?[^ ]*$", 1).alias("start"), F.regexp_extract("tail", r"([^ ]*)$", 1).alias("part"))
    begun = split.join(starts, "start").where(F.expr("startswith(next, part)") & (F.col("inner") | (F.col("next") != F.col("part"))))
    whole = full.select(F.col("sentence").alias("tail"))
    cut = (
        begun.where(F.size(F.split("tail", " ")) >= 3).groupBy("tail", "m").agg(F.sum("n").alias("n")).where("m < 0.05 * n").join(whole, "tail", "left_anti").select("tail", F.lit(True).alias("cut"))
    )
    strange = foreign_rows(said)
    judged = said.join(labelled, "opening", "left").join(cut, "tail", "left").join(strange, ["id", "prompt"], "left").withColumn("foreign", F.col("foreign") | F.coalesce("strange", F.lit(False)))
    refuses = (F.coalesce("kind", F.lit("")) != unanswerable) & ((F.col("template") == "refusal") | (F.col("template").isNull() & F.col("declines") & ~F.col("informs")))
    no_answer = (F.col("kind") == unanswerable) & ((F.col("template") == "refusal") | F.col("declines"))
    found = judged.select(
        "id",
        F.when(F.coalesce(refuses, F.lit(False)), "refusal")
        .when(F.coalesce(no_answer, F.lit(False)) & ~F.col("broken"), F.lit(None))
        .when(F.col("foreign") & ~F.col("broken") & F.col("cut").isNull(), "language")
        .when(F.col("broken") | F.coalesce("cut", F.lit(False)), "truncated")
        .when(F.col("foreign"), "language")
        .alias("defect"),
    )
    defects = found.unionByName(seen.where("local is not null").select("id", F.col("local").alias("defect"))).where("defect is not null")
    rank = F.array_position(F.array(*map(F.lit, ("empty", "copy", "refusal", "truncated", "language"))), F.col("defect"))
    return defects.groupBy("id").agg(F.min_by("defect", rank).alias("defect"))
