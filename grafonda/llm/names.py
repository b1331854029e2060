"""Variant spellings of names linked to the entities of a registry.

Mentions and registry names are reduced to *forms* (plain tokens, the same with marks, and which were
cut short by a full stop), and every distinct form is read once, as it stands and with titles taken
off. Forms are settled in three steps, each over the forms that the steps before left open; the steps
follow the order in which readings are preferred, so that a later step cannot change an earlier result.

1. *Equal*: the same letters run together, or the same tokens in another order.
2. *Mistyped*: a *symmetric-delete index* (what is left without one character) over whole names run
   together, and over each token beside the sorted rest of its name, holds every name one edit away.
3. *Shortened*: every such reading has one token in common with its name as written, so the index of
   tokens finds it. Of the names that share a token only those are aligned which can explain all
   other tokens but one (initials, abbreviations), or whose letters allow for two edits.

Aligning assigns the form's tokens to the name's tokens: equal tokens first, then the cheapest
assignment of the rest, a token standing for a mistyped token, a short form or nickname of one, or the
initials of several. What the form leaves out must be a kind of thing ("province"), a family name or a
middle name. The best alignment wins if it is one entity's alone.
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
from grafonda.session import materialise, tasks_for

# Words that say what kind of thing a name names (plain form).
KINDS = tuple(
    tuple(k.split())
    for k in (
        "cong ty co phan|cong ty tnhh|cong ty|ngan hang|hop tac xa|cau lac bo|benh vien da khoa|benh vien|truong dai hoc|dai hoc|vien nghien cuu|vien|bao tang|nha xuat ban|hoi khuyen hoc|hoi"
        "|lien doan|tap doan|thanh pho|tinh|huyen|quan|thi tran|thi xa|xa|phuong|hoi uc|bai ca|truyen|chuyen|khuc|loi|tac pham"
    ).split("|")
)
# Titles in front of a name (plain form).
TITLES = tuple(
    tuple(t.split())
    for t in (
        "ong|ba|cu|thay|co|anh|chi|bac|chu|ngai|gs|pgs|ts|ths|bs|ks|pgs ts|gs ts|giao su|pho giao su|tien si|thac si|bac si|ky su|luat su|nha van|nha tho|nha bao|nha giao|nha su hoc|nghe nhan|nghe si|nhac si|hoa si"
        "|tac pham|cuon|cuon sach|bai tho|tap tho|dong chi|vien bao tang|mr|mrs|ms|dr|prof"
    ).split("|")
)
# Given names and what people call them.
NICKNAMES = {
    "robert": "bob bobby rob robbie", "william": "bill billy will willie", "richard": "dick rick ricky rich", "james": "jim jimmy jamie", "john": "jack johnny", "michael": "mike mickey mick", "elizabeth": "liz lizzie beth betty eliza",
    "margaret": "maggie meg peggy", "katherine": "kate katie kathy", "catherine": "kate cathy", "thomas": "tom tommy", "charles": "charlie chuck", "edward": "ed eddie ted ned", "joseph": "joe joey", "daniel": "dan danny", "david": "dave davy",
    "christopher": "chris kit", "anthony": "tony", "andrew": "andy drew", "alexander": "alex sandy sasha", "alexandra": "alex sandra", "benjamin": "ben benny", "samuel": "sam sammy", "matthew": "matt", "nicholas": "nick", "patrick": "pat paddy",
    "patricia": "pat patty trish", "jennifer": "jen jenny", "rebecca": "becky", "susan": "sue susie", "deborah": "deb debbie", "theodore": "ted teddy", "henry": "harry hank", "francis": "frank", "frederick": "fred freddie", "gerald": "gerry jerry",
    "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny", "ronald": "ron ronnie", "steven": "steve", "stephen": "steve", "timothy": "tim", "victoria": "vicky tori", "walter": "walt wally", "dorothy": "dot dolly",
}
_CALLED = {(short, full) for full, shorts in NICKNAMES.items() for short in shorts.split()}
_SHORTS = {short for short, _ in _CALLED}
_SPLIT = re.compile(r"[^\W_]+\.?")


@lru_cache(maxsize=200_000)
def tokens_of(text: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[bool, ...]]:
    """Plain tokens, the same tokens with marks (NFC, lower case), and whether each was cut short by a full stop."""
    out, marked, short = [], [], []
    for m in _SPLIT.findall(unicodedata.normalize("NFC", text)):
        word = plain(m)
        if word:
            out.append(word.replace(" ", ""))
            marked.append(m.rstrip(".").lower())
            short.append(m.endswith(".") or (len(m) > 1 and m.isupper() and len(m) < 5))
    return tuple(out), tuple(marked), tuple(short)


def form_of(text: str) -> str:
    """The form as text: tokens with marks, a full stop behind those cut short; reads back as the same tokens."""
    return " ".join(m + "." if short else m for _, m, short in zip(*tokens_of(text)))


def deletes(token: str) -> set[str]:
    """The token and what is left of it without one character (tokens of one character stay whole)."""
    return {token} | ({token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) > 2 else set())


_ALL = (1 << 64) - 1


@lru_cache(maxsize=500_000)
def _letters(word: str) -> int:
    """The letters of a word and, 32 bits higher, those it holds twice; one edit changes at most two of these bits."""
    once = twice = 0
    for c in word:
        bit = 1 << (ord(c) & 31)
        twice |= once & bit
        once |= bit
    out = once | twice << 32
    return out - (1 << 64) if out >> 63 else out


@lru_cache(maxsize=500_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance (insertions, deletions, substitutions, neighbour swaps), most + 1 if beyond."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or ((_letters(a) ^ _letters(b)) & _ALL).bit_count() > 2 * most:
        return most + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def kind_of(tokens: tuple[str, ...]) -> int:
    """How many leading tokens say what kind of thing is named."""
    for k in KINDS:
        if tokens[: len(k)] == k and len(tokens) > len(k):
            return len(k)
    return 0


_BY_LENGTH = sorted(TITLES, key=len, reverse=True)


def readings(tokens, marked, short):
    """The form as it stands and after taking off one title after another ("cụ" is a title, "Cù" a family)."""
    out = [(tokens, marked, short)]
    while len(tokens) > 1 and len(out) < 4:
        title = next((t for t in _BY_LENGTH if tokens[: len(t)] == t and len(tokens) > len(t)), None)
        if title is None:
            break
        k = 1 if title == ("vien", "bao", "tang") else len(title)
        tokens, marked, short = tokens[k:], marked[k:], short[k:]
        out.append((tokens, marked, short))
    return out


EXACT, TYPED, SHORT, TYPED_TWICE, LEFT_OUT = range(5)


def align(form: str, name: str) -> tuple[int, float] | None:
    """(tier, cost) of the best way to read `form` as `name`; None if there is none."""
    return _best(readings(*tokens_of(form)), name)


def _best(ways, name: str) -> tuple[int, float] | None:
    n, n_marked, _ = tokens_of(name)
    best = None
    for m, marked, short in ways:
        found = _align(m, marked, short, n, n_marked)
        if found and (best is None or found < best):
            best = found
    return best


def _align(m, marked, short, n, n_marked):
    if not m or not n:
        return None
    jm, jn = "".join(m), "".join(n)
    digits = any(c.isdigit() for c in jn)
    if jm == jn or sorted(m) == sorted(n):
        return EXACT, _mark_gap(marked, n_marked)
    if digits:
        return None
    apart = edits(jm, jn, 2)
    agree = _marks_agree(m, marked, n, n_marked)
    if apart == 1 and len(jn) >= 5:
        return (TYPED, 1.0) if agree else None
    free = list(n)
    rest = []
    for i, t in enumerate(m):
        if t in free and not (short[i] and len(t) == 1):
            free[free.index(t)] = ""
        else:
            rest.append(i)
    full = len(m) - len(rest)
    twice = (TYPED_TWICE, 2.0) if agree and apart == 2 and len(jn) >= 10 and full >= 1 else None
    if not full or len(rest) > 4:
        return None
    cost, typed, abbreviated = 0.0, 0, 0
    if rest:
        pick = _assign([(m[i], short[i]) for i in rest], free)
        if pick is None:
            return twice
        cost, typed, abbreviated, free = pick
    left = [i for i, t in enumerate(free) if t]
    if typed >= 2:
        return twice
    if not left:
        if abbreviated:
            # initials count only beside a word written out that is not just a kind
            core = n[kind_of(n) :]
            if not agree or not any(len(t) > 1 and t in core for t in m):
                return twice
            return SHORT, cost + _gap_of_equal(m, marked, n, n_marked)
        return (TYPED, cost) if agree else None
    # something is left out
    if not agree or (typed and full < 2) or full + typed + abbreviated < 2 or not _may_leave(left, n):
        return twice
    return LEFT_OUT, cost + len(left) + typed


def _may_leave(left: list[int], n: tuple[str, ...]) -> bool:
    kind = kind_of(n)
    if kind:
        return set(left) <= set(range(kind))
    if len(n) < 3:
        return False
    # a person's family name, or middle names; the given name stays
    return left == [0] or (0 not in left and len(n) - 1 not in left)


def _marks_agree(m, marked, n, n_marked) -> bool:
    """A form written with marks has the marks of the name on the tokens both share."""
    if all(a == b for a, b in zip(m, (plain_d(x) for x in marked))) and all(x == plain_d(x) for x in marked):
        return True
    have = set(n_marked)
    plain_names = set(n)
    return all(x in have for t, x in zip(m, marked) if t in plain_names and len(t) > 1)


@lru_cache(maxsize=100_000)
def plain_d(word: str) -> str:
    return plain(word).replace(" ", "")


def _mark_gap(marked, n_marked) -> float:
    return 0.0 if sorted(marked) == sorted(n_marked) else 0.1


def _gap_of_equal(m, marked, n, n_marked) -> float:
    return 0.1 * sum(1 for x in marked if x not in n_marked)


def _options(t: str, short: bool, free: list[str]):
    """Ways to read one token: (cost, typed, abbreviated, places)."""
    out = []
    for j, x in enumerate(free):
        if not x:
            continue
        if (short or len(t) == 1) and len(t) < len(x) and x.startswith(t):
            out.append((0.2, 0, 1, (j,)))
        elif (t, x) in _CALLED or _letters_of(t, x):
            out.append((0.25, 0, 1, (j,)))
        elif len(x) >= 3 and len(t) >= 2 and abs(len(x) - len(t)) <= 1 and edits(t, x, 1) == 1:
            out.append((1.0, 1, 0, (j,)))
        elif len(x) >= 5 and len(t) >= 4 and edits(t, x, 2) == 2:
            out.append((2.0, 2, 0, (j,)))
        if len(t) >= 2 and x[0] == t[0]:
            k = j
            while k - j < len(t) and k < len(free) and free[k] and free[k][0] == t[k - j]:
                k += 1
            if k - j == len(t):
                out.append((0.3, 0, 1, tuple(range(j, k))))
    return out


def _letters_of(t: str, x: str) -> bool:
    """Whether t is a long word's beginning with letters left out behind it ("intl", "dept")."""
    if not (3 <= len(t) <= len(x) // 2 and len(x) >= 8 and t[0] == x[0]):
        return False
    rest = iter(x)
    return all(c in rest for c in t)


def _assign(rest: list[tuple[str, bool]], free: list[str]):
    """Cheapest assignment of the remaining tokens to free name tokens, initials of runs included; two typing errors stay in order."""
    ways = [_options(t, short, free) for t, short in rest]
    if not all(ways):
        return None
    best = None

    def follow(i, used, cost, typed, abbreviated, last, picked):
        nonlocal best
        if best is not None and cost >= best[0]:
            return
        if i == len(ways):
            if typed < 2 or picked == sorted(picked):
                best = (cost, typed, abbreviated, used)
            return
        for c, t, a, places in ways[i]:
            if not used.intersection(places):
                follow(i + 1, used.union(places), cost + c, typed + t, abbreviated + a, places[0], picked + [places[0]])

    follow(0, frozenset(), 0.0, 0, 0, -1, [])
    if best is None:
        return None
    return best[0], best[1], best[2], ["" if j in best[3] else x for j, x in enumerate(free)]


def _forms(batches):
    for batch in batches:
        forms = [form_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forms, pa.string())], names=["id", "form"])


def _hashes(keys: list[str]) -> pa.Array:
    import xxhash

    return pa.array(np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys)).view(np.int64))


def _equal_keys(titles: bool):
    """(form, marks, key): the readings run together and in sorted order."""

    def run(batches):
        for batch in batches:
            form, marks, keys = [], [], []
            for f in batch.column("form").to_pylist():
                whole = tokens_of(f)
                for m, marked, _ in readings(*whole) if titles else [whole]:
                    if m:
                        spelt = " ".join(sorted(marked))
                        for k in {"=" + "".join(m), "<" + " ".join(sorted(m))}:
                            form.append(f), marks.append(spelt), keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(marks, pa.string()), _hashes(keys)], names=["form", "marks", "key"])

    return run


def _near_keys(titles: bool):
    """(form, key): what one deletion leaves of the readings run together, and of each token beside the sorted others."""

    def run(batches):
        for batch in batches:
            form, keys = [], []
            for f in batch.column("form").to_pylist():
                whole, mine = tokens_of(f), set()
                for m, _, _ in readings(*whole) if titles else [whole]:
                    mine.update("=" + d for d in deletes("".join(m)))
                    for i, t in enumerate(m):
                        if len(m) > 1 and len(t) > 1:
                            others = " ".join(sorted(m[:i] + m[i + 1 :])) + "~"
                            mine.update(others + d for d in deletes(t))
                form += [f] * len(mine)
                keys += mine
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), _hashes(keys)], names=["form", "key"])

    return run


def _token_keys(titles: bool):
    """(form, token, tokens, size, letters, written, firsts, initials): a row for every token a reading can have in common with another."""

    def run(batches):
        for batch in batches:
            rows = []
            for f in batch.column("form").to_pylist():
                whole = tokens_of(f)
                for m, _, short in readings(*whole) if titles else [whole]:
                    joined, initials = "".join(m), "".join(t[0] for t in m)
                    # a full stop says that a token may stand for one it does not resemble
                    shown = [{"t": t + "." if titles and (cut or t in _SHORTS) else t, "l": _letters(t)} for t, cut in zip(m, short)]
                    written = _letters("".join(x["t"] for x in shown if not x["t"].endswith(".")))
                    for t in set(m):
                        rows.append((f, t, shown, len(joined), _letters(joined), written, _letters(initials), initials))
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.string(), pa.string(), pa.list_(pa.struct([("t", pa.string()), ("l", pa.int64())])), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["form", "token", "tokens", "size", "letters", "written", "firsts", "initials"])

    return run


def _aligned(tiers: tuple[int, ...]):
    """(form, entity, tier) of forms with candidates (name, entity): the best alignment; no entity where several are as good, no row where none fits."""

    def run(batches):
        for batch in batches:
            out = []
            for form, some in zip(batch.column("form").to_pylist(), batch.column("candidates").to_pylist()):
                best, who, tried, ways = None, set(), {}, readings(*tokens_of(form))
                for c in some:
                    name = c["name"]
                    r = tried[name] if name in tried else tried.setdefault(name, _best(ways, name))
                    if r is None or r[0] not in tiers:
                        continue
                    r = (r[0], round(r[1], 3))
                    if best is None or r < best:
                        best, who = r, {c["entity"]}
                    elif r == best:
                        who.add(c["entity"])
                if best:
                    out.append((form, next(iter(who)) if len(who) == 1 else None, best[0]))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], batch.column("candidates").type.value_type.field("entity").type), pa.array(cols[2], pa.int32())], names=["form", "entity", "tier"])

    return run


#: registry names up to which their indexes travel to the forms instead of meeting them in an exchange
INDEX_BROADCAST = 100_000


def registry_names(registry: DataFrame, id_col: str = "entity_id", name_col: str = "canonical_name", alias_col: str = "aliases") -> DataFrame:
    """(entity, name): every distinct name and alias of every entity."""
    both = registry.select(F.col(id_col).alias("entity"), F.array_append(F.coalesce(F.col(alias_col), F.array().cast("array<string>")), F.col(name_col)).alias("names"))
    return both.where("entity is not null").select("entity", F.explode("names").alias("name")).where("name is not null").distinct()


def link_names(
    mentions: DataFrame,
    registry: DataFrame,
    id_col: str = "mention_id",
    text_col: str = "text",
    entity_col: str = "entity_id",
    name_col: str = "canonical_name",
    alias_col: str = "aliases",
) -> DataFrame:
    """(id, entity, tier): mentions with the one entity whose name or alias they spell.

    Null ids and null, empty or letterless texts are linked to nothing, nor are texts that several
    entities explain equally well; repeated rows of an id count once; an id given with several texts
    is linked by each of them; null or empty registry names are skipped; other columns are ignored;
    empty tables give no row.
    """
    kind, key = mentions.schema[id_col].dataType.simpleString(), registry.schema[entity_col].dataType.simpleString()
    shown = mentions.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    who = materialise(shown.mapInArrow(_forms, f"id {kind}, form string").where("form <> ''"), "mentions")
    given = registry_names(registry, entity_col, name_col, alias_col).select(F.col("entity").alias("id"), F.col("name").alias("text"))
    names = materialise(given.mapInArrow(_forms, f"id {key}, form string").where("form <> ''").select(F.col("form").alias("name"), F.col("id").alias("entity")).distinct(), "names")
    small = names.limit(INDEX_BROADCAST + 1).count() <= INDEX_BROADCAST
    near = F.broadcast if small else (lambda df: df)
    spelt = names.select(F.col("name").alias("form")).distinct()
    schema = f"form string, entity {key}, tier int"

    # reading and aligning forms is heavy for its bytes, so it is spread by rows
    spread = lambda df, per_task: df.repartition(tasks_for(df.sparkSession, who.count(), per_task), "form")
    forms = materialise(spread(who.select("form"), 100_000).distinct(), "forms")
    index = spelt.mapInArrow(_equal_keys(False), "form string, marks string, key long").select(F.col("form").alias("name"), F.col("marks").alias("name_marks"), "key").join(names, "name")
    met = forms.mapInArrow(_equal_keys(True), "form string, marks string, key long").join(near(index), "key")
    ways = met.groupBy("form").agg(F.array_sort(F.collect_set(F.struct(F.when(F.col("marks") == F.col("name_marks"), 0).otherwise(1).alias("cost"), "entity"))).alias("w"))
    same = F.array_distinct(F.transform(F.filter("w", lambda x: x["cost"] == F.col("w")[0]["cost"]), lambda x: x["entity"]))
    equal = materialise(ways.select("form", F.when(F.size(same) == 1, same[0]).alias("entity"), F.lit(EXACT).alias("tier")), "equal")

    open_ = materialise(forms.join(equal.select("form"), "form", "left_anti"), "open")
    index = spelt.mapInArrow(_near_keys(False), "form string, key long").select(F.col("form").alias("name"), "key").join(names, "name")
    met = open_.mapInArrow(_near_keys(True), "form string, key long").join(near(index), "key")
    met = spread(met.select("form", "name", "entity"), 20_000).groupBy("form").agg(F.collect_set(F.struct("name", "entity")).alias("candidates"))
    typed = materialise(met.mapInArrow(_aligned((TYPED,)), schema), "typed")

    columns = "form string, token string, tokens array<struct<t:string,l:long>>, size int, letters long, written long, firsts long, initials string"
    index = spelt.mapInArrow(_token_keys(False), columns)
    index = index.select(F.col("form").alias("name"), "token", F.col("tokens").alias("name_tokens"), F.col("size").alias("name_size"), F.col("letters").alias("name_letters"), F.col("firsts").alias("name_firsts"), F.col("initials").alias("name_initials")).join(names, "name")
    left = spread(open_.join(typed.select("form"), "form", "left_anti"), 20_000).mapInArrow(_token_keys(True), columns)
    twice = (F.col("name_size") >= 10) & (F.abs(F.col("size") - F.col("name_size")) <= 2) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("name_letters"))) <= 4)
    # of the letters written out, one edit brings in one that the name does not have
    begun = (F.bit_count(F.col("written").bitwiseAND(F.bitwise_not("name_letters"))) <= 1) & (F.bit_count(F.col("firsts").bitwiseAND(F.bitwise_not("name_firsts"))) <= 1)
    long_ = lambda t: F.exists("name_tokens", lambda x: (F.length(x["t"]) >= 8) & x["t"].startswith(F.substring(t, 1, 1)))
    plain_names = F.transform("name_tokens", lambda x: x["t"])
    unexplained = F.filter("tokens", lambda x: (F.length(x["t"]) > 1) & ~x["t"].endswith(".") & ~F.array_contains(plain_names, x["t"]) & ~F.contains(F.col("name_initials"), x["t"]) & ~long_(x["t"]))
    # one token may be mistyped, beside two others: one edit changes at most two letters of its set
    resembles = F.exists("name_tokens", lambda y: F.bit_count(y["l"].bitwiseXOR(unexplained[0]["l"])) <= 2)
    covered = (F.size(unexplained) == 0) | ((F.size(unexplained) == 1) & (F.size("tokens") >= 3) & resembles)
    met = left.join(near(index), "token").where(twice | (begun & covered))
    met = spread(met.select("form", "name", "entity"), 20_000).groupBy("form").agg(F.collect_set(F.struct("name", "entity")).alias("candidates"))
    short = materialise(met.mapInArrow(_aligned((SHORT, TYPED_TWICE, LEFT_OUT)), schema), "short")

    links = equal.unionByName(typed).unionByName(short).where("entity is not null")
    return who.join(links, "form").select("id", "entity", "tier").distinct()
