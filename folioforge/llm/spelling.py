"""Problem 7: variant spellings of the names of people and organisations.

Names are parsed into a block (initial of the given name; kind of organisation)
and a core (surname; town).  Cores become vectors of character n-grams weighted
by rarity.  Cores of one block within few edits are met by what is left of them
once letters are left out; products of n-grams that stand at like places are
summed by pair, and pairs over the threshold stay.  All pairs over the threshold
are kept, however many a name has.  The linked keys fall into components, and in
each the different forms of a name (not its rows) are grouped by average-linkage
clustering of a similarity of whole names, in which different identifiers,
given names or middle initials forbid a link.

Defined results: names that are null, empty or name nobody pair with nothing; rows of
one identifier are one entity; of two equally good groups a form without
identifier joins the larger one; repeated rows (same id) count once; empty tables give no pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, star_edges
from ..operators.skew import attach_unique
from ..storage import Scratch
from .common import table

#: n-gram length; cosine from which two cores are compared; edits allowed between them (a swap of neighbours is one).
GRAM, COSINE, CORE_EDITS = 3, 0.25, 1
#: Letters up to which near cores are met by leaving letters out.
LONG = 20
#: Bits of a place in such a core, and the place of nothing; rows of what is left of cores that a task holds, about.
PLACE_BITS, NOWHERE, LEFT_EACH = 5, 31, 1 << 22
#: Names a task keeps as parsed, so that one in many rows is parsed once.
PARSED = 1 << 17
#: Average similarity from which groups of forms are joined.
LINKAGE = 0.55
#: A word is a given name if at least this share of all rows (and 3) have it first; an organisation's ordinary word if it has this share and 4.
GIVEN_SHARE, ORDINARY_SHARE = 0.0007, 0.008
#: Values of the country column that so large a share of rows have are countries' names; there are 1 / COUNTRY_SHARE at most.
COUNTRY_SHARE = 0.001

# Common short forms of given names.
SHORT_FORMS = {
    "bob": "robert", "rob": "robert", "bert": "robert", "bobby": "robert", "bill": "william", "will": "william", "billy": "william",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine",
    "mike": "michael", "mick": "michael", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "hans": "johannes", "jan": "johannes", "jo": "johannes",
    "tom": "thomas", "tommy": "thomas", "ben": "benjamin", "benny": "benjamin", "chris": "christopher", "kit": "christopher", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "fred": "frederik", "freddy": "frederik", "paco": "francisco", "pancho": "francisco", "curro": "francisco",
    "kolya": "nikolai", "nick": "nikolai", "nico": "nikolai", "toni": "antonio", "tony": "antonio", "toño": "antonio", "vicky": "victoria", "vic": "victoria", "tori": "victoria",
    "dora": "theodora", "thea": "theodora", "theo": "theodora", "gabi": "gabriela", "gaby": "gabriela", "debbie": "deborah", "deb": "deborah", "suse": "susanna", "sue": "susanna", "susi": "susanna",
    "lena": "magdalena", "magda": "magdalena", "katya": "ekaterina", "katja": "ekaterina", "sam": "samuel", "sammy": "samuel", "dima": "dmitri", "mitya": "dmitri",
    "jim": "james", "jimmy": "james", "dick": "richard", "rick": "richard", "dave": "david", "steve": "stephen", "joe": "joseph", "ed": "edward", "ted": "edward", "andy": "andrew", "matt": "matthew", "dan": "daniel", "tim": "timothy", "jenny": "jennifer", "becky": "rebecca", "max": "maximilian", "pete": "peter",
}
# Words that stand for no person.
NOBODY = re.compile(r"\b(?:editorial|editors?\b(?!\))|board|anonymous|anon|unknown|various|staff|collaboration|consortium|committee|working group|n\.\s*n\.?|n/a|none|null|tba|admin|et al)\b|^\W*$", re.I)
PARTICLES = frozenset("de la le van von der den di da del dos du ter ten zu bin al el".split())
_TITLES = re.compile(r"\b(?:dr|prof|professor|mr|mrs|ms|sir|dipl|ing)\b\.?|,?\s*\b(?:ph\.?\s?d|m\.?sc|b\.?sc|md|jr|sr|mba)\b\.?|\([^)]*\)|[*†‡§\d]", re.I)
# Spellings of the ordinary words of organisations' names.
ORG_WORDS = {
    "univ": "university", "universidad": "university", "universität": "university", "universitat": "university", "université": "university", "università": "university", "universiteit": "university", "uni": "university",
    "tech": "technology", "technical": "technology", "technische": "technology", "technik": "technology", "técnica": "technology", "technological": "technology",
    "inst": "institute", "institut": "institute", "instituto": "institute", "istituto": "institute", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "laboratorium": "laboratory",
    "hosp": "hospital", "gen": "general", "res": "research", "dept": "department", "dep": "department",
}
_NO_LETTER = re.compile(r"[\W\d_]+")
ORG_DROP = frozenset("of for the de la le du für fur fuer and und y et ltd inc gmbh llc co corp sa ag".split())
_DEPARTMENT = re.compile(r"^\s*(?:department|dept\.?|school|faculty|division|chair|section|abteilung|departamento|laboratory)\s+(?:of|for|de|für)\s+[^,]*,\s*(?=\S)", re.I)


def folded(s: str) -> str:
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def edits(a: str, b: str, limit: int) -> int:
    """Edits between a and b, a swap of neighbours counting as one; limit + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


def parse_person(name: str | None, given_names: set[str]) -> tuple[str, str, str] | None:
    """(block, core, given names in order), or None for nobody."""
    if not name or NOBODY.search(_strip(name)):
        return None
    s = re.sub(r"\s+", " ", _TITLES.sub(" ", _strip(name).replace("’", "'"))).strip(" ,;")
    if "," in s:
        last, _, first = s.partition(",")
        given, family = first.split(), last.split()
    else:
        parts = s.split()
        shouted = [p for p in parts if re.search(r"[^\W\d_]{3}", p) and p.isupper()]
        known = lambda p: all(q in given_names or SHORT_FORMS.get(q) for q in folded(p.lower()).split("-"))
        if len(parts) > 1 and shouted and len(shouted) < len(parts) and parts[0].isupper() and len(parts[0]) > 1 and not parts[-1].isupper():
            k = max(i for i, p in enumerate(parts) if p in shouted)
            family, given = parts[: k + 1], parts[k + 1 :]
        elif len(parts) > 1 and not known(parts[0]) and re.search(r"[^\W\d_]{3}", parts[0]) and known(parts[-1]):
            family, given = parts[:-1], parts[-1:]
        else:
            k = len(parts) - 1
            while k > 1 and parts[k - 1].lower() in PARTICLES:
                k -= 1
            given, family = parts[:k], parts[k:]
    core = _NO_LETTER.sub("", folded((family or [""])[-1].lower()))
    tokens: list[str] = []
    for g in given:
        for p in re.split(r"[-.]", g):
            if p and p.isupper() and 1 < len(p) <= 3 and folded(p.lower()) not in given_names:
                tokens += list(folded(p.lower()))
            elif p:
                q = _NO_LETTER.sub("", folded(p.lower()))
                tokens += [SHORT_FORMS.get(q, q)] if q and q not in PARTICLES else []
    # a single letter is an initial, but in scripts without cases it may be a name
    if not core or len(core) < 2 and core.upper() != core or not tokens:
        return None
    return tokens[0][0], core, " ".join(tokens)


def _strip(s: str) -> str:
    if s.isascii() and s.isprintable():
        return s
    return "".join(" " if unicodedata.category(c) == "Zs" else c for c in s if unicodedata.category(c) not in ("Cf", "Cc"))


def parse_org(name: str | None, ordinary: dict[str, float], countries: set[str]) -> tuple[str, str, str] | None:
    """(block, core, acronym): the kind of organisation, its town, and the kind's initials.

    ``ordinary`` gives frequent words and how many different rare words stand beside them, by their
    frequency: a town that very many rows name is frequent, too, but has few such neighbours.
    """
    if not name or not name.strip():
        return None
    s = re.sub(r"\s+", " ", _strip(name)).strip()
    s = _DEPARTMENT.sub("", s)
    pieces = [p for p in re.split(r"[,()]", s) if p.strip() and p.strip().lower() not in countries]
    raw = re.findall(r"[^\W\d_]+", " ".join(pieces))
    shouted = {w.lower() for w in raw if w.isupper() and 2 <= len(w) <= 4} if not all(w.isupper() for w in raw) else set()
    kind, rest, acronym = [], [], ""
    for w in (x.lower() for x in raw):
        if w in ORG_DROP:
            continue
        if w in ("tu", "tuniv"):
            kind += ["university", "technology"]
            continue
        v = ORG_WORDS.get(w, w)
        if v in ordinary or v in ORG_WORDS.values():
            kind.append(v)
        elif w in shouted:
            acronym = w
        else:
            near = [o for o in ordinary.keys() | set(ORG_WORDS) if len(w) >= 3 and len(o) >= 3 and edits(w, o, 1) <= 1 and (len(w) > 3 or o in ORG_WORDS)] or [o for o in ordinary if len(w) >= 9 and edits(w, o, 2) <= 2]
            if near:
                o = min(near)
                kind.append(ORG_WORDS.get(o, o))
            else:
                rest.append(w)
    if not rest:
        named = [k for k in kind if k not in ORG_WORDS.values()]
        if not named:
            return None
        rest = [min(named, key=lambda k: (ordinary.get(k, 0.0), k))]
        kind = [k for k in kind if k != rest[0]]
    town = max(rest, key=len)
    if acronym and not kind:
        return f"={acronym}", folded(town), acronym
    kind += [w for w in rest if w != town]
    if "laboratory" in kind:
        kind = [k for k in kind if k not in ("research", "general")] if "institute" not in kind else kind
    initials = "".join(w[0] for w in (["institute", *[k for k in kind if k != "institute"]] if "institute" in kind else []))
    return " ".join(sorted(set(kind))), folded(town), initials


#: Factor of a letter's place in hashes of words, its inverse modulo 2^64, and odd numbers that mix bits.
_PLACED, _MIXED, _STIRRED = 0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BACK = pow(_PLACED, -1, 1 << 64)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIXED)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_STIRRED)
    return x ^ (x >> np.uint64(31))


def letters_left(number: np.ndarray, block: np.ndarray, core: list[str], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """h, at of each core and each set of up to ``limit`` letters left out of it: the hash of what is left and of the block; and
    the core's number with the places, in what is left, at which a letter is missing."""
    length = np.fromiter(map(len, core), dtype=np.int64, count=len(core))
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        letters = np.array([core[r] for r in rows], dtype=f"<U{n}").view(np.uint32).reshape(len(rows), n).astype(np.uint64)
        step = np.uint64(1)
        sums = [np.zeros(len(rows), dtype=np.uint64)]  # of the first letters, each times a power for its place
        for k in range(n):
            sums.append(sums[-1] + _stirred(letters[:, k] + np.uint64(1)) * step)
            step = np.uint64(int(step) * _PLACED % (1 << 64))
        own = _stirred(block[rows].view(np.uint64))
        hs, ats = [], []
        for k in range(min(limit, n) + 1):
            for out in combinations(range(n), k):
                h, factor, begin, at = np.zeros(len(rows), dtype=np.uint64), 1, 0, number[rows]
                for end in (*out, n):  # the letters between two left out move so many places down
                    h = h + (sums[end] - sums[begin]) * np.uint64(factor)
                    factor, begin = factor * _BACK % (1 << 64), end + 1
                for i in range(limit):
                    at = at << PLACE_BITS | (out[i] - i if i < k else NOWHERE)
                hs.append(_stirred(h + own).view(np.int64))
                ats.append(at)
        yield np.concatenate(hs), np.concatenate(ats)


def met_by_letters(h: np.ndarray, at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers a < b of the cores that are within ``limit`` edits by what is left of them (see ``letters_left``), each pair once.

    Two cores that leave the same differ by the letters left out of both, but for one edit in place of two where both miss one at one place.
    """
    order = np.argsort(h)
    h, at = h[order], at[order]
    mask = (1 << PLACE_BITS) - 1
    first, k = np.arange(len(h) - 1), 1
    pairs = np.zeros((0, 2), dtype=np.int64)
    held, n_held = [pairs], 0
    while len(first):
        first = first[: np.searchsorted(first, len(h) - k)]
        first = first[h[first] == h[first + k]]
        x, y = at[first], at[first + k]
        xs, ys = ([(z >> PLACE_BITS * i) & mask for i in range(limit)] for z in (x, y))
        edits_of = sum((z != NOWHERE).astype(np.int8) for z in (*xs, *ys))
        free = [z != NOWHERE for z in ys]
        for p in xs:
            taken = p == NOWHERE
            for i, q in enumerate(ys):
                same = (p == q) & free[i] & ~taken
                free[i] &= ~same
                taken |= same
                edits_of -= same
        x, y = x >> PLACE_BITS * limit, y >> PLACE_BITS * limit
        near = (edits_of <= limit) & (x != y)
        held.append(np.stack((np.minimum(x, y)[near], np.maximum(x, y)[near]), axis=1))
        n_held += len(held[-1])
        k += 1
        if n_held > LEFT_EACH or not len(first):
            pairs = np.concatenate(held)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)][: len(pairs)]]
            held, n_held = [pairs], 0
    return pairs[:, 0], pairs[:, 1]


def near_cores(keys: DataFrame) -> DataFrame:
    """a, b of the keys (key, block, core) of one block whose cores are within 2 * CORE_EDITS edits, all of them.

    Two such words of up to LONG letters are equal once up to so many letters are left out of each, so
    what is left is joined: what is met grows with the words, not with the pairs of their n-grams.
    What is left are pairs of numbers; a task sorts its part of them and takes what is equal, and the places of
    the letters tell near words from others.
    Longer words leave too many ways to do so and meet by any n-gram in its place; these are rare.
    """
    limit = 2 * CORE_EDITS
    scratch = Scratch(keys.sparkSession, "near")
    keys = scratch.save(keys.select(F.monotonically_increasing_id().alias("number"), "key", "block", "core"), "numbered")
    n = F.length("core")
    short = keys.where((n >= GRAM) & (n <= LONG))

    total = short.select(F.sum(F.lit(1) + n * (n + 1) / 2)).head()[0] or 0
    parts = max(2 * keys.sparkSession.sparkContext.defaultParallelism, int(total) // LEFT_EACH + 1)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, block = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            made = list(letters_left(number, block, b.column(2).to_pylist(), limit))
            if not made:
                continue
            h, at = (np.concatenate(x) for x in zip(*made))
            part = (h.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
            h, at, ends = h[order], at[order], np.r_[0, np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))].tolist()
            some = [i for i in range(parts) if ends[i] < ends[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary()) for x in (h, at))], ["part", "h", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # copied: what is held of a batch must not hold the whole of it
        held = [tuple(np.frombuffer(v.as_buffer(), dtype=np.int64).copy() for v in row) for b in batches for row in zip(b.column(0), b.column(1))]
        if held:
            h, at = (np.concatenate(x) for x in zip(*held))
            del held
            a, b = met_by_letters(h, at, limit)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # a row holds what a batch of cores leaves for one part: Spark moves few large rows in place of very many small ones
    left = short.select("number", F.xxhash64("block").alias("b"), "core").mapInArrow(leave, "part int, h binary, at binary")
    met = left.repartitionById(parts, "part").select("h", "at").mapInArrow(meet, "a long, b long").distinct()
    side = lambda t, x: t.select(*[F.col(k).alias(f"{k}_{x}") for k in ("key", "block", "core")], *[F.col(k).alias(v) for k, v in (("number", x), ("h", "h"), ("at", "at")) if k in t.columns])
    met = met.join(side(keys, "a"), "a").join(side(keys, "b"), "b")
    long = keys.where(n > LONG - limit).withColumn("at", F.explode(F.sequence(F.lit(1), n - (GRAM - 1))))
    long = long.select("key", "block", "core", F.xxhash64("block", F.substring("core", F.col("at"), F.lit(GRAM))).alias("h"), "at")
    # a gram that is left stands at most so many places away; one join for each, on equal places
    away = long.withColumn("at", F.explode(F.sequence(F.col("at") - limit, F.col("at") + limit)))
    met_long = side(away, "a").join(side(long, "b").hint("merge"), ["h", "at"]).where("key_a < key_b")
    # what shares a number by chance is told apart by its edits
    both = [m.where("block_a = block_b").where(F.levenshtein("core_a", "core_b", limit) >= 0).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")) for m in (met, met_long)]
    return both[0].unionByName(both[1]).distinct()


def similar_cores(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, cosine of the keys (key, block, core) whose cores are near and alike in one block: a sparse cosine of n-grams.

    An n-gram counts if it stands in the other word, too, at most one place away; only near cores are compared,
    so only these become vectors, with weights from all.
    """
    padded = F.concat(F.lit("^"), F.col("core"), F.lit("$"))
    inside = F.transform(F.sequence(F.lit(1), F.length(padded) - (GRAM - 1)), lambda i: F.substring(padded, i, F.lit(GRAM)))
    grams = keys.where(F.length("core") >= 3).select("key", "block", inside.alias("all"))
    total = keys.count()
    weight = grams.select(F.explode(F.array_distinct("all")).alias("gram")).groupBy("gram").agg(F.log1p(F.lit(float(total)) / F.count(F.lit(1))).alias("w"))
    pairs = scratch.save(near_cores(keys), "near")
    used = grams.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi")
    placed = used.select("key", "block", "all", F.explode(F.array_distinct("all")).alias("gram")).select("key", "block", "gram", F.array_position("all", F.col("gram")).cast("int").alias("at"))
    weighted = attach_unique(placed, scratch.save(weight, "weights"), "gram")
    whole = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("block", "gram", "at", "w")).alias("v"))
    vectors = scratch.save(whole.select("key", F.transform("v", lambda x: F.struct(x["block"].alias("block"), x["gram"].alias("gram"), x["at"].alias("at"), (x["w"] / F.col("norm")).alias("w"))).alias("v")), "vectors")
    both = pairs.join(vectors.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
    same = lambda x: F.filter("vb", lambda y: (x["gram"] == y["gram"]) & (F.abs(x["at"] - y["at"]) <= 1) & (x["block"] == y["block"]))
    cosine = F.aggregate("va", F.lit(0.0), lambda s, x: F.aggregate(same(x), s, lambda z, y: z + x["w"] * y["w"]))
    return both.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= COSINE)


def person_similarity(f: tuple[str, str], g: tuple[str, str]) -> float:
    """How well two parsed names (core, given) fit; negative if they can't be one person."""
    d = edits(f[0], g[0], CORE_EDITS)
    if d > CORE_EDITS:
        return -1.0
    score = 1.0 - 0.12 * d
    a, b = f[1].split(), g[1].split()
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y:
            continue
        if len(x) == 1 or len(y) == 1:
            if x[0] != y[0]:
                return -1.0
            score -= 0.2 if i == 0 else 0.04
        elif min(len(x), len(y)) >= 3 and max(len(x), len(y)) >= 4 and edits(x, y, 1) <= 1 and not d:
            score -= 0.15
        else:
            return -1.0
    if len(a) != len(b):
        more = a[len(b) :] or b[len(a) :]
        initial = bool(a and b) and 1 in (len(a[0]), len(b[0]))
        score -= 0.08 if all(len(m) == 1 for m in more) else 0.2 if initial else 0.3
    return score


def org_similarity(f: tuple[str, str, str], g: tuple[str, str, str]) -> float:
    """The same for organisations (core, block, acronym)."""
    d = edits(f[0], g[0], CORE_EDITS)
    if d > CORE_EDITS:
        return -1.0
    if f[1] == g[1]:
        return 1.0 - 0.12 * d
    if f[2] and f[2] == g[2] and (f[1].startswith("=") != g[1].startswith("=")):
        return 0.8 - 0.12 * d
    return -1.0


def average_linkage(similarity: np.ndarray, size: np.ndarray, threshold: float) -> list[int]:
    """Cluster numbers; of equal similarities the pair with more rows, then the first, is joined first.

    A negative similarity forbids that its two forms come into one cluster.
    """
    n = len(size)
    cluster = list(range(n))
    s = similarity.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    s[s < 0] = -np.inf
    weight = size.astype(float).copy()
    forms = np.ones(n)
    alive = np.ones(n, dtype=bool)
    while True:
        top = s.max() if n > 1 else -np.inf
        if not top >= threshold:
            return cluster
        pairs = np.argwhere(s >= top - 1e-12)
        i, j = min(((i, j) for i, j in pairs if i < j), key=lambda p: (-(weight[p[0]] + weight[p[1]]), p[0], p[1]))
        merged = (s[i] * forms[i] + s[j] * forms[j]) / (forms[i] + forms[j])
        merged[~np.isfinite(s[i]) | ~np.isfinite(s[j])] = -np.inf
        merged[i] = merged[j] = -np.inf
        s[i], s[:, i] = merged, merged
        s[j], s[:, j] = -np.inf, -np.inf
        alive[j] = False
        weight[i] += weight[j]
        forms[i] += forms[j]
        cluster = [i if c == j else c for c in cluster]


def group_forms(forms: pd.DataFrame, kind: str) -> list[int]:
    """Cluster numbers of a component's forms (core, block, detail, ident, n)."""
    return group_rows(list(zip(forms["core"], forms["block"], forms["detail"], forms["ident"])), forms["n"].to_numpy(), kind)


def comparable(rows: list[tuple[str, str, str, str]]) -> Iterator[tuple[int, int]]:
    """Numbers i > j of all rows (core, block, detail, ident) that may be permitted: those of one identifier, and those whose
    cores are within CORE_EDITS edits, which leave the same once so many letters are left out.  Of few rows all pairs."""
    if len(rows) <= 24:
        yield from ((i, j) for i in range(len(rows)) for j in range(i))
        return
    of_core: dict[str, list[int]] = {}
    of_ident: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        of_core.setdefault(r[0], []).append(i)
        if r[3]:
            of_ident.setdefault(r[3], []).append(i)
    met: dict[str, list[str]] = {}
    for core in of_core:
        for left in {"".join(c for i, c in enumerate(core) if i not in out) for k in range(min(CORE_EDITS, len(core)) + 1) for out in combinations(range(len(core)), k)}:
            met.setdefault(left, []).append(core)
    for members in (*of_core.values(), *of_ident.values()):
        yield from ((i, j) for n, i in enumerate(members) for j in members[:n])
    for a, b in {(a, b) if a < b else (b, a) for cores in met.values() for a, b in combinations(cores, 2)}:
        yield from ((i, j) if i > j else (j, i) for i in of_core[a] for j in of_core[b])


def group_rows(rows: list[tuple[str, str, str, str]], size: np.ndarray, kind: str) -> list[int]:
    """The same of rows (core, block, detail, ident) and how many rows each stands for."""
    n = len(rows)
    if n == 1:
        return [0]

    def similarity(i: int, j: int) -> float:
        x, y = rows[i], rows[j]
        if x[3] and y[3]:
            return 2.0 if x[3] == y[3] else -1.0
        if kind == "author":
            return person_similarity((x[0], x[2]), (y[0], y[2]))
        return org_similarity((x[0], x[1], x[2]), (y[0], y[1], y[2]))

    # forms that no chain of permitted pairs joins never come into one cluster, so each part is linked by itself
    part = list(range(n))
    permitted: dict[tuple[int, int], float] = {}

    def top(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for i, j in comparable(rows):
        v = similarity(i, j)
        if v >= 0:
            permitted[j, i] = v
            part[max(top(i), top(j))] = min(top(i), top(j))
    parts: dict[int, list[int]] = {}
    for i in range(n):
        parts.setdefault(top(i), []).append(i)
    links: dict[int, list[tuple[int, int, float]]] = {}
    for (j, i), v in permitted.items():
        links.setdefault(top(i), []).append((j, i, v))
    cluster = list(range(n))
    for first, members in parts.items():
        if len(members) == 1:
            continue
        at = {m: k for k, m in enumerate(members)}
        s = np.full((len(members), len(members)), -1.0)
        for j, i, v in links[first]:
            s[at[i], at[j]] = s[at[j], at[i]] = v
        for m, c in zip(members, average_linkage(s, size[members], LINKAGE)):
            cluster[m] = members[c]
    return cluster


def linked(parsed: DataFrame, kind: str) -> DataFrame:
    """id, cluster of parsed rows (id, block, core, detail, ident); cluster is null for names of nobody."""
    spark = parsed.sparkSession
    scratch = Scratch(spark, f"spelling-{kind}")
    parsed = scratch.save(parsed.where("core is not null").dropDuplicates(["id"]).withColumn("key", F.concat_ws("|", "block", "core")), "parsed")
    keys = parsed.select("key", "block", "core").distinct()
    acronym = F.concat(F.lit("="), F.col("detail"))
    if kind == "org":  # a kind with known initials also stands under them
        also = parsed.where("detail != '' and block not like '=%'").select("key", acronym.alias("block"), "core", F.concat_ws("|", acronym, F.col("core")).alias("other")).distinct()
        keys = keys.unionByName(also.select(F.col("other").alias("key"), "block", "core")).distinct()
    alike = similar_cores(scratch.save(keys, "keys"), scratch)
    near = alike.withColumns({"ca": F.substring_index("a", "|", -1), "cb": F.substring_index("b", "|", -1)}).where(F.levenshtein("ca", "cb", 2 * CORE_EDITS) >= 0)
    edges = near.select("a", "b").unionByName(star_edges(parsed.where("ident is not null"), "ident", "key"))
    if kind == "org":
        edges = edges.unionByName(also.select(F.col("key").alias("a"), F.col("other").alias("b")))
    whole = scratch.save(connected_components(edges), "components")
    forms = scratch.save(parsed.groupBy("key", "core", "block", "detail", "ident").agg(F.count(F.lit(1)).alias("n")), "forms")
    placed = forms.join(whole.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # a blank for a missing identifier, so forms can be joined back on equality
    placed = placed.withColumn("ident", F.coalesce("ident", F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(held):
                continue
            last = held["component"].iloc[-1]
            done, held = held[held["component"] != last], held[held["component"] == last]
            yield from _grouped(done, kind)
        if held is not None:
            yield from _grouped(held, kind)

    grouped = placed.repartition("component").sortWithinPartitions("component", "key", "detail", "ident").mapInPandas(
        run, "key string, core string, block string, detail string, ident string, cluster string"
    )
    grouped = scratch.save(grouped, "grouped")
    return parsed.withColumn("ident", F.coalesce("ident", F.lit(""))).join(grouped.select("key", "detail", "ident", "cluster"), ["key", "detail", "ident"]).select("id", "cluster")


def _grouped(done: pd.DataFrame, kind: str) -> Iterator[pd.DataFrame]:
    if not len(done):
        return
    labels: list[str] = []
    names = done["component"].to_numpy()
    edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True])
    rows = list(zip(done["core"], done["block"], done["detail"], done["ident"]))
    size = done["n"].to_numpy()
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        labels += [f"{names[lo]}#{c}" for c in group_rows(rows[lo:hi], size[lo:hi], kind)]
    yield done.assign(cluster=labels)[["key", "core", "block", "detail", "ident", "cluster"]]


def people(authors: DataFrame) -> DataFrame:
    """Parsed rows of authors (id, name, orcid)."""
    spark = authors.sparkSession
    n = authors.count()
    first = F.lower(F.regexp_extract(F.col("name"), r"(?:^|,)\s*(?:(?:Dr|Prof)\.?\s+)?([\p{L}]{3,})(?:\s|$|-)[^,]*$", 1))
    common = authors.select(first.alias("w")).where("w != ''").groupBy("w").count().where(F.col("count") >= max(3, GIVEN_SHARE * n))  # at most 1 / GIVEN_SHARE words
    sent = spark.sparkContext.broadcast({folded(r[0]) for r in common.select("w").collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = lru_cache(PARSED)(lambda x: parse_person(x, sent.value))
        for b in batches:
            p = [parse(x) or (None, None, None) for x in b["name"]]
            yield pd.DataFrame({"id": b["id"], "block": [x[0] for x in p], "core": [x[1] for x in p], "detail": [x[2] for x in p], "ident": b["ident"]})

    digits = F.regexp_replace(F.upper("orcid"), "[^0-9X]", "")
    ident = F.when(F.length(digits) >= 16, F.right(digits, F.lit(16)))
    return authors.select("id", "name", ident.alias("ident")).mapInPandas(run, "id string, block string, core string, detail string, ident string")


def organisations(orgs: DataFrame) -> DataFrame:
    """Parsed rows of orgs (id, name, ror, country)."""
    spark = orgs.sparkSession
    n = orgs.count()
    words = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}]+"), F.lit(0)))
    names = Scratch(spark, "names").save(orgs.select(words.alias("ws")).groupBy("ws").agg(F.count(F.lit(1)).alias("n")), "names")
    common = names.select(F.explode("ws").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= 4 + ORDINARY_SHARE * n)
    common = {r[0]: r[1] for r in common.collect()}  # a few words a share of rows: bounded
    listed = F.array(*[F.lit(w) for w in common]) if common else F.array().cast("array<string>")
    beside = names.select(F.explode(F.array_intersect("ws", listed)).alias("w"), F.array_except("ws", listed).alias("rare")).select("w", F.explode("rare").alias("r")).distinct().groupBy("w").count()
    rare = {r[0]: r[1] for r in beside.collect()}
    ordinary = {ORG_WORDS.get(w, w): rare.get(w, 0) / k for w, k in common.items() if w not in ORG_DROP}
    countries = {r[0].lower() for r in orgs.where("length(country) > 3").groupBy("country").count().where(F.col("count") >= COUNTRY_SHARE * n).select("country").collect()}
    sent = spark.sparkContext.broadcast((ordinary, countries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = lru_cache(PARSED)(lambda x: parse_org(x, *sent.value))
        for b in batches:
            p = [parse(x) or (None, None, None) for x in b["name"]]
            yield pd.DataFrame({"id": b["id"], "block": [x[0] for x in p], "core": [x[1] for x in p], "detail": [x[2] for x in p], "ident": b["ident"]})

    ident = F.nullif(F.regexp_extract(F.lower("ror"), r"([0-9a-z]{5,9})/?\s*$", 1), F.lit(""))
    return orgs.select("id", "name", ident.alias("ident")).mapInPandas(run, "id string, block string, core string, detail string, ident string")


def variant_pairs(authors: DataFrame, orgs: DataFrame) -> DataFrame:
    """entity_type, id_a, id_b of all pairs of rows that mean the same person or organisation."""
    out = []
    for kind, parsed in (("author", people(authors)), ("org", organisations(orgs))):
        rows = linked(parsed, kind)
        pair = rows.withColumnRenamed("id", "id_a").join(rows.withColumnRenamed("id", "id_b"), "cluster").where("id_a < id_b")
        out.append(pair.select(F.lit(kind).alias("entity_type"), "id_a", "id_b"))
    return out[0].unionByName(out[1])


def variant_members(authors: DataFrame, orgs: DataFrame) -> DataFrame:
    """entity_type, first_id, id: the same as membership, one row for each row that names somebody; first_id is the smallest
    id of its person or organisation.  Its size is that of the input, however many rows one entity has."""
    out = []
    for kind, parsed in (("author", people(authors)), ("org", organisations(orgs))):
        rows = Scratch(authors.sparkSession, "members").save(linked(parsed, kind).where("cluster is not null"), kind)
        first = rows.groupBy("cluster").agg(F.min("id").alias("first_id"))
        out.append(attach_unique(rows, first, "cluster").select(F.lit(kind).alias("entity_type"), "first_id", "id"))
    return out[0].unionByName(out[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "authors"), table(spark, sf_dir, "orgs"))


def p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the smallest id of its person or organisation, in place of all pairs."""
    return variant_members(table(spark, sf_dir, "authors"), table(spark, sf_dir, "orgs"))
