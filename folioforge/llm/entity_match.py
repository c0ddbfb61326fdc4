"""Problem 2: matching records of two sources that share no key, with a confidence.

Records, their attributes (title, year, doi, arxiv id) and the tokens of these
form a graph.  Random walks over it train skip-gram vectors of the tokens; a
record's vector is the weighted sum of its title tokens' vectors.  Random
hyperplanes turn vectors into bits; several tables of some of the bits block
the records (the nearest other buckets are probed as well), and all bits
together tell near pairs from far ones.  What is left is compared word by word and
reranked by the exact cosine, which is calibrated into a confidence by pairs that also
share or contradict an identifier; pairs under LEAST_CONFIDENCE are left out.

The graph walked is that of a bounded sample of records (SAMPLE_RECORDS), which
only places token vectors; tokens outside it keep the vectors they started
with.  Token counts, buckets and comparisons cover all records.  Equal titles
are one record up to the last step, so a title that a third of all rows have is
one row in every join.

A work is what shares a title (if it isn't one of those that many works have),
a DOI, an arXiv id or an earlier match; every row of the work is paired.

Defined results: rows without a title match by identifiers only; titles that
many works have ("Editorial") too; a further part, supplement or reply is another
work; of several works that fit a title equally well and not exactly none is taken;
empty tables give no pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_arxiv, canonical_doi
from ..operators.components import connected_components, star_edges
from ..storage import Scratch
from .common import keys_of_canonical, table

SEED = 1729
#: Tokens are character n-grams of a title, hashed into BUCKETS; vectors have DIM places.
GRAM, BUCKETS, DIM = 2, 1 << 15, 64
#: The sample whose graph is walked, and the walks.
SAMPLE_RECORDS, WALKS, STEPS, WINDOW, NEGATIVES, EPOCHS = 4000, 16_000, 8, 2, 3, 1
#: Bits of a record, tables and probes of buckets of LEAST_BITS bits; those of more bits have more of both (``layout``).
BITS, TABLES, PROBES, LEAST_BITS, MOST_BITS = 192, 7, 4, 12, 40
#: The base 2 logarithm of the titles in a bucket.
BUCKET_LOAD = 3.5
#: Titles cut short are compared by their first letters, in VIEW_TABLES tables a view.  They are few, so it's their
#: probes that are many: VIEW_PROBES for LEAST_BITS bits.
VIEWS = (12, 20, 30, 42)
VIEW_TABLES, VIEW_PROBES = 1, 64
RATE = 0.1
#: Directions of the sample's vectors that are left out, at most: so many that SLIP_SHARE of the sample's titles stay
#: near (FAR) to what two slips of the pen make of them.
COMMON_AXES, SLIP_SHARE = 8, 0.98
#: Bits that may differ (cosine about cos(pi * d / BITS)).
FAR = 44
#: And for the shortest beginnings, of whose n-grams a slip changes more.
SHORT, FAR_SHORT = 20, 66
#: Titles of at least so many different years that spread so far (standard deviation) are no work's own; the
#: years of a work are noisy, but lie together however many rows it has.
COMMON_YEARS, COMMON_SPREAD = 5, 2.5
#: A word is ordinary if so large a share of all titles (and 4) have it: at most the mean number of words over it are.
ORDINARY_SHARE = 0.0002
#: Names of sites after a title: this share of all rows, 4 at least, so there are 1 / SITE_SHARE at most.
SITE_SHARE = 0.001
#: A bounded sample of pairs with two DOIs, by which cosines are calibrated.
CALIBRATION_PAIRS = 20_000
#: Fits that cost so little more than the best one are as good.
CLEAR = 0.15
#: Confidence of pairs that share an identifier, at least; and that from which pairs come out.
BY_IDENTIFIER, LEAST_CONFIDENCE = 0.99, 0.25

_CITED = re.compile(r"^\W*(?:[^\W\d_][\w'’-]*,? (?:[A-Z]\.?[ -]?)+,? (?:et al\.?|and [^()]{2,60}|&[^()]{2,60})?\s*)\((?:19|20)\d\d[a-z]?\)[.:,]?\s+")
_LEAD = re.compile(r"^\W*\[(?:pdf|html|doc|book|preprint|abstract)\]\s*", re.I)
_SITE = re.compile(r"\s(?:[-–—|»·]|::)\s+([^|»·–—]{3,40}?)\s*$")
_CUT = re.compile(r"(?:…|\.\.\.)\W*$")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}
_PART = re.compile(r"\W*\b(?:part\s+(\d+|[ivx]+))\W*$|\W*\((?:part\s+)?(\d+|[ivx]+)\)\W*$", re.I)
_KIND = re.compile(r"\W*\b(supplement(?:ary)?(?: materials?)?|reply(?: to (?:the )?comments?)?|response to (?:the )?comments?|comments?|erratum|corrigendum|addendum|rejoinder|appendix)\W*$|^\W*(supplement to|reply to|response to|comments? on|erratum(?: to)?:?|corrigendum(?: to)?:?|addendum to)\b", re.I)
_KIND_HINTS = ("suppl", "reply", "respons", "comment", "errat", "corrig", "addend", "rejoin", "append")
#: Characters that show nothing: soft hyphens, joiners, marks of direction.
_FORMAT = re.compile("[\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def clean_title(title: str | None, sites: frozenset[str] = frozenset()) -> tuple[str, str, bool]:
    """(words, kind, cut): the title's words in composed lower case; what sets it apart from the work it
    belongs to ("part 2", "reply", ...); whether its end is missing."""
    if not title or not title.strip():
        return "", "", False
    t = title if title.isascii() else _FORMAT.sub("", unicodedata.normalize("NFC", title))
    t = " ".join(t.split())
    if "[" in t:
        t = _LEAD.sub("", t)
    if "(" in t[:90]:
        t = _CITED.sub("", t)
    site = sites and _SITE.search(t)
    if site and site.group(1).lower().strip(" .\"”'") in sites:
        t = t[: site.start()]
    cut = "…" in t or "..." in t
    if cut:
        cut = bool(_CUT.search(t))
        t = _CUT.sub("", t)
    kinds = []
    low = t.lower()
    end = low.rstrip(" .\"”’')")[-1:]
    part = _PART.search(t) if end.isdigit() or end in "ivx" else None
    if part and part.start() > 8:
        n = (part.group(1) or part.group(2)).lower()
        kinds.append(f"part {_ROMAN.get(n, n)}")
        t = t[: part.start()]
    kind = _KIND.search(t) if any(x in low for x in _KIND_HINTS) else None
    if kind and len(t) - (kind.end() - kind.start()) > 8:
        kinds.append((kind.group(1) or kind.group(2)).lower().split()[0].rstrip("s:"))
        t = t[: kind.start()] if kind.group(1) else t[kind.end() :]
    words = _WORD.findall(t.lower().replace("-", "").replace("–", " ").replace("'", "").replace("’", ""))
    return " ".join(words), " ".join(kinds), cut


def gram_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text's letters, one after another, and their number a text."""
    raw = [(" " + t.replace(" ", "") + " ").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    if len(flat) < GRAM:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    h = np.zeros(len(flat) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(1_000_003) + flat[k : len(flat) - GRAM + 1 + k]
    h ^= h >> np.uint64(17)
    h *= np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), dtype=bool)  # starts of n-grams that don't run into the next text
    for k in range(1, GRAM):
        inside[ends - k] = False
    counts = np.maximum(sizes - GRAM + 1, 0)
    return ((h >> np.uint64(40)).astype(np.int64) % BUCKETS)[inside[: len(h)]], counts


def grams(text: str) -> np.ndarray:
    """Bucket of each n-gram of one text's letters."""
    return gram_batch([text])[0]


def start_vectors() -> np.ndarray:
    v = np.random.default_rng(SEED).standard_normal((BUCKETS, DIM)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _move(vectors: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Steps of a batch, a vector that is met often moving by the mean of its steps times the root of their number."""
    which, place, count = np.unique(at, return_inverse=True, return_counts=True)
    sums = np.zeros((len(which), by.shape[1]), dtype=np.float32)
    np.add.at(sums, place, by)
    vectors[which] += RATE * sums / np.sqrt(count)[:, None].astype(np.float32)


def train_vectors(records: list[tuple[str, str, str, str]]) -> np.ndarray:
    """Token vectors by skip-gram with negative samples over walks record - attribute - token - record.

    ``records`` are (title, year, doi, arxiv id); identifiers and years are tokens of their own attributes.
    """
    rng = np.random.default_rng(SEED)
    vectors = start_vectors()
    tokens, owner, extra = [], [], {}
    for i, (title, *rest) in enumerate(records):
        g = np.unique(grams(title))
        tokens.append(g)
        owner.append(np.full(len(g), 2 * i))
        more = [extra.setdefault((k, v), BUCKETS + len(extra)) for k, v in enumerate(rest) if v]
        tokens.append(np.array(more, dtype=np.int64))
        owner.append(np.full(len(more), 2 * i + 1))  # attribute nodes: title 2i, the others 2i + 1
    if not tokens or not sum(map(len, tokens)):
        return vectors
    tok, own = np.concatenate(tokens).astype(np.int64), np.concatenate(owner).astype(np.int64)
    n_tok, n_att = BUCKETS + len(extra), 2 * len(records)
    by_att = np.argsort(own, kind="stable")
    att_at = np.searchsorted(own[by_att], np.arange(n_att + 1))
    by_tok = np.argsort(tok, kind="stable")
    tok_at = np.searchsorted(tok[by_tok], np.arange(n_tok + 1))

    full = att_at[1:] > att_at[:-1]  # attributes that have tokens

    def step(att: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A token of each attribute, and an attribute of a record that has the token."""
        lo, hi = att_at[att], att_at[att + 1]
        t = tok[by_att[lo + (rng.random(len(att)) * (hi - lo)).astype(np.int64)]]
        lo, hi = tok_at[t], tok_at[t + 1]
        record = own[by_tok[lo + (rng.random(len(t)) * (hi - lo)).astype(np.int64)]] // 2
        other = 2 * record + (rng.random(len(t)) < 0.2)
        return t, np.where(full[other], other, other ^ 1)

    all_vec = np.vstack([vectors, 0.1 * rng.standard_normal((len(extra), DIM)).astype(np.float32)]) if extra else vectors.copy()
    context = np.zeros_like(all_vec)
    filled = np.flatnonzero(full)
    for _ in range(EPOCHS):
        att = rng.choice(filled, WALKS)
        path = []
        for _ in range(STEPS):
            t, att = step(att)
            path.append(t)
        path = np.stack(path, 1)
        a, b = [], []
        for d in range(1, WINDOW + 1):
            a += [path[:, :-d].ravel(), path[:, d:].ravel()]
            b += [path[:, d:].ravel(), path[:, :-d].ravel()]
        a, b = np.concatenate(a), np.concatenate(b)
        order = rng.permutation(len(a))
        for lo in range(0, len(order), 2048):
            at, bt = a[order[lo : lo + 2048]], b[order[lo : lo + 2048]]
            neg = tok[rng.integers(0, len(tok), (len(at), NEGATIVES))]
            va = all_vec[at]
            for target, label in [(bt, 1.0), *[(neg[:, k], 0.0) for k in range(NEGATIVES)]]:
                vb = context[target]
                g = (label - 1 / (1 + np.exp(-np.clip((va * vb).sum(1), -8, 8)))).astype(np.float32)
                _move(context, target, g[:, None] * va)
                _move(all_vec, at, g[:, None] * vb)
    out = all_vec[:BUCKETS]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def layout(n_bits: int) -> tuple[int, int, int]:
    """Tables, probes, and probes of titles cut short, for buckets of so many bits; more of them make up for longer buckets."""
    more = max(0, n_bits - LEAST_BITS)
    return TABLES + round(0.6 * more), PROBES + more // 4, round(VIEW_PROBES * 2 ** (more / 3))


@lru_cache
def probe_sets(n_bits: int, probes: int) -> list[tuple[int, ...]]:
    """The likeliest sets of bits to turn, by their places in order of the distance from their planes."""
    odds = [(j + 1) * (j + 2) for j in range(n_bits)]
    sets = [c for k in range(5) for c in combinations(range(min(n_bits, 14)), k)]
    return sorted(sets, key=lambda c: (sum(odds[j] for j in c), c))[:probes]


class Hasher:
    """Turns titles into bits, and bits into buckets."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, n_bits: int, centre: np.ndarray | None = None, common: np.ndarray | None = None):
        rng = np.random.default_rng(SEED + 1)
        self.weighted = vectors * weight[:, None].astype(np.float32)
        n_tables, self.probes, self.view_probes = layout(n_bits)
        self.tables = [BITS + t * n_bits + np.arange(n_bits) for t in range(n_tables)]
        # short beginnings are few, so short buckets tell them apart
        self.view_tables = [[cols[: max(8, min(n_bits - 2, size // 2 + 4))] for cols in self.tables[:VIEW_TABLES]] for size in VIEWS]
        self.planes = rng.standard_normal((DIM, BITS + n_tables * n_bits)).astype(np.float32)
        self.centre = np.zeros(DIM, dtype=np.float32) if centre is None else centre
        self.common = np.zeros((DIM, 0), dtype=np.float32) if common is None else common

    def own_vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of the titles without what all titles have in common."""
        out = self.vectors(texts) - self.centre
        out -= (out @ self.common) @ self.common.T
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def margins(self, texts: list[str]) -> np.ndarray:
        """Distances of the titles' vectors from the planes."""
        return self.own_vectors(texts) @ self.planes

    def cosines(self, ours: list[str], theirs: list[str], cut: list[bool]) -> np.ndarray:
        """Exact cosine of each pair; a title cut short is held against as many letters of the other."""
        if not ours:
            return np.zeros(0)
        begun = [x.replace(" ", "")[: len(y.replace(" ", ""))] if c else x for x, y, c in zip(ours, theirs, cut)]
        return (self.own_vectors(begun) * self.own_vectors(theirs)).sum(1).astype(float)

    def vectors(self, texts: list[str]) -> np.ndarray:
        flat, sizes = gram_batch(texts)
        out = np.zeros((len(texts), DIM), dtype=np.float32)
        starts = np.cumsum(sizes) - sizes
        for n in np.unique(sizes[sizes > 0]):  # texts of one length at a time, as one block
            which = np.flatnonzero(sizes == n)
            for lo in range(0, len(which), 512):
                some = which[lo : lo + 512]
                out[some] = self.weighted[flat[starts[some][:, None] + np.arange(n)]].sum(1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def words(bits: np.ndarray) -> np.ndarray:
        """The bits as BITS / 64 signed numbers a row."""
        return np.packbits(bits, axis=1, bitorder="little").view("<i8")

    @staticmethod
    def number(bits: np.ndarray) -> np.ndarray:
        return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1], dtype=np.int64))


def _index_rows(texts: list[str], reps: list, hasher: Hasher, tables: list[np.ndarray], view: int, probes: int) -> pd.DataFrame:
    """rep, bucket, s0, s1: one row a record, table and probe."""
    m = hasher.margins(texts)
    bits = m > 0
    sig = hasher.words(bits[:, :BITS])
    buckets = []
    for t, cols in enumerate(tables):
        base = hasher.number(bits[:, cols]) | (np.int64(t + 64 * view) << np.int64(44))
        if probes == 1:
            buckets.append(base[:, None])
            continue
        sets = probe_sets(len(cols), probes)
        near = np.int64(1) << np.argsort(np.abs(m[:, cols]), axis=1)
        turned = np.zeros((len(texts), len(sets)), dtype=np.int64)
        for k, places in enumerate(sets):
            for j in places:
                turned[:, k] |= near[:, j]
        buckets.append(base[:, None] ^ turned)
    found = np.concatenate(buckets, axis=1)
    at = np.repeat(np.arange(len(texts)), found.shape[1])
    out = {"rep": np.array(reps, dtype=np.int64)[at], "bucket": found.ravel()}
    return pd.DataFrame(out | {f"s{k}": sig[at, k] for k in range(BITS // 64)})


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> bool:
    """Whether a may be b with a slip or two; a swap of neighbours is one."""
    limit = 1 if min(len(a), len(b)) <= 5 else 2
    if abs(len(a) - len(b)) > limit or min(len(a), len(b)) < 2:
        return False
    if len(set(a) ^ set(b)) > 2 * limit:  # an edit changes two letters of the set at most
        return False
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > limit:
            return False
        before, last = last, row
    return last[-1] <= limit


def penalty(ours: str, theirs: str, cut: bool, ordinary: frozenset[str] | set[str]) -> float:
    """How much ``theirs`` departs from the title ``ours``: 0 for equal ones, inf for different works."""
    if ours == theirs or not cut and ours.replace(" ", "") == theirs.replace(" ", ""):
        return 0.0
    p, d = ours.split(), theirs.split()
    cost = 0.0
    if cut:
        letters = theirs.replace(" ", "")
        if ours.replace(" ", "").startswith(letters):
            return 0.1 + (5.0 if len(letters) < 12 else 0.0)
        stub, d = d[-1] if d else "", d[:-1]
        p = p[: len(d) + 1]
        if p and len(p) > len(d):
            if not (p[-1].startswith(stub) or near(p[-1][: len(stub)], stub) or len(stub) < 3):
                cost += 0.7
            p = p[:-1]
        if sum(map(len, d)) < 10:
            return np.inf
    ps, ds = set(p), set(d)
    if len(ps) == len(p) and len(ds) == len(d):
        left, over = [w for w in p if w not in ds], [w for w in d if w not in ps]
    else:
        left, over = list((Counter(p) - Counter(d)).elements()), list((Counter(d) - Counter(p)).elements())
    # ordinary words first: one that isn't a slip of the pen ends the comparison
    for w in sorted(over, key=lambda w: (w not in ordinary, -len(w))):
        known = w in ordinary
        fit = next((x for x in left if not (known and x in ordinary) and near(w, x)), None)
        if fit is not None:
            left.remove(fit)
            cost += 0.35
            continue
        if len(w) <= 3:
            cost += 0.5
            continue
        joined = next(((x, y) for x in left for y in left if x != y and abs(len(x) + len(y) - len(w)) <= 2 and (x + y == w or near(x + y, w))), None)
        if joined:
            left.remove(joined[0])
            left.remove(joined[1])
            cost += 0.2
        elif not known and any(x.startswith(w) or w.startswith(x) for x in left if len(x) > 3 and x not in ordinary):
            cost += 0.8
        else:
            return np.inf
    for x in left:
        cost += 0.25 if len(x) <= 3 else 0.9 if x in ordinary else 2.5
    if not left and not over:  # the same words in another order
        moved = sum(x != y for x, y in zip(p, d))
        cost += 0.2 if moved <= 4 else np.inf
    return cost if cost <= 0.9 + 0.09 * len(p) else np.inf


def candidate_pairs(ours: DataFrame, asked: DataFrame, sent) -> DataFrame:
    """num, q, far (bits that differ) of near titles; ours has num, norm; asked has q, norm, cut; ``sent`` is what ``_fit`` gives."""
    sig = ", ".join(f"s{k} long" for k in range(BITS // 64))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher(*sent.value)
        for b in batches:
            for at in range(0, len(b), 4000):
                c = b.iloc[at : at + 4000]
                yield _index_rows(c["norm"].tolist(), c["num"].tolist(), h, h.tables, 0, 1)
                letters = c["norm"].str.replace(" ", "", regex=False)
                long = letters.str.len()
                for v, size in enumerate(VIEWS, 1):
                    some = long > size
                    if some.any():
                        yield _index_rows(letters[some].str[:size].tolist(), c["num"][some].tolist(), h, h.view_tables[v - 1], v, 1)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher(*sent.value)
        for b in batches:
            for at in range(0, len(b), 2000):
                c = b.iloc[at : at + 2000]
                whole, cut = c[~c["cut"]], c[c["cut"]]
                if len(whole):
                    yield _index_rows(whole["norm"].tolist(), whole["q"].tolist(), h, h.tables, 0, h.probes)
                letters = cut["norm"].str.replace(" ", "", regex=False)
                view = np.searchsorted(VIEWS, letters.str.len().to_numpy(), side="right")
                for v, size in enumerate(VIEWS, 1):
                    some = view == v
                    if some.any():
                        yield _index_rows(letters[some].str[:size].tolist(), cut["q"][some].tolist(), h, h.view_tables[v - 1], v, h.view_probes)

    left = ours.select("num", "norm").mapInPandas(index, f"rep long, bucket long, {sig}").withColumnRenamed("rep", "num")
    right = asked.select("q", "norm", "cut").mapInPandas(probe, f"rep long, bucket long, {sig}").withColumnRenamed("rep", "q")
    for k in range(BITS // 64):
        right = right.withColumnRenamed(f"s{k}", f"t{k}")
    far = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(1, BITS // 64)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    view = F.shiftrightunsigned("bucket", 50)
    limit = F.when(view.between(1, sum(size <= SHORT for size in VIEWS)), FAR_SHORT).otherwise(FAR)
    return left.join(right, "bucket").withColumn("far", far).where(F.col("far") <= limit).groupBy("num", "q").agg(F.min("far").alias("far"))


def matched(papers: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, row_id, confidence of papers and found rows that are one work."""
    spark = papers.sparkSession
    scratch = Scratch(spark, "match")
    sites = _sites(found)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = [clean_title(t, sites) for t in b["title"]]
            yield b.drop(columns="title").assign(norm=[x[0] for x in c], kind=[x[1] for x in c], cut=[x[2] for x in c])

    def keyed(df: DataFrame, key: str, kind: str, may_cut: bool) -> DataFrame:
        """key, year, doi, arxiv, norm, kind, cut, title: a number for the cleaned title, null if there is none."""
        year = F.nullif(F.regexp_extract(F.col("year").cast("string"), r"^\s*((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")
        cols = df.select(key, "title", year.alias("year"), canonical_doi(F.col("doi")).alias("doi"), canonical_arxiv(F.col("arxiv_id")).alias("arxiv"))
        cols = cols.mapInPandas(clean, f"{key} {kind}, year int, doi string, arxiv string, norm string, kind string, cut boolean")
        cut = F.col("cut") if may_cut else F.lit(False)
        return cols.withColumn("cut", cut).withColumn("title", F.when(F.col("norm") != "", F.xxhash64("norm", "kind", "cut")))

    p = scratch.save(keyed(papers, "id", "string", False), "papers")
    d = scratch.save(keyed(found, "row_id", "long", True), "found")
    n_p, n_d = p.count(), d.count()
    if not n_p or not n_d:
        return spark.createDataFrame([], "id string, row_id long, confidence double")
    titles = scratch.save(_titles(p, d), "titles").where(~F.col("common"))
    ours = titles.where("rep is not null")
    # a papers title without any identifier may be another spelling of one with some
    theirs = titles.where("found and rep is null").select("title", "norm", "kind", "cut")
    lone = ours.where("not named and length(norm) >= 12").select("title", "norm", "kind", "cut", "first", "last", F.col("rep").alias("own"))
    asked = theirs.unionByName(lone, allowMissingColumns=True).withColumnRenamed("title", "q")
    n_titles = titles.count()
    ordinary = _ordinary(titles.select("norm"), n_titles)
    fitted = spark.sparkContext.broadcast(_fit(p, d, titles, n_titles))
    near_pairs = scratch.save(candidate_pairs(ours.select(F.col("title").alias("num"), "norm"), asked, fitted), "near")

    words = spark.sparkContext.broadcast(ordinary)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher(*fitted.value)
        for b in batches:
            cost = np.array([penalty(x, y, c, words.value) for x, y, c in zip(b["norm_p"], b["norm_d"], b["cut"])])
            fit = b[np.isfinite(cost)]
            yield fit[["rep_p", "ident", "q", "own"]].assign(cost=cost[np.isfinite(cost)], cosine=h.cosines(fit["norm_p"].tolist(), fit["norm_d"].tolist(), fit["cut"].tolist()))

    near_years = F.col("own").isNull() | F.coalesce((F.col("first_p") <= F.col("last") + 1) & (F.col("first") <= F.col("last_p") + 1), F.lit(True))
    with_text = (
        near_pairs.join(ours.select(F.col("title").alias("num"), F.col("rep").alias("rep_p"), "ident", F.col("norm").alias("norm_p"), F.col("kind").alias("kind_p"), F.col("first").alias("first_p"), F.col("last").alias("last_p")), "num")
        .join(asked.select("q", F.col("norm").alias("norm_d"), "kind", "cut", "first", "last", "own"), "q")
        .where(((F.col("kind") == F.col("kind_p")) | F.col("cut")) & near_years & (F.col("own").isNull() | (F.col("own") != F.col("rep_p"))))
        .select("rep_p", "ident", "q", "own", "norm_p", "norm_d", "cut")
    )
    fits = scratch.save(with_text.mapInPandas(compare, "rep_p string, ident string, q long, own string, cost double, cosine double"), "fits")

    # works: rows of one title of its own, or linked by identifiers, earlier matches or a clear fit of a title without identifiers
    titled = p.select("id", "title").join(ours.select("title", "rep"), "title").where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    given = pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).where("a != b")
    for end in ("a", "b"):
        given = given.join(p.select(F.col("id").alias(end)), end, "left_semi")
    alike = _clear(fits.where("own is not null"), ["own"], "ident", "rep_p").select(F.col("own").alias("a"), F.col("of").alias("b"))
    edges = star_edges(keys_of_canonical(p, "id"), "key", "id").unionByName(given.select("a", "b")).unionByName(titled).unionByName(alike)
    work = scratch.save(connected_components(edges), "works")
    works = scratch.save(p.select("id", "doi", "arxiv").join(work, p["id"] == work["node"], "left").select("id", "doi", "arxiv", F.coalesce("component", "id").alias("work")), "rows")

    # the best fitting work of each found title; equal fits that aren't exact are none
    exact = titles.where("found and rep is not null").select(F.col("title").alias("q"), F.col("rep").alias("rep_p"), F.lit(0.0).alias("cost"), F.lit(1.0).alias("cosine"))
    of_found = fits.where("own is null").select("q", "rep_p", "cost", "cosine").unionByName(exact)
    best = _clear(of_found.join(works.select(F.col("id").alias("rep_p"), "work"), "rep_p"), ["q"], "work", "work")
    by_title = d.select("row_id", F.col("title").alias("q")).join(best.select("q", F.col("of").alias("work"), "cosine"), "q").select("row_id", "work", "cosine")
    # identifiers say it without a title; found rows of a further part keep to theirs
    ids_p = keys_of_canonical(works, "work").groupBy("key").agg(F.min("work").alias("work"))
    by_id = keys_of_canonical(d, "row_id").join(ids_p, "key").select("row_id", "work", F.lit(None).cast("double").alias("cosine"))
    links = scratch.save(by_title.unionByName(by_id).groupBy("row_id", "work").agg(F.max("cosine").alias("cosine"), F.max(F.col("cosine").isNull()).alias("by_id")), "links")
    w = _calibration(near_pairs, fits, p, d)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(w[0]) + F.lit(w[1]) * F.col("cosine") + F.lit(w[2]))))
    score = F.when(F.col("by_id"), F.greatest(F.lit(BY_IDENTIFIER), F.coalesce(score, F.lit(0.0)))).otherwise(score)
    sure = links.withColumn("confidence", score).where(F.col("confidence") >= LEAST_CONFIDENCE)
    return works.select("id", "work").join(sure, "work").select("id", "row_id", F.round("confidence", 4).alias("confidence"))


def _clear(fits: DataFrame, key: list[str], group: str, of: str) -> DataFrame:
    """key, of, cosine: the best fit of each key, if no other group fits as well, or if it is exact (cost 0); of equal costs the larger cosine."""
    each = fits.groupBy(*key, F.col(group).alias("g")).agg(F.min("cost").alias("cost"), F.min_by(F.struct(F.col(of).alias("of"), "cosine"), F.struct("cost", -F.col("cosine"), of)).alias("at"))
    best = each.groupBy(*key).agg(F.min("cost").alias("least"), F.min_by("at", F.struct("cost", -F.col("at.cosine"), "g")).alias("at"), F.collect_list(F.round("cost", 3)).alias("costs"))
    clear = F.size(F.filter("costs", lambda c: c < F.col("least") + CLEAR)) == 1
    return best.where((F.col("least") == 0) | clear).select(*key, "at.of", "at.cosine")


def _titles(p: DataFrame, d: DataFrame) -> DataFrame:
    """One row a title of either source: title (its number), norm, kind, cut; of papers rows the smallest id (rep), an
    identifier (ident; rep without one), whether there is one (named), first and last year; whether found rows have
    it; whether it is common, one that many works have: its years are many (modulo 64) and lie apart."""
    none = lambda kind: F.lit(None).cast(kind)
    of_p = p.select("title", "norm", "kind", "cut", "year", "id", "doi", "arxiv", F.lit(False).alias("found"))
    of_d = d.select("title", "norm", "kind", "cut", "year", none("string").alias("id"), none("string").alias("doi"), none("string").alias("arxiv"), F.lit(True).alias("found"))
    y, own = F.col("year").cast("double"), F.col("id").isNotNull()
    each = of_p.unionByName(of_d).where("title is not null").groupBy("title").agg(
        F.first("norm").alias("norm"), F.first("kind").alias("kind"), F.first("cut").alias("cut"), F.min("id").alias("rep"), F.coalesce(F.min("doi"), F.min("arxiv"), F.min("id")).alias("ident"),
        F.max(F.col("doi").isNotNull() | F.col("arxiv").isNotNull()).alias("named"), F.min(F.when(own, F.col("year"))).alias("first"), F.max(F.when(own, F.col("year"))).alias("last"),
        F.max("found").alias("found"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, year % 64)"))).alias("years"), F.avg(y).alias("y"), F.avg(y * y).alias("yy"),
    )
    spread = F.sqrt(F.greatest(F.col("yy") - F.col("y") ** 2, F.lit(0.0)))
    common = F.coalesce((F.col("years") >= COMMON_YEARS) & (spread >= COMMON_SPREAD), F.lit(False))
    return each.withColumn("common", common).drop("years", "y", "yy")


def _sites(found: DataFrame) -> frozenset[str]:
    """Names that stand after many titles; 1 / SITE_SHARE at most."""
    name = F.lower(F.trim(F.regexp_replace(F.regexp_extract("title", _SITE.pattern, 1), "[.\"”']+$", "")))
    n = found.count()
    some = found.select(name.alias("w"), "title").where("w != ''").distinct().groupBy("w").count().where(F.col("count") >= max(4, SITE_SHARE * n))
    return frozenset(r[0] for r in some.select("w").collect() if not _KIND.search(" " * 9 + r[0]) and not _PART.search("x" * 9 + " " + r[0]))


def _ordinary(titles: DataFrame, n: int) -> set[str]:
    """Words of many titles."""
    each = titles.select(F.explode(F.array_distinct(F.split("norm", " "))).alias("w")).groupBy("w").count()
    return {r[0] for r in each.where(F.col("count") >= max(4, ORDINARY_SHARE * n)).select("w").collect()}


def _fit(p: DataFrame, d: DataFrame, titles: DataFrame, n: int) -> tuple:
    """Token vectors and what all titles have in common (by a bounded sample), token weights and the bits of a bucket (by all records)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            seen += np.bincount(gram_batch(b["norm"].tolist())[0], minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "n": seen[at]})

    df = np.zeros(BUCKETS)
    for r in titles.select("norm").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        df[r[0]] = r[1]
    weight = np.log1p(n / np.maximum(df, 1.0)) ** 0.25
    half = SAMPLE_RECORDS // 2
    sample = []
    for rows, key in ((p, "id"), (d, "row_id")):
        some = rows.where("norm != ''").orderBy(F.xxhash64(F.lit(SEED), key)).limit(half)
        sample += [(r["norm"], str(r["year"] or ""), r["doi"] or "", r["arxiv"] or "") for r in some.select("norm", "year", "doi", "arxiv").collect()]
    n_bits = int(np.clip(round(np.log2(max(n, 2)) - BUCKET_LOAD), 10, MOST_BITS))
    vectors, weight = train_vectors(sample), weight.astype(np.float32)
    known = Hasher(vectors, weight, n_bits).vectors([t for t, *_ in sample] or [""])
    centre = known.mean(0)
    # directions in which titles of one pattern agree say little about the work
    _, axes = np.linalg.eigh((known - centre).T @ (known - centre))
    axes = axes[:, ::-1]
    tried = [t for t, *_ in sample[:: max(1, len(sample) // 500)] if len(t) >= 2 * SHORT]
    slipped = _slips(tried)
    for n_axes in range(COMMON_AXES, -1, -2):
        fitted = vectors, weight, n_bits, centre, np.ascontiguousarray(axes[:, :n_axes])
        h = Hasher(*fitted)
        bits = [h.margins(x)[:, :BITS] > 0 for x in (tried, slipped)]
        if not tried or np.mean((bits[0] ^ bits[1]).sum(1) <= FAR) >= SLIP_SHARE:
            break
    return fitted


def _slips(titles: list[str]) -> list[str]:
    """The titles with two slips of the pen each."""
    rng = np.random.default_rng(SEED + 2)
    out = []
    for t in titles:
        for _ in range(2):
            i, kind = int(rng.integers(0, len(t) - 1)), int(rng.integers(0, 4))
            t = (t[:i] + t[i + 1 :], t[:i] + "x" + t[i + 1 :], t[:i] + t[i + 1] + t[i] + t[i + 2 :], t[:i] + t[i] + t[i:])[kind]
        out.append(t)
    return out


def _calibration(near_pairs: DataFrame, fits: DataFrame, p: DataFrame, d: DataFrame) -> tuple[float, float, float]:
    """Weights of log odds by cosine and by whether the words fit, from near pairs of which both have a DOI.

    The pairs are a bounded sample; differing DOIs count against a pair though versions may have them,
    so confidences lean to the low side.
    """
    own = near_pairs.join(p.where("doi is not null and title is not null").select(F.col("title").alias("num"), F.col("id").alias("rep_p"), F.col("doi").alias("doi_p")), "num").join(
        d.where("doi is not null and title is not null").select(F.col("title").alias("q"), F.col("doi").alias("doi_d")), "q")
    own = own.orderBy(F.xxhash64("num", "q")).limit(CALIBRATION_PAIRS)
    about = F.cos(F.col("far") * F.lit(np.pi / BITS))  # for those that don't fit, whose cosine isn't worked out
    told = own.join(fits.where("own is null").select("rep_p", "q", F.lit(1.0).alias("fit"), "cosine"), ["rep_p", "q"], "left").select(
        F.coalesce("cosine", about).alias("cosine"), F.coalesce("fit", F.lit(0.0)).alias("fit"), (F.col("doi_p") == F.col("doi_d")).cast("double").alias("same")).toPandas()
    if len(told) < 20 or told["same"].nunique() < 2:
        return -4.0, 3.0, 4.0
    y = told["same"].to_numpy()
    design = np.stack([np.ones(len(told)), told["cosine"].to_numpy(), told["fit"].to_numpy()], 1)
    w = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]) + 0.1 * np.eye(3), design.T @ (y - q) - 0.1 * w)
        w = w + np.clip(step, -4, 4)
    return tuple(map(float, w))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(*(table(spark, sf_dir, t) for t in ("papers", "discovery_rows", "match_pairs"))).select("id", "row_id")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found with the confidence of each pair."""
    return matched(*(table(spark, sf_dir, t) for t in ("papers", "discovery_rows", "match_pairs")))
