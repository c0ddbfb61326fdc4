"""Problem 5: mapping freely typed values to a reference list.

The reference names and their alias paths stand in one trie; a typed value runs
over it as a Levenshtein automaton (kept as bit sets, one for each number of
errors), so all entries within a distance that depends on the value's length
are found in one walk.  Every typed form is judged once: values are made
distinct before and joined back after.  A check of the words follows: a word
that is itself another word of the reference list is no slip of the pen.

Defined results: null, empty and blank values give no row; a value that means
no entry, or two entries equally well, gives ``none``; an empty reference list
gives ``none`` everywhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import attach_unique
from ..storage import Scratch
from .common import table

NONE = "none"
#: Words that carry no meaning in a name.
LINK_WORDS = frozenset("a an and at for in of on the to und et y de la le der die das".split())
#: The reference list is sent to all executors, so its size is checked.
MAX_ENTRIES = 200_000
#: One error for so many letters, and at most so many.
LETTERS_PER_ERROR, MAX_ERRORS = 8, 4
#: Forms that a worker keeps with their entries, as many are written alike but for numbering.
CACHED_FORMS = 50_000

_NUMBERING = re.compile(r"(?:,?\s*\b(?:vol|volume|no|nr|issue|pp|part)\b\.?\s*[\divxlc]+[a-z]?(?:\s*[-–]\s*\d+)?)|\b\d+\s*\(\d+\)|\((?:print|online|electronic|issn[^)]*)\)|\b(?:19|20)\d\d\b|['’]\d\d\b|\b\d+(?:st|nd|rd|th)?\b", re.I)
_LEAD = re.compile(r"^(?:in\s*:\s*|in\s+(?=proc))?(?:(?:the\s+)?proc(?:eedings)?\b\.?\s*(?:of\s+)?)?(?:the\s+)?", re.I)
_WORD = re.compile(r"[^\W_]+")


def words_of(value: str) -> list[str]:
    """Lower-cased words of a name without numbering, editions, and what stands before it."""
    v = html.unescape(value).strip()
    v = _LEAD.sub("", v.replace("&", " and ").replace("­", "").replace("​", ""))
    v = _NUMBERING.sub(" ", v)
    head, comma, tail = v.rpartition(",")
    if comma and re.search(r"\b(?:of|on|in|for)\s*$", tail, re.I):  # "Boreal Studies, Annals of"
        v = f"{tail} {head}"
    return _WORD.findall(v.lower())


class NameTrie:
    """Reference entries as paths; every path ends at entries with a rank (0 the name itself, more for aliases)."""

    def __init__(self, entries: list[tuple[str, str | None, str | None]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[dict[str, int]] = [{}]
        self.words_of_entry: dict[str, list[str]] = {}
        self.vocabulary: set[str] = set()
        self.by_word: dict[str, list] = {}
        for key, name, acronym in entries:
            words = words_of(name or "")
            if not key or not words:
                continue
            content = [w for w in words if w not in LINK_WORDS]
            self.words_of_entry[key] = content
            self.vocabulary.update(content)
            self._add(" ".join(words), key, 0)
            self._add(" ".join(content), key, 1)
            for i, w in enumerate(words[1:-1], 1):  # the two sides of "and" change places
                if w == "and":
                    self._add(" ".join([*words[: i - 1], words[i + 1], "and", words[i - 1], *words[i + 2 :]]), key, 2)
            if acronym and acronym.strip():
                self._add("".join(_WORD.findall(acronym.lower())), key, 1)
        for key, content in self.words_of_entry.items():  # abbreviations are prefixes of all words in turn
            self.by_word.setdefault((content[0][0] if content else "", len(content)), []).append((key, content))
        self._reach()
        self.cache: dict[str, list[tuple[int, int, str]]] = {}

    def _reach(self) -> None:
        """Lengths of the shortest and the longest path through each node; children stand after their parents."""
        depth = [0] * len(self.next)
        for node, following in enumerate(self.next):
            for child in following.values():
                depth[child] = depth[node] + 1
        self.least = [d if e else 1 << 30 for d, e in zip(depth, self.ends)]
        self.most = [d if e else -1 for d, e in zip(depth, self.ends)]
        for node in range(len(self.next) - 1, -1, -1):
            for child in self.next[node].values():
                self.least[node] = min(self.least[node], self.least[child])
                self.most[node] = max(self.most[node], self.most[child])

    def _add(self, path: str, key: str, rank: int) -> None:
        node = 0
        for c in path:
            following = self.next[node]
            if c not in following:
                following[c] = len(self.next)
                self.next.append({})
                self.ends.append({})
            node = following[c]
        self.ends[node][key] = min(rank, self.ends[node].get(key, rank))

    def within(self, typed: str, errors: int) -> list[tuple[int, int, str]]:
        """All (distance, rank, entry) within ``errors`` edits of ``typed``, nearest first."""
        m = len(typed)
        at: dict[str, int] = {}
        for i, c in enumerate(typed):
            at[c] = at.get(c, 0) | (1 << i)
        full = 1 << m
        found: dict[str, tuple[int, int]] = {}
        shortest, longest = m - errors, m + errors  # of the paths that can be so near
        least, most = self.least, self.most
        stack = [(0, tuple((1 << (j + 1)) - 1 for j in range(errors + 1)))]
        while stack:
            node, states = stack.pop()
            if self.ends[node]:
                for j, s in enumerate(states):
                    if s & full:
                        for key, rank in self.ends[node].items():
                            found[key] = min(found.get(key, (j, rank)), (j, rank))
                        break
            for c, child in self.next[node].items():
                if most[child] < shortest or least[child] > longest:
                    continue
                b = at.get(c, 0)
                below, new = 0, []
                for j, s in enumerate(states):
                    moved = (s & b) << 1
                    if j:
                        moved |= below | (below << 1) | (new[-1] << 1)
                    new.append(moved & ((full << 1) - 1))
                    below = s
                if any(new):
                    stack.append((child, tuple(new)))
        return sorted((d, r, k) for k, (d, r) in found.items())

    def abbreviated(self, typed: list[str]) -> list[tuple[int, int, str]]:
        """Entries whose content words begin, in turn, with the typed ones."""
        typed = [w for w in typed if w not in LINK_WORDS]
        if len(typed) < 3:
            return []
        return [(0, 3, k) for k, content in self.by_word.get((typed[0][0], len(typed)), []) if all(c.startswith(t) for t, c in zip(typed, content))]

    def _plausible(self, typed: list[str], key: str) -> bool:
        """No word typed is a different word of the reference list, and each is near one of the entry's."""
        own = self.words_of_entry[key]
        spare = set(own)
        for w in typed:
            if w in spare or w in LINK_WORDS:
                continue
            if w in self.vocabulary:
                return False
            if len(w) > 3 and not any(_near(w, o, 1 + (len(o) > 4) + (len(o) > 8)) for o in own) and not any(_near(w, o, 1 + (len(o) > 2)) for o in LINK_WORDS):
                return False
        return True

    def match(self, value: str) -> str:
        """The entry that a typed value means, or NONE."""
        words = words_of(value)
        if not words or "://" in value:
            return NONE
        typed = " ".join(words)
        if typed not in self.cache:
            if len(self.cache) >= CACHED_FORMS:
                self.cache.clear()
            hits = self.within(typed, 0) or self.abbreviated(words)
            limit = allowed_errors(typed)
            for errors in range(1, limit + 1):
                if hits:
                    break
                hits = [h for h in self.within(typed, errors) if self._plausible(words, h[2])]
            self.cache[typed] = hits
        hits = self.cache[typed]
        if not hits or len(hits) > 1 and hits[0][:2] == hits[1][:2]:
            return NONE
        return hits[0][2]


def allowed_errors(typed: str) -> int:
    """Errors that a typed name of its length may have."""
    return min(MAX_ERRORS, len(typed) // LETTERS_PER_ERROR)


def _near(a: str, b: str, limit: int) -> bool:
    """Whether a and b are within ``limit`` edits, a swap of neighbours counting as one."""
    if abs(len(a) - len(b)) > limit:
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


def _sent(reference: DataFrame):
    """The reference list on all executors; its size is checked against MAX_ENTRIES first."""
    entries = reference.select("venue_id", "name", "acronym").limit(MAX_ENTRIES + 1).collect()
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    return reference.sparkSession.sparkContext.broadcast([tuple(e) for e in entries])


def _spread(typed: DataFrame) -> DataFrame:
    """The different forms: few bytes but much work each, so they are spread by number, not by size."""
    context = typed.sparkSession.sparkContext
    return typed.select("venue").distinct().repartition(max(2 * context.defaultParallelism, int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def within_distance(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """venue, venue_id, distance: for each different form of rows (venue) all entries, by name or alias, within the errors of its length.

    Forms that are null, blank or near no entry give no row; what is near isn't yet what is meant (see ``mapped``).
    """
    sent = _sent(reference)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = NameTrie(sent.value)
        for b in batches:
            found = []
            for v in b["venue"]:
                typed = " ".join(words_of(v))
                found += [(v, key, d) for d, _, key in trie.within(typed, allowed_errors(typed))] if typed else []
            yield pd.DataFrame(found, columns=["venue", "venue_id", "distance"])

    return _spread(rows.where(F.trim("venue") != "").select("venue")).mapInPandas(near, "venue string, venue_id string, distance int")


def mapped(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """id, venue, venue_id of rows (id, venue); reference has venue_id, name, acronym.

    The reference is collected: its size is checked against MAX_ENTRIES first.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "venues")
    sent = _sent(reference)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = NameTrie(sent.value)
        for b in batches:
            yield pd.DataFrame({"venue": b["venue"], "venue_id": b["venue"].map(trie.match)})

    typed = scratch.save(rows.where(F.trim("venue") != "").select("id", "venue"), "typed")
    forms = _spread(typed).mapInPandas(judge, "venue string, venue_id string")
    return attach_unique(typed, scratch.save(forms, "forms"), "venue")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(table(spark, sf_dir, "papers"), table(spark, sf_dir, "venues")).select("id", "venue_id")


def p5_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, venue_id, distance: all entries within the distance of each typed value."""
    return within_distance(table(spark, sf_dir, "papers"), table(spark, sf_dir, "venues"))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, n_rows of every typed value that means no entry."""
    return (
        mapped(table(spark, sf_dir, "papers"), table(spark, sf_dir, "venues"))
        .where(F.col("venue_id") == NONE).groupBy("venue").agg(F.count(F.lit(1)).alias("n_rows"))
    )
