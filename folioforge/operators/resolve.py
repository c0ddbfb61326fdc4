"""Resolution of batches of lookups against source rows."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..storage import Scratch, parts_by_size
from .merge import merge_rows
from .similarity import histogram, shared_characters

c = F.col


def with_lookup_ids(requests: DataFrame) -> DataFrame:
    """Requests with eff_doi and eff_arxiv: ``records.lookup_ids`` in steps, each part worked out once."""
    parts = requests.withColumns({
        "_doi": R.bare_doi(c("doi")), "_given": R.bare_arxiv(F.when(R.has(c("arxiv_id")), c("arxiv_id")).otherwise(c("arxiv_url"))),
    })
    parts = parts.withColumn("_alias", R.alias_arxiv(c("_doi")))
    return parts.withColumns({
        "eff_doi": F.when(c("_alias") != "", "").otherwise(c("_doi")), "eff_arxiv": F.when(c("_given") != "", c("_given")).otherwise(c("_alias")),
    }).drop("_doi", "_given", "_alias")


def lookups(requests: DataFrame) -> DataFrame:
    """qid, mode ('doi', 'arxiv', 'title', 'none') and value of requests (qid, doi, arxiv_url, arxiv_id, title)."""
    ids = with_lookup_ids(requests).select("qid", "title", c("eff_doi").alias("d"), c("eff_arxiv").alias("a"))
    mode = F.when(c("d") != "", "doi").when(c("a") != "", "arxiv").when(R.has(c("title")), "title").otherwise("none")
    value = F.when(c("d") != "", c("d")).when(c("a") != "", c("a")).otherwise(R.title_words(c("title")))
    return ids.select("qid", mode.alias("mode"), value.alias("value"))


def identified(rows: DataFrame) -> DataFrame:
    """Source rows once for each identifier they can be looked up by."""
    d, a, al = R.bare_doi(c("doi")), R.bare_arxiv(c("arxiv_id")), R.alias_arxiv(c("doi"))
    tag = lambda m, v: F.when(v != "", F.struct(F.lit(m).alias("mode"), v.alias("value")))
    return rows.withColumn("k", F.explode(F.array_distinct(F.array_compact(F.array(tag("doi", d), tag("arxiv", a), tag("arxiv", al)))))).select(*rows.columns, "k.mode", "k.value")


def merged_by_identifier(rows: DataFrame, policy: str, source_order: list[str]) -> DataFrame:
    """mode, value, n_rows, n_sources, n_terms (of the row with most, if rows have ``_terms``) and the merged record of each identifier.

    ``consensus`` merges the rows of all sources; ``fast`` those of the first source that has any.
    Records are merged once an identifier, not once a request.
    """
    keyed = identified(rows).withColumn("key", F.concat_ws("|", "mode", "value"))
    if policy == "fast":
        place = F.array_position(F.array(*[F.lit(s) for s in source_order]), c("source"))
        keyed = keyed.withColumn("place", F.when(place > 0, place).otherwise(len(source_order) + 1))
        first = keyed.groupBy("key").agg(F.min("place").alias("place"))
        keyed = keyed.join(first, ["key", "place"])
    terms = F.max(c("_terms")) if "_terms" in rows.columns else F.lit(0)
    size = keyed.groupBy("key", "mode", "value").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"), terms.alias("n_terms"))
    return size.join(merge_rows(keyed, "key"), "key").drop("key")


def resolve(requests: DataFrame, rows: DataFrame, policy: str, source_order: list[str]) -> DataFrame:
    """Status and record of each request that names an identifier; title requests see ``resolve_titles``."""
    asked = lookups(requests).where(c("mode").isin("doi", "arxiv"))
    found = merged_by_identifier(rows, policy, source_order)
    out = asked.join(found, ["mode", "value"], "left")
    return out.withColumn("status", F.when(c("paper_id").isNotNull(), "resolved").otherwise("not_found"))


#: Share of a title's words (of over three letters, if it has any) that a row has to have to be a candidate.
WORD_SHARE = 0.6


#: Rows that one task holds, titles that it looks up in them, and tasks at least: bounds of a task's memory, not of what is looked through.
ROWS_EACH, TITLES_EACH, LEAST_PARTS = 1 << 18, 100_000, 12


def sharing_words(rows: pa.Table, titles: pa.Table) -> pa.Table:
    """qid, ord of titles (qid, words, least) and rows (ord, have) that share at least ``least`` different words.

    None is lost: a row that lacks at most n - k of n words has one of any n - k + 1 of them, so only rows that have one
    of the title's rarest ones are looked at.
    """
    n, lists = rows.num_rows, rows["have"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    of = words.indices.to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[np.argsort(of, kind="stable")]
    start = np.r_[0, np.cumsum(np.bincount(of, minlength=len(words.dictionary)))]
    asked = titles["words"].combine_chunks()
    at = pc.fill_null(pc.index_in(asked.flatten(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))]
    least, shared = titles["least"].to_numpy(), np.zeros(n, dtype=np.int32)
    none = np.zeros(0, dtype=np.int64)
    whose, met = [none], [none]
    for i in range(titles.num_rows):
        have = sorted((place[start[w] : start[w + 1]] if w >= 0 else none for w in at[ends[i] : ends[i + 1]]), key=len)
        for x in have:
            shared[x] += 1
        rare = np.concatenate([none, *have[: max(len(have) - least[i] + 1, 0)]])
        hits = np.unique(rare[shared[rare] >= least[i]])
        for x in have:
            shared[x] = 0
        whose.append(np.full(len(hits), i))
        met.append(hits)
    return pa.table({"qid": titles["qid"].take(np.concatenate(whose)), "ord": rows["ord"].take(np.concatenate(met))})


def title_candidates(titles: DataFrame, rows: DataFrame, share: float = WORD_SHARE) -> DataFrame:
    """qid, ord of titles (qid, title_norm) and rows (ord, title_norm) that share at least ``share`` of the title's words.

    Titles and rows are cut into parts, each two of which meet in one task; only what shares enough words leaves it.
    ``share`` 0 gives every row that has any of the words.
    """
    scratch = Scratch(rows.sparkSession, "candidates")
    every = F.array_distinct(F.split("title_norm", " "))
    long = F.filter(every, lambda w: F.length(w) > 3)
    asked = titles.select("qid", F.when(F.size(long) > 0, long).otherwise(every).alias("words"))
    asked = scratch.save(asked.select("qid", "words", F.greatest(F.ceil(F.size("words") * F.lit(float(share))), F.lit(1)).cast("int").alias("least")), "asked")
    have = scratch.save(rows.select("ord", every.alias("have")), "have")
    n_titles = asked.count()
    blocks = max(1, -(-have.count() // ROWS_EACH))
    chunks = max(1, -(-n_titles // TITLES_EACH), -(-min(LEAST_PARTS, n_titles) // blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    theirs = have.where("have is not null").select(F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int").alias("block"), each(chunks).alias("chunk"), "ord", "have")
    ours = asked.where("words is not null").select(each(blocks).alias("block"), F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("chunk"), "qid", "words", "least")
    shape = f"qid {dict(titles.dtypes)['qid']}, ord {dict(rows.dtypes)['ord']}"
    return theirs.groupBy("block", "chunk").cogroup(ours.groupBy("block", "chunk")).applyInArrow(sharing_words, shape)


def resolve_titles(titles: DataFrame, rows: DataFrame, delta: float = 0.05, share: float = WORD_SHARE) -> DataFrame:
    """qid, status, best, total of titles (qid, title_norm) among their candidates in rows (ord, title_norm, score, title_len).

    Score plus similarity decides; two at the top within ``delta`` are ambiguous.  Lengths and characters bound
    the similarity from above: the candidate with the largest bound is measured first, and then only those whose
    bound reaches what it got (less ``delta``).
    """
    scratch = Scratch(rows.sparkSession, "titles")
    q = titles.select("qid", "title_norm", F.length("title_norm").alias("len_a"), histogram(c("title_norm")).alias("hist_a"))
    r = rows.select("ord", c("title_norm").alias("their"), "score", "title_len", F.length("title_norm").alias("len_b"), histogram(c("title_norm")).alias("hist_b"))
    bound = F.when(c("title_norm") == c("their"), 1.0).otherwise(2.0 * shared_characters("a", "b") / (c("len_a") + c("len_b")))
    pairs = title_candidates(titles, rows, share).join(q, "qid").join(r, "ord").select("qid", "ord", "score", "title_len", (c("score") + bound).alias("most"))
    # numbers only; texts are joined to the pairs that are measured
    pairs = scratch.save(pairs, "pairs")
    texts = lambda x: x.join(titles.select("qid", "title_norm"), "qid").join(rows.select("ord", c("title_norm").alias("their")), "ord").select("qid", "ord", "score", "title_len", "title_norm", "their")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sim = [1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(b["title_norm"], b["their"])]
            yield b[["qid", "ord", "score", "title_len"]].assign(sim=sim)

    shape = "qid long, ord long, score double, title_len int, sim double"
    total = c("score") + c("sim")
    first = pairs.groupBy("qid").agg(F.max_by(F.struct("ord", "score", "title_len"), F.struct("most", "ord")).alias("r")).select("qid", "r.*")
    reached = texts(first).mapInPandas(measure, shape).select("qid", (total - delta).alias("reached"))
    scored = texts(pairs.join(reached, "qid").where(c("most") >= c("reached") - 1e-9)).mapInPandas(measure, shape)
    w = W.partitionBy("qid").orderBy(total.desc(), c("sim").desc(), c("title_len").desc(), c("ord"))
    top = scored.withColumns({"total": total, "place": F.row_number().over(w), "next": F.lead(total).over(w)}).where("place = 1")
    status = F.when(c("next").isNotNull() & (c("total") - c("next") <= delta), "ambiguous_requires_selection").otherwise("resolved")
    return titles.select("qid").join(top, "qid", "left").select("qid", F.when(c("ord").isNull(), "not_found").otherwise(status).alias("status"), c("ord").alias("best"), F.round("total", 6).alias("total"))


ENTRY = "ord long, paper_id string, keys array<string>, n_merged long, source_count long, trace array<string>, first_seen string, last_seen string, policy string, removed array<string>"
#: Bytes of input that one task compacts.
COMPACT_BYTES = 4 << 20
_PAPER = ("paper_id", "arxiv_id", "doi", "abstract_chars", "author_count")


def _preferred(old: dict, new: dict, asked: set[str]) -> dict:
    """The one whose arXiv id was asked for, then the one with an arXiv id, a DOI, a longer abstract, more authors; else the old one."""
    known = asked and (old["arxiv_id"] in asked) - (new["arxiv_id"] in asked)
    if known:
        return old if known > 0 else new
    score = lambda p: (bool(p["arxiv_id"]), bool(p["doi"]), p["abstract_chars"], p["author_count"])
    return old if score(old) >= score(new) else new


def compact_entries(entries: DataFrame) -> DataFrame:
    """Greedy compaction: an entry joins the first earlier entry that shares a key with it; see ENTRY for what is left.

    ``entries`` has component, ord, keys, source_count and, where they are known, paper_id, arxiv_id, doi (bare),
    abstract_chars, author_count, trace, first_seen, last_seen, policy.  Entries of different components share no
    key, so each component is worked through in order on its own.  The paper kept is the preferred one;
    ``removed`` names the others.
    """
    none = {"abstract_chars": F.lit(0), "author_count": F.lit(0), "trace": F.array().cast("array<string>")}
    full = entries.select("component", "ord", "keys", "source_count", *[(c(x) if x in entries.columns else none.get(x, F.lit(""))).alias(x) for x in (*_PAPER, "trace", "first_seen", "last_seen", "policy")])

    names = [x.split()[0] for x in ENTRY.split(", ")]

    def compacted(group: list[dict]) -> list[dict]:
        kept: list[dict] = []
        at: dict[str, int] = {}
        for e in group:
            keys, paper = set(e["keys"]), {x: e[x] for x in _PAPER}
            hits = [at[k] for k in keys if k in at]
            if hits:
                i = min(hits)
                k = kept[i]
                asked = {x[6:] for x in keys | k["keys"] if x.startswith("arxiv:") and x[6:]}
                chosen = _preferred(k["paper"], paper, asked)
                dropped = (paper if chosen is k["paper"] else k["paper"])["paper_id"]
                if dropped and dropped != chosen["paper_id"] and dropped not in k["removed"]:
                    k["removed"].append(dropped)
                k["paper"] = chosen
                k["n_merged"] += 1
                k["source_count"] = max(k["source_count"], e["source_count"])
                k["trace"] += [x for x in e["trace"] if x not in k["trace"]]
                k["first_seen"] = min(k["first_seen"], e["first_seen"]) or k["first_seen"] or e["first_seen"]
                k["last_seen"] = max(k["last_seen"], e["last_seen"])
                k["policy"] = e["policy"] or k["policy"]
            else:
                i = len(kept)
                kept.append({"ord": e["ord"], "paper": paper, "keys": set(), "n_merged": 1, "removed": [], "trace": list(dict.fromkeys(e["trace"])), **{x: e[x] for x in ("source_count", "first_seen", "last_seen", "policy")}})
            for k in keys:
                at[k] = min(at.get(k, i), i)
            kept[i]["keys"] |= keys
        return [x | {"paper_id": x["paper"]["paper_id"], "keys": sorted(x["keys"])} for x in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for b in batches:
            done: list[dict] = []
            for e in b.to_dict("records"):
                if held and held[0]["component"] != e["component"]:
                    done += compacted(held)
                    held = []
                held.append(e)
            yield pd.DataFrame([[r[n] for n in names] for r in done], columns=names)
        if held:
            yield pd.DataFrame([[r[n] for n in names] for r in compacted(held)], columns=names)

    # most components have one entry, so they pass in batches: a call for each costs more than the work
    parts = parts_by_size(full, COMPACT_BYTES)
    return full.repartition(parts, "component").sortWithinPartitions("component", "ord").mapInPandas(run, ENTRY)
