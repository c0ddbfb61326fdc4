"""The bounded search loop over many sessions at once: plan, retrieve, rank, decide.

Each cycle is one DataFrame pipeline over all sessions that are still open; the
ledger of cycles is a written table, from which a broken run goes on: sessions
that it says have ended are left alone, the others go on after their last cycle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..storage import Scratch

LEDGER = "session long, cycle int, query string, keys array<string>, move string, reason string"

c = F.col


#: Documents that one task holds, sessions that it looks up in them, and tasks at least: bounds of a task's memory, not of what is looked through.
DOCS_EACH, SESSIONS_EACH, LEAST_PARTS = 1 << 18, 100_000, 12
#: A word that one of so many documents has is kept as a flag for each document, for so many words at most; others as the list of its documents.
FLAGGED, FLAGS = 64, 512


def indexed(rows: DataFrame) -> DataFrame:
    """Different documents (key, title, score) of ``rows`` with a number, and their words.  To be written once, as numbers change."""
    return rows.select("key", "title", "score").distinct().select(F.monotonically_increasing_id().alias("doc"), "key", "title", "score", R.tokens(c("title")).alias("words"))


def best_of_block(docs: pa.Table, sessions: pa.Table, top_n: int) -> pa.Table:
    """session, doc, fit of the ``top_n`` best documents (doc, key, score, words) of each session (session, asked, probes).

    A document is found by any of the probes and fits by the words asked.  Words become numbers and documents places in
    the order of equal fits.  A session goes through its words from the rarest on; once its ``top_n`` documents fit better than
    one that has only words still to come can, the rest is left, as it can't change them.
    """
    flag = lambda x: pc.fill_null(x, False)
    docs = docs.append_column("none", pc.is_null(docs["score"])).append_column("number", pc.invert(flag(pc.is_nan(docs["score"]))))
    docs = docs.sort_by([("none", "ascending"), ("number", "ascending"), ("score", "descending"), ("key", "ascending"), ("doc", "ascending")])
    n, lists = docs.num_rows, docs["words"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    of = words.indices.to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    place = place[np.argsort(of, kind="stable")]
    start = np.r_[0, np.cumsum(np.bincount(of, minlength=len(words.dictionary)))]

    def known(name: str) -> tuple[np.ndarray, np.ndarray]:
        x = sessions[name].combine_chunks()
        at = pc.fill_null(pc.index_in(x.flatten(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
        return at, np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))]

    (asked, asked_at), (probes, probes_at) = known("asked"), known("probes")
    df = np.diff(start)
    often = [w for w in np.argsort(-df, kind="stable")[:FLAGS].tolist() if df[w] * FLAGGED >= n]
    flags = {w: np.zeros(n, dtype=bool) for w in often}
    for w in often:
        flags[w][place[start[w] : start[w + 1]]] = True
    fit, seen = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    whose, found, fits = [], [], []
    for i in range(sessions.num_rows):
        want = {w for w in asked[asked_at[i] : asked_at[i + 1]].tolist() if w >= 0}
        by = sorted({w for w in probes[probes_at[i] : probes_at[i + 1]].tolist() if w >= 0}, key=lambda w: (w not in want, df[w]))
        rare = [place[start[w] : start[w + 1]] for w in want if w not in flags]
        for x in rare:
            fit[x] += 1
        left, common, met = len(want), [w for w in want if w in flags], []
        worth = np.zeros(0, dtype=np.int64)  # larger is better, ascending
        for w in by:
            x = place[start[w] : start[w + 1]]
            if len(worth) == top_n:
                least, last = worth[0] // n, n - 1 - worth[0] % n
                if least > left:
                    break
                if least == left:  # only an earlier place is better
                    x = x[: np.searchsorted(x, last)]
            x = x[~seen[x]]
            seen[x] = True
            met.append(x)
            add = fit[x]
            for v in common:  # what has a word gone through already isn't new
                add += flags[v][x]
            worth = np.sort(_largest(np.concatenate((worth, add * n + (n - 1 - x))), top_n))
            if w in want:
                left -= 1
                common = [v for v in common if v != w]
        for x in rare:
            fit[x] = 0
        for x in met:
            seen[x] = False
        worth = worth[::-1]
        whose.append(np.full(len(worth), i))
        found.append(n - 1 - worth % n)
        fits.append(worth // n)
    none = np.zeros(0, dtype=np.int64)
    whose, found, fits = (np.concatenate(x) if x else none for x in (whose, found, fits))
    return pa.table({"session": sessions["session"].take(whose), "doc": docs["doc"].take(found), "fit": pa.array(fits, pa.int64())})


def _largest(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) <= n else np.partition(x, len(x) - n)[len(x) - n :]


def retrieve(open_sessions: DataFrame, docs: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` best documents (see ``indexed``) of each open session (session, query): most words in common, then score, then key.

    A document that has any word of the query is found.  Documents and sessions are cut into parts, and each two parts meet in one task, which gives the best of its
    documents for each of its sessions.  Sessions and documents that have a word in common are never rows: there are
    thousands a session, and they grow as the square of the tables.
    """
    tokens = R.tokens(c("query"))
    asked = open_sessions.select("session", F.array_except(tokens, F.array(*[F.lit(w) for w in R.STOP_WORDS])).alias("asked"), tokens.alias("probes")).where(F.size("probes") > 0)
    n_docs, n_sessions = docs.count(), open_sessions.count()
    blocks = max(1, -(-n_docs // DOCS_EACH))
    chunks = max(1, -(-n_sessions // SESSIONS_EACH), -(-min(LEAST_PARTS, n_sessions) // blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    theirs = docs.select(F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block"), each(chunks).alias("chunk"), "doc", "key", "score", "words")
    ours = asked.select(each(blocks).alias("block"), F.pmod(F.xxhash64("session"), F.lit(chunks)).cast("int").alias("chunk"), "session", "asked", "probes")

    def run(d: pa.Table, s: pa.Table) -> pa.Table:
        return best_of_block(d, s, top_n)

    shape = f"session {dict(open_sessions.dtypes)['session']}, doc long, fit long"
    best = theirs.groupBy("block", "chunk").cogroup(ours.groupBy("block", "chunk")).applyInArrow(run, shape).join(docs.select("doc", "key", "title", "score"), "doc")
    order = W.partitionBy("session").orderBy(c("fit").desc(), c("score").desc(), c("key"))
    return best.withColumn("place", F.row_number().over(order)).where(c("place") <= top_n).select("session", "key", "title", "score", "place")


def check_prompts(prompts: DataFrame, started: DataFrame) -> None:
    """An error if a session (session, prompt) was started with another prompt."""
    other = prompts.join(started.select("session", c("prompt").alias("_first")), "session").where(c("prompt") != c("_first"))
    first = other.select("session").head()
    if first is not None:
        raise ValueError(f"session {first[0]} was started with another prompt")


def status(ledger: DataFrame) -> DataFrame:
    """session, cycle, status, stop_reason: 'completed', 'needs_input' (waits for an answer) or 'running', after its last cycle."""
    last = ledger.groupBy("session").agg(F.max_by(F.struct("cycle", "move", "reason"), F.struct("cycle", F.when(c("reason") == "user_finalized", 1).otherwise(0))).alias("l")).select("session", "l.*")
    stopped, waits = c("move") == "stop", c("reason") == "needs_user_feedback"
    return last.select("session", "cycle", F.when(stopped & waits, "needs_input").when(stopped, "completed").otherwise("running").alias("status"), F.when(stopped, c("reason")).otherwise("").alias("stop_reason"))


def finalized(ledger: DataFrame, sessions: DataFrame) -> DataFrame:
    """The ledger with those sessions (session) that haven't ended stopped after their last cycle."""
    ended = status(ledger).where("status = 'completed'").select("session")
    last = ledger.groupBy("session").agg(F.max_by(F.struct("cycle", "query", "keys"), "cycle").alias("l"))
    stop = last.join(sessions.select("session").distinct(), "session", "left_semi").join(ended, "session", "left_anti")
    return ledger.unionByName(stop.select("session", "l.*", F.lit("stop").alias("move"), F.lit("user_finalized").alias("reason")))


def answered(ledger: DataFrame, history: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger in which the sessions of ``answers`` (session, answers, at) go on, and the history with what they said.

    An unknown session is an error.  Run the ledger on with ``run_sessions``.
    """
    unknown = answers.join(ledger, "session", "left_anti").select("session").head()
    if unknown is not None:
        raise ValueError(f"unknown session {unknown[0]}")
    waiting = status(ledger).where("status = 'needs_input'").join(answers, "session", "left_semi").select("session", c("cycle").alias("_last"))
    opened = ledger.join(waiting, "session", "left")
    move = F.when(c("cycle") == c("_last"), "continue").otherwise(c("move"))
    return opened.withColumn("move", move).drop("_last").select(*ledger.columns), history.unionByName(answers.select(*history.columns))


def run_sessions(prompts: DataFrame, rows: DataFrame, max_cycles: int = 3, top_n: int = 5, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after running sessions (session, prompt) over rows (key, title, score) to their end.

    The seed of a session is its prompt without identifiers and set phrases; later cycles go on from the best candidate.
    """
    spark = prompts.sparkSession
    scratch = Scratch(spark, "sessions")
    docs = scratch.save(indexed(rows), "docs")
    done = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    p = prompts.select("session", "prompt", F.concat(R.found_dois(c("prompt")), R.prompt_arxiv(c("prompt"))).alias("known"), R.title_hint(c("prompt")).alias("hint"))
    p = p.select("session", "prompt", "hint", R.bare_seed(c("prompt"), c("known")).alias("bare"))
    seeds = scratch.save(p.select("session", R.seed_or_hint(c("bare"), c("hint"), c("prompt")).alias("seed")), "seeds")
    for _ in range(max_cycles):
        last = done.groupBy("session").agg(F.max_by(F.struct("cycle", "query", "keys", "move"), "cycle").alias("l"))
        live = seeds.join(last, "session", "left").where("l is null or l.move = 'continue'")
        top_title = F.substring_index(F.try_element_at(c("l.keys"), F.lit(1)), "\t", -1)
        live = live.select(
            "session", (F.coalesce("l.cycle", F.lit(0)) + 1).alias("cycle"), F.coalesce("l.keys", F.array().cast("array<string>")).alias("before"),
            R.cycle_seed(c("seed"), F.coalesce("l.cycle", F.lit(0)) + 1, top_title).alias("query"),
        )
        live = scratch.save(live, "live")
        if live.isEmpty():
            break
        found = retrieve(live, docs, top_n).groupBy("session").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("\t", "key", "title").alias("k")))), lambda x: x["k"]).alias("keys"))
        cycle = live.join(found, "session", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
        step = R.cycle_decision(F.lit("theme_refine"), c("cycle"), F.lit(max_cycles), F.size("keys"), F.lit(0), c("keys") == c("before"))
        new = cycle.withColumn("d", step).select("session", "cycle", "query", "keys", "d.move", "d.reason")
        done = scratch.save(done.unionByName(new), "ledger")
    return done
