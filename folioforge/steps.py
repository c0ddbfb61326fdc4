"""The steps of a project by name, over its folder and a folder of knowledge-base tables.

Every step takes ``spark``, ``home`` (the project's folder) and ``tables`` and what else it names, and
returns a dict; results are written under ``home``/artifacts.  Batches go through the operators
directly; a step is the same for one request.
"""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace
from .functions import records as R
from .operators import knowledge as K
from .operators import merge as M
from .operators import resolve as S
from .operators import session as A
from .plans.relations import candidates, table
from .sources.tables import write_tsv
from .storage import Manifest, names_in, remove

STEPS = workspace.Steps()
SOURCES = ["xref", "preprints", "openindex", "scholargraph"]
_REQUEST = "qid long, doi string, arxiv_url string, arxiv_id string, title string"

c = F.col


def _write(home: str, name: str, what: dict) -> dict:
    path = Path(home) / "artifacts" / "retrieval" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(what, indent=2, default=str))
    return what


@STEPS.add("init")
def init(home: str, name: str, **_) -> dict:
    return {"home": str(workspace.init_project(home, name))}


@STEPS.add("retrieve-paper")
def retrieve_paper(spark: SparkSession, home: str, tables: str, title: str = "", doi: str = "", arxiv_url: str = "", arxiv_id: str = "", policy: str = "", **_) -> dict:
    """One paper by identifier or title, by the policy given or set for the project."""
    if not (title or doi or arxiv_url or arxiv_id):
        raise ValueError("give a title, a doi, an arxiv_url or an arxiv_id")
    settings = workspace.settings_of(home)["retrieval"]
    policy = policy or settings["policy"]
    policy = policy if policy in ("cache_first", "fast", "consensus") else "cache_first"
    ask = spark.createDataFrame([(1, doi, arxiv_url, arxiv_id, title)], _REQUEST)
    rows = candidates(spark, tables)
    papers = table(spark, tables, "papers").select("id", *[R.text(c(x).cast("string")).alias(x) for x in ("title", "venue", "year", "doi", "arxiv_id")], c("updated_at").alias("newest"))
    found = K.retrieve(ask, rows, papers, SOURCES, policy).head()
    out = found.asDict() if found else _by_title(ask, rows, settings["ambiguity_delta"])
    return _write(home, "paper.json", {"request": {"title": title, "doi": doi, "arxiv_url": arxiv_url, "arxiv_id": arxiv_id, "policy": policy}} | out)


def _by_title(ask: DataFrame, rows: DataFrame, delta: float) -> dict:
    q = S.lookups(ask).where("mode = 'title'").select("qid", c("value").alias("title_norm"))
    named = rows.select("ord", "id", R.title_words(c("title")).alias("title_norm"), "score", F.length("title").alias("title_len")).where("title_norm != ''")
    best = S.resolve_titles(q, named, delta).join(named.select(c("ord").alias("best"), "id"), "best", "left").head()
    return {"status": best["status"], "paper_id": best["id"] if best["status"] == "resolved" else "", "reason": "title"} if best else {"status": "not_found", "paper_id": "", "reason": "title"}


def _open(spark: SparkSession, tables: str, prompt: str, top_n: int) -> DataFrame:
    """The best records that share a word with the prompt, by how well they fit it and then by rank."""
    rows = candidates(spark, tables).withColumn("key", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")))
    overlap = R.fit_overlap(F.lit(prompt), F.concat_ws(" ", "title", "abstract", "venue"))
    fit = rows.withColumn("overlap", overlap).where(F.size("overlap") > 0).withColumn("score", F.greatest("score", R.fit_score(F.lit(prompt), c("overlap"), F.lit(False))))
    return M.top_candidates(fit.drop("overlap"), top_n)


@STEPS.add("retrieve-open")
def retrieve_open(spark: SparkSession, home: str, tables: str, prompt: str, top_n: int = 5, **_) -> dict:
    """The best records for a prompt, as a tab-separated artifact too."""
    best = _open(spark, tables, prompt, int(top_n)).select("rank", "key", "title", "year", "doi", "arxiv_id", "source", "score")
    write_tsv(best.coalesce(1), str(Path(home) / "artifacts" / "retrieval" / "open"))
    return _write(home, "open.json", {"prompt": prompt, "candidates": [r.asDict() for r in best.orderBy("rank").collect()]})


class _Kept:
    """A session's ledger and settings between runs; what a manifest names holds."""

    def __init__(self, spark: SparkSession, home: str, session: str):
        self.spark, self.root = spark, f"file://{Path(home).resolve()}/artifacts/retrieval/sessions/{session}"
        self.manifest = Manifest(spark, self.root)
        self.state = self.manifest.newest()

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(A.LEDGER).parquet(f"{self.root}/v={self.state['version']}")

    def keep(self, ledger: DataFrame, **changes) -> None:
        state = (self.state or {"version": -1, "history": []}) | changes
        state["version"] += 1
        ledger.write.mode("overwrite").parquet(f"{self.root}/v={state['version']}")
        self.manifest.commit(state)
        self.state = state
        for name in names_in(self.spark, self.root):
            if name.startswith("v=") and name != f"v={state['version']}":
                remove(self.spark, f"{self.root}/{name}")


def _kept(spark: SparkSession, home: str, session_id: str) -> _Kept:
    kept = _Kept(spark, home, session_id)
    if kept.state is None:
        raise ValueError(f"unknown session {session_id}")
    return kept


@STEPS.add("retrieve-agentic")
def retrieve_agentic(spark: SparkSession, home: str, tables: str, prompt: str, top_n: int = 5, max_cycles: int = 1, session_id: str = "", **_) -> dict:
    """A search session to its end, or on from where it was; one that has ended is left alone, another prompt is an error."""
    session_id = session_id or f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{spark.sql('select 1').select(F.substring(F.sha1(F.lit(prompt)), 1, 10)).head()[0]}"
    kept = _Kept(spark, home, session_id)
    if kept.state is not None and kept.state["prompt"] != prompt:
        raise ValueError(f"session {session_id} was started with another prompt")
    before = kept.ledger() if kept.state is not None else None
    rows = candidates(spark, tables).where("title != ''").select(c("id").alias("key"), "title", "score")
    ledger = A.run_sessions(spark.createDataFrame([(1, prompt)], "session long, prompt string"), rows, int(max_cycles), int(top_n), before)
    kept.keep(ledger, prompt=prompt, top_n=int(top_n), max_cycles=int(max_cycles))
    return agentic_status(spark=spark, home=home, session_id=session_id)


STEPS.add("retrieve-agentic-start")(retrieve_agentic)


@STEPS.add("retrieve-agentic-status")
def agentic_status(spark: SparkSession, home: str, session_id: str, **_) -> dict:
    kept = _kept(spark, home, session_id)
    last = A.status(kept.ledger()).head()
    cycle = kept.ledger().orderBy(F.desc("cycle"), F.size("keys").desc()).head()
    found = [k.split("\t", 1)[0] for k in cycle["keys"]] if cycle else []
    state = {"status": last["status"], "stop_reason": last["stop_reason"], "cycle": last["cycle"]} if last else {"status": "new", "stop_reason": "", "cycle": 0}
    return _write(home, "session.json", {"session_id": session_id, "prompt": kept.state["prompt"], "candidates": found, "answers": kept.state["history"]} | state)


@STEPS.add("retrieve-agentic-answer")
def agentic_answer(spark: SparkSession, home: str, tables: str, session_id: str, answers: dict[str, str], **_) -> dict:
    """Keep what the user answered and go on with a session that waited for it."""
    kept = _kept(spark, home, session_id)
    said = spark.createDataFrame([(1, {str(k): str(v) for k, v in answers.items()})], "session long, answers map<string, string>")
    ledger, _ = A.answered(kept.ledger(), said.limit(0), said)
    kept.keep(ledger, history=[*kept.state["history"], answers])
    return retrieve_agentic(spark, home, tables, kept.state["prompt"], kept.state["top_n"], kept.state["max_cycles"], session_id)


@STEPS.add("retrieve-agentic-finalize")
def agentic_finalize(spark: SparkSession, home: str, session_id: str, **_) -> dict:
    kept = _kept(spark, home, session_id)
    kept.keep(A.finalized(kept.ledger(), spark.createDataFrame([(1,)], "session long")))
    return agentic_status(spark=spark, home=home, session_id=session_id)


@STEPS.add("discovery")
def discovery(spark: SparkSession, home: str, theme: str, **_) -> dict:
    """Rows for a theme without any source, as a tab-separated artifact with their ids."""
    rows = spark.createDataFrame(workspace.mock_rows(theme)).withColumn("paper_id", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")))
    write_tsv(rows.coalesce(1), str(Path(home) / "artifacts" / "discovery" / "rows"), ["source", "source_id", "paper_id", "title", "venue", "year", "doi", "arxiv_id", "url"])
    return {"n_rows": rows.count()}


@STEPS.add("parsing")
def parsing(home: str, paper_id: str, text: str, **_) -> dict:
    """Sections of a text, one a paragraph: what parsing a document leaves for extraction."""
    parts = [x.strip() for x in text.split("\n\n") if x.strip()]
    out = {"paper_id": paper_id, "sections": [{"section_id": f"s{i}", "title": "", "text": x} for i, x in enumerate(parts, 1)]}
    path = Path(home) / "artifacts" / "sections" / f"{file_name(paper_id)}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(out, indent=2))
    return out


@STEPS.add("extraction")
def extraction(home: str, paper_id: str, fields: tuple[str, ...] = ("method", "result"), **_) -> dict:
    """A stand-in value for each field with evidence from the first section, unverified."""
    sections = json.loads((Path(home) / "artifacts" / "sections" / f"{file_name(paper_id)}.json").read_text())["sections"]
    first = sections[0] if sections else {"section_id": "", "text": ""}
    out = {"paper_id": paper_id, "fields": {f: {"value": f"stub_{f}", "evidence": {"section_id": first["section_id"], "quote": first["text"][:120]}, "status": "unverified"} for f in fields}}
    path = Path(home) / "artifacts" / "extractions" / f"{file_name(paper_id)}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(out, indent=2))
    return out


@STEPS.add("render")
def render(home: str, **_) -> dict:
    """A report with a line for each extraction."""
    folder = Path(home) / "artifacts" / "extractions"
    lines = [f"- {x['paper_id']}: {', '.join(sorted(x['fields']))}" for x in (json.loads(p.read_text()) for p in sorted(folder.glob("*.json")))]
    path = Path(home) / "reports" / "summary.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("# Summary\n\n" + "\n".join(lines) + "\n")
    return {"report": str(path), "lines": lines}


def file_name(paper_id: str) -> str:
    """An id as the name of a file."""
    return "".join(x if x.isalnum() or x in "-_." else "_" for x in paper_id)
