import json
from email.message import Message
from io import BytesIO
from urllib.error import HTTPError, URLError

import pytest

from folioforge import cli, workspace
from folioforge.sources import http
from folioforge.steps import STEPS

SF = "/root/testdata/sf0.001"


def answer(body, charset=""):
    out = BytesIO(body)
    out.headers = Message()
    if charset:
        out.headers["Content-Type"] = f"text/html; charset={charset}"
    return out


def test_fetching_tries_again_only_what_may_help():
    slept, asked = [], []

    def opener(*answers):
        left = list(answers)

        def open_url(url, timeout):
            asked.append(url)
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return open_url

    status = lambda code: HTTPError("u", code, "", Message(), None)
    how = {"timeout_s": 1, "min_interval_s": 0.5, "policy": http.Policy(3, 0.25, 0.3, 0.0), "sleep": slept.append}
    got = http.get_json("http://x.example", {"q": "map", "doi": "", "y": None}, open_url=opener(status(503), URLError("lost"), answer(b'{"a": 1}')), **how)
    assert got == {"a": 1} and asked[-1] == "http://x.example?q=map" and slept == [0.75, 0.8, 0.5]
    with pytest.raises(HTTPError):
        http.get_json("http://x.example", {}, open_url=opener(status(404)), **how)
    with pytest.raises(URLError):
        http.get_text("http://x.example", open_url=opener(URLError("lost")), timeout_s=1)
    assert http.get_text("u", open_url=opener(answer("é".encode("latin-1"), "latin-1")), timeout_s=1) == "é"
    assert http.get_text("u", open_url=opener(answer("é".encode(), "no-such-set")), timeout_s=1) == "é"


def test_papers_are_retrieved(spark, tmp_path):
    home = str(workspace.init_project(tmp_path, "demo"))
    p = next(r for r in spark.read.parquet(f"{SF}/papers.parquet").where("doi like '10.%/%' and title != ''").orderBy("id").collect())
    got = STEPS.run("retrieve-paper", spark=spark, home=home, tables=SF, doi=p.doi)
    assert (got["status"], got["reason"]) == ("resolved", "cache_hit_db") and json.loads((tmp_path / "demo/artifacts/retrieval/paper.json").read_text())["paper_id"] == got["paper_id"]
    fast = STEPS.run("retrieve-paper", spark=spark, home=home, tables=SF, doi=p.doi, policy="fast")
    assert fast["status"] == "resolved" and fast["paper_id"].startswith("doi:10.")
    assert STEPS.run("retrieve-paper", spark=spark, home=home, tables=SF, doi="10.1/none")["status"] == "not_found"
    assert STEPS.run("retrieve-paper", spark=spark, home=home, tables=SF, title="zzz qqq")["status"] == "not_found"
    with pytest.raises(ValueError):
        STEPS.run("retrieve-paper", spark=spark, home=home, tables=SF)
    found = STEPS.run("retrieve-open", spark=spark, home=home, tables=SF, prompt=p.title, top_n=3)
    assert [x["rank"] for x in found["candidates"]] == [1, 2, 3]


def test_sessions_are_kept(spark, tmp_path):
    home = str(workspace.init_project(tmp_path, "demo"))
    run = lambda step, **k: STEPS.run(step, spark=spark, home=home, tables=SF, **k)
    first = run("retrieve-agentic-start", prompt="papers on map scans", session_id="one", max_cycles=2)
    assert first["status"] == "completed" and first["cycle"] <= 2 and first["candidates"]
    assert run("retrieve-agentic", prompt="papers on map scans", session_id="one", max_cycles=2)["cycle"] == first["cycle"]
    with pytest.raises(ValueError):
        run("retrieve-agentic", prompt="other", session_id="one")
    with pytest.raises(ValueError):
        run("retrieve-agentic-status", session_id="none")
    assert run("retrieve-agentic-answer", session_id="one", answers={"scope": "maps"})["answers"] == [{"scope": "maps"}]
    assert run("retrieve-agentic-finalize", session_id="one")["stop_reason"] == first["stop_reason"]


def test_stand_in_steps(spark, tmp_path, capsys):
    home = str(workspace.init_project(tmp_path, "demo"))
    assert STEPS.run("discovery", spark=spark, home=home, theme="maps")["n_rows"] == 2
    assert len(STEPS.run("parsing", home=home, paper_id="doi:10.1/x", text="One.\n\nTwo.")["sections"]) == 2
    assert STEPS.run("extraction", home=home, paper_id="doi:10.1/x")["fields"]["method"]["evidence"]["quote"] == "One."
    assert STEPS.run("render", home=home)["lines"] == ["- doi:10.1/x: method, result"]
    assert cli.main(["step", "render", "--home", home]) == 0 and "summary.md" in capsys.readouterr().out
    with pytest.raises(ValueError):
        STEPS.run("nothing")
