import hashlib
import json

from pyspark.sql import functions as F

from folioforge import cli, workspace
from folioforge.functions import digest


def test_project_folders_and_overlay(tmp_path):
    home = workspace.init_project(tmp_path, "demo")
    (home / "project.json").write_text(json.dumps({"retrieval": {"policy": "fast"}, "own": 1}))
    assert workspace.init_project(tmp_path, "demo") == home
    s = workspace.settings_of(home)
    assert s["retrieval"]["policy"] == "fast" and s["retrieval"]["ambiguity_delta"] == 0.05 and s["own"] == 1
    assert workspace.list_artifacts(home) == ["project.json"]
    assert [r["source_id"] for r in workspace.mock_rows("maps")] == ["mock-1", "mock-2"]


def test_steps_by_name():
    steps = workspace.Steps()

    @steps.add("double")
    def double(n):
        return 2 * n

    assert steps.run("double", n=4) == 8
    try:
        steps.run("other")
    except ValueError as e:
        assert "double" in str(e)
    else:
        raise AssertionError


def test_command_line_lists_queries(capsys):
    assert cli.main(["list"]) == 0
    assert "q_rank_candidates" in capsys.readouterr().out


def test_json_digest_and_parsers(spark):
    rows = [("S ", "", "Té", "2020", "doi:10.1/X", "", "u"), (None, " 7 ", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "source string, source_id string, title string, year string, doi string, arxiv_id string, url string")
    got = [r[0] for r in df.select(digest.raw_row_key(*[F.col(x) for x in df.columns])).collect()]
    text = json.dumps({"title": "Té", "year": "2020", "doi": "10.1/x", "arxiv_id": "", "url": "u"}, sort_keys=True)
    assert got == [f"s:fallback:{hashlib.sha1(text.encode()).hexdigest()[:16]}", "unknown:7"]
    x = spark.createDataFrame([("s1|Intro|a|b", "k=1, j = x=y,z,k=2", " 12 "), (None, None, "x")], "s string, a string, i string").select(digest.section(F.col("s")).alias("s"), digest.answers(F.col("a")).alias("a"), digest.safe_int(F.col("i"), 5).alias("i")).collect()
    assert (tuple(x[0].s), x[0].a, x[0].i) == (("s1", "Intro", "a|b"), {"k": "2", "j": "x=y"}, 12)
    assert (tuple(x[1].s), x[1].a, x[1].i) == (("", "", ""), {}, 5)


def test_nothing_imports_the_optional_subpackage():
    from pathlib import Path

    import folioforge

    root = Path(folioforge.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and ("llm" in p.read_text())]
