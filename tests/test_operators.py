import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import records as R
from folioforge.functions.canonical import canonical_arxiv, canonical_doi
from folioforge.operators import dml, merge, resolve, session, similarity
from folioforge.operators.components import connected_components, star_edges
from folioforge.operators.session import run_sessions
from folioforge.operators.skew import attach_unique, salted
from folioforge.sources import connectors, datasource, tables
from folioforge.streaming import events


def one(spark, **columns):
    return spark.sql("select 1 as one").select(*[c.alias(k) for k, c in columns.items()]).first()


def test_identifier_forms(spark):
    cases = {"HTTPS://DOI.ORG/10.99062/S01-24?via=feed": "10.99062/s01-24", " 10.99045 / 63up": "10.99045/63up", "<10.1234/a.b>": "10.1234/a.b", "info:doi/10.1234/x.": "10.1234/x",
             "https://doi.org/10.1234%2Fq": "10.1234/q", "10.": None, "n/a": None, "": None, None: None}
    got = {r.v: r.d for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", canonical_doi(F.col("v")).alias("d")).collect()}
    assert got == cases
    cases = {"http://arxiv.org/pdf/1702.30111v2.pdf": "1702.30111", "arXiv:hep-th/9901001v3": "hep-th/9901001", "https://arxiv.org/abs/2306.3003?context=all": "2306.3003", " 2502.30521\n": "2502.30521", "arXiv:": None, "pending": None, "https://x.example/item?id=0": None}
    got = {r.v: r.a for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", canonical_arxiv(F.col("v")).alias("a")).collect()}
    assert got == cases


def test_record_functions(spark):
    lit = F.lit
    assert one(spark, a=R.bare_arxiv(lit("https://arxiv.org/pdf/2401.12345v2.pdf")), b=R.bare_doi(lit(" DOI:10.1/X")), c=R.alias_arxiv(lit("https://doi.org/10.48550/arXiv.1706.03762")), d=R.title_words(lit("A  Graph-based\nWay!"))) == ("2401.12345", "10.1/x", "1706.03762", "a graph based way")
    assert one(spark, k=R.query_key(lit("10.48550/arXiv.1706.03762"), lit(""), lit(""), lit("")))[0] == "arxiv:1706.03762"
    assert one(spark, k=R.query_key(lit(None).cast("string"), lit(""), lit(""), lit(None).cast("string")))[0] == "empty"
    assert one(spark, t=R.clean(lit("<p>a &lt;b&gt;  c</p>")), s=R.shorten(lit("abcdef"), 4), d=R.distinct_terms(F.array(lit("A"), lit(" a"), lit("b")))) == ("a c", "abc…", ["A", "b"])
    d = one(spark, x=R.cycle_decision(lit("theme_refine"), lit(2), lit(3), lit(2), lit(0), lit(True)))[0]
    assert (d.move, d.reason) == ("stop", "converged_candidate_set")


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (60, 70), (30, 29)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1, 1), (None, 2), (5, 5)]
        if m == 29:
            order = list(range(n))
            rng.shuffle(order)
            edges = list(zip(order, order[1:]))  # one long chain
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == brute_components(edges)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_star_edges_connect_a_hot_key(spark):
    rows = [("hot", f"n{i:04d}") for i in range(500)] + [("cold", "x"), ("cold", "y"), (None, "z"), ("solo", "s")]
    edges = star_edges(spark.createDataFrame(rows, "k string, n string"), "k", "n")
    comp = {r.node: r.component for r in connected_components(edges).collect()}
    assert len(comp) == 502 and {comp[f"n{i:04d}"] for i in range(500)} == {"n0000"} and comp["y"] == "x" and "z" not in comp
    assert edges.count() < 700  # far from all pairs


def test_attach_unique_on_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, "h").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id")
    unique = rows.select("k").distinct().withColumn("v", F.length("k"))
    for out in (attach_unique(rows, unique, "k"), salted(rows, unique, "k")):
        assert out.count() == 5000 and out.select("id").distinct().count() == 5000 and out.where("v != length(k)").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", min_size=12, max_size=60), st.integers(0, 3), st.randoms())
def test_pieces_lose_no_similar_pair(a, k, rng):
    b = list(a)
    for _ in range(k):
        b[rng.randrange(len(b))] = rng.choice("abcdxyz ")
    b = "".join(b)
    if a.strip() != a or b.strip() != b or a == b or SequenceMatcher(None, a, b).ratio() < similarity.RATIO:
        return

    def size(n):
        return max(n // (int((1 - similarity.RATIO) * 2 * n / similarity.RATIO) + 1), 1)

    s = size(len(a))
    assert any(a[i * s : i * s + s] in b for i in range(len(a) // s))


def test_similar_titles_against_brute_force(spark):
    base = ["a survey of layered parsing for web archives", "drift and recall in the talel catalogue", "towards robust matching of map scans"]
    rng = random.Random(5)
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcdefg")
        rows.append((i, " ".join("".join(t).split()), rng.choice(["2020", "2021", ""])))
    df = spark.createDataFrame(rows, "ord long, title_norm string, year string")
    got = brute_components([(r.a, r.b) for r in similarity.similar_titles(df).collect()])
    want = brute_components([(i, j) for i, t, y in rows for j, u, z in rows if i < j and y and y == z and SequenceMatcher(None, t, u).ratio() >= similarity.RATIO])
    assert got == want


def test_merge_and_rank_ties(spark):
    rows = spark.createDataFrame([(1, "k", 0.5, "", "", "aa"), (2, "k", 0.9, "d", "", "b"), (3, "k", 0.9, "", "a", "ccc"), (4, "m", 0.9, "d", "", "b"), (5, "n", 0.1, "", "", "")], "ord long, key string, score double, doi string, arxiv_id string, title string")
    got = [(r.rank, r.key, r.ord) for r in merge.top_candidates(rows, 10).orderBy("rank").collect()]
    assert got == [(1, "k", 2), (2, "m", 4), (3, "n", 5)]


def test_changes(spark):
    old = spark.createDataFrame([("a", 1, "t0"), ("b", 2, "t0")], "id string, v int, created_at string")
    new = spark.createDataFrame([("b", None, "t1"), ("c", 3, "t1")], "id string, v int, created_at string")
    assert sorted(map(tuple, dml.upsert(old, new, "id").collect())) == [("a", 1, "t0"), ("b", None, "t0"), ("c", 3, "t1")]
    kept = dml.replace_children(old, new, new, "id").select("id", "v").collect()
    assert sorted((r.id, r.v is None) for r in kept) == [("a", False), ("b", True), ("c", False)]
    assert [r.v for r in dml.latest(old.unionByName(new), ["id"], ["created_at"]).orderBy("id").collect()] == [1, None, 3]


def test_compaction_is_greedy(spark):
    e = spark.createDataFrame([(1, ["a"], 1, 0), (2, ["b"], 5, 0), (3, ["a", "b"], 2, 0)], "ord long, keys array<string>, source_count long, component long")
    assert sorted((r.ord, r.n_merged, r.source_count, len(r["keys"])) for r in resolve.compact_entries(e).collect()) == [(1, 2, 2, 2), (2, 1, 5, 1)]


def test_title_resolution(spark):
    t = spark.createDataFrame([(1, "deterministic systems"), (2, "cache systems for llm"), (3, "nothing alike here")], "qid long, title_norm string")
    rows = spark.createDataFrame([(1, "deterministic systems", 0.6, 21), (2, "cache systems for llm", 0.6, 21), (3, "cache systems for llms", 0.6, 22)], "ord long, title_norm string, score double, title_len int")
    got = {r.qid: r.status for r in resolve.resolve_titles(t, rows).collect()}
    assert got == {1: "resolved", 2: "ambiguous_requires_selection", 3: "not_found"}


def test_tsv_round_trip_and_older_layout(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", ' "q" ', ["x", "", "y"]), (None, "é", [])], "t string, u string, l array<string>")
    tables.write_tsv(df, str(tmp_path / "x"), ["t", "u", "l", "gone"])
    got = sorted(map(tuple, tables.read_tsv(spark, str(tmp_path / "x"), ["t", "u", "l", "gone", "later"]).collect()))
    assert got == [("", "é", "", "", ""), ("a\tb", ' "q" ', "x|y", "", "")]


def test_paged_source_and_retries(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"results": [{"source": "s", "title": "Map scans", "year": 2020}, {"source": "s", "title": "Map scans", "year": 1999}, {"source": "s", "title": "Other", "year": 2020}]}')
    datasource.register(spark)
    rows = spark.read.format("paged_json").option("path", str(tmp_path)).option("theme", "map").option("year_min", 2000).load().collect()
    assert [(r.title, r.year, r.doi) for r in rows] == [("Map scans", "2020", "")]
    (tmp_path / "p2.json").write_text('{"results": [{"source": "t", "title": "Map scans two", "venue": "V"}, {"source": "t", "title": "Map scans three", "venue": "W"}]}')
    read = spark.read.format("paged_json").option("path", str(tmp_path))
    assert [r.title for r in read.option("venues", "v|u").option("limit", 3).load().collect()] == ["Map scans", "Map scans", "Other"]
    assert [r.title for r in spark.read.format("paged_json").option("path", str(tmp_path)).load().where("source = 't' and venue in ('W', 'X') and length(title) > 3").collect()] == ["Map scans three"]
    tried, slept = [], []

    def call():
        tried.append(1)
        if len(tried) < 3:
            raise TimeoutError
        return 7

    assert datasource.with_retries(call, 4, 0.1, 0.15, slept.append) == 7 and slept == [0.1, 0.15]


def test_connector_quirks(spark):
    pay = spark.createDataFrame([('{"results": [{"title": "t", "url": "https://arxiv.org/abs/2401.12345v2", "metadata": {"doi": "doi:10.1/X", "journal": "J", "year": 2020}}, {"title": "u", "url": "", "metadata": {"year": 1990}}]}',), ("broken",)], "payload string")
    assert [(r.doi, r.arxiv_id, r.year) for r in connectors.searx(pay, 5, (2000, 2030)).collect()] == [("10.1/x", "2401.12345", "2020")]
    pay = spark.createDataFrame([('{"DOI": "10.1/X", "title": ["T"]}',)], "payload string")
    assert [(r.year, r.venue) for r in connectors.crossref(pay, ["asked"]).collect()] == [("0", "")]


def test_stream_twins(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(src / "a"))
    got = {(r.user_id, r.event_type): r.event_id for r in events.latest_events(spark, str(src / "a")).collect()}
    want = {(r.user_id, r.event_type): r.event_id for r in dml.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).collect()}
    assert got == want
    counted = []
    events.run_available(events.event_windows(events.read_events(spark, str(src / "a"), 10)), lambda b, i: counted.extend(b.collect()), str(tmp_path / "cp"), "update")
    assert sum(r.n for r in counted) >= e.count() > 0


def test_latest_table_loses_nothing(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, t int, v string")
    root, made = f"file://{tmp_path}/t", lambda: events.LatestTable(spark, f"file://{tmp_path}/t", ["k"], ["t"])
    state = made()
    state.apply(rows(("a", 1, "x"), ("b", 1, "y")), 0)
    state.apply(rows(("c", 1, "z")), 1)
    state.apply(rows(("c", 1, "z")), 1)  # the same batch again
    again = made()  # another process
    again.apply(rows(("a", 2, "w")), 2)
    want = [("a", 2, "w"), ("b", 1, "y"), ("c", 1, "z")]
    assert sorted(map(tuple, again.table().collect())) == want == sorted(map(tuple, made().table().collect()))
    # a crash after a version was written and before it was named: the batch is run again
    rows(("b", 9, "half")).write.parquet(f"{root}/v={again.state['version'] + 1}")
    late = made()
    late.apply(rows(("d", 1, "q")), 3)
    assert sorted(map(tuple, late.table().collect())) == [*want, ("d", 1, "q")]


def test_sessions_converge_and_resume(spark):
    rows = spark.createDataFrame([(f"k{i}", f"parsing of map scans number{i}", 0.1 * i) for i in range(4)], "key string, title string, score double")
    prompts = spark.createDataFrame([(1, "map scans"), (2, "volcanoes")], "session long, prompt string")
    ledger = run_sessions(prompts, rows, max_cycles=4)
    end = {r.session: (r.cycle, r.reason) for r in ledger.groupBy("session").agg(F.max_by(F.struct("cycle", "reason"), "cycle").alias("l")).select("session", "l.*").collect()}
    assert end[2] == (1, "no_candidates") and end[1][1] in ("converged_candidate_set", "cycle_budget_reached")
    again = run_sessions(prompts, rows, max_cycles=4, ledger=ledger)
    assert again.count() == ledger.count()  # ended sessions are left alone


def test_sessions_are_asked_answered_and_ended(spark):
    ledger = spark.createDataFrame([(1, 1, "q", ["a"], "continue", "minimum_refinement_cycles_not_met"), (2, 1, "q", ["a"], "stop", "needs_user_feedback"), (3, 1, "q", [], "stop", "no_candidates")], session.LEDGER)
    state = lambda x: {r.session: (r.status, r.stop_reason) for r in session.status(x).collect()}
    assert state(ledger) == {1: ("running", ""), 2: ("needs_input", "needs_user_feedback"), 3: ("completed", "no_candidates")}
    ended = session.finalized(ledger, ledger.select("session"))
    assert state(ended) == {1: ("completed", "user_finalized"), 2: ("completed", "user_finalized"), 3: ("completed", "no_candidates")}
    assert state(session.finalized(ended, ledger.select("session"))) == state(ended)
    history = spark.createDataFrame([], "session long, answers map<string, string>, at string")
    answer = spark.createDataFrame([(2, {"scope": "maps"}, "t1")], history.schema)
    going, said = session.answered(ledger, history, answer)
    assert state(going)[2][0] == "running" and said.count() == 1
    started = spark.createDataFrame([(1, "maps")], "session long, prompt string")
    session.check_prompts(started, started)
    for wrong in (lambda: session.check_prompts(spark.createDataFrame([(1, "seas")], started.schema), started), lambda: session.answered(ledger, history, answer.withColumn("session", F.lit(9).cast("long")))):
        try:
            wrong()
        except ValueError:
            continue
        raise AssertionError


def test_best_documents_of_a_block():
    """Sessions against documents one by one; a word that all documents have makes no more rows than one that few have."""
    import random

    import pyarrow as pa

    from folioforge.operators.session import best_of_block

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, f"k{rnd.randrange(40):02d}", rnd.choice([None, 0.5, 0.25, float("nan")]), ["all", *rnd.sample(words, rnd.randrange(6))]) for i in range(60)]
    asked = [(s, rnd.sample([*words, "none"], 4)) for s in range(25)]
    sessions = [(s, a, [a[0], a[1], "all"][: s % 4]) for s, a in asked]
    table = lambda rows, names: pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    got = best_of_block(table(docs, ["doc", "key", "score", "words"]), table(sessions, ["session", "asked", "probes"]), 3)
    want = []
    for s, a, probes in sessions:
        hits = [d for d in docs if set(d[3]) & set(probes)]
        hits.sort(key=lambda d: (-len(set(a) & set(d[3])), d[2] is None, d[2] == d[2], -(d[2] or 0) if d[2] == d[2] else 0, d[1], d[0]))
        want += [(s, d[0], len(set(a) & set(d[3]))) for d in hits[:3]]
    assert list(zip(*[got[x].to_pylist() for x in ("session", "doc", "fit")])) == want


def test_compaction_over_batches(spark):
    """Components pass through Python in batches, not in a call each, also where a batch ends inside one."""
    from folioforge.operators import resolve

    e = spark.createDataFrame([(k // 5, k, [f"doi:{k // 5}" if k % 5 else f"doi:{k}", f"title:{k // 2}"], 1) for k in range(40)], "component long, ord long, keys array<string>, source_count long")
    out = resolve.compact_entries(e)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    show = lambda: sorted((r.ord, r.n_merged, tuple(r["keys"])) for r in out.collect())
    whole = show()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = resolve.compact_entries(e)
        assert show() == whole and sum(n for _, n, _ in whole) == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_that_share_words():
    """Titles against rows one by one, with words that nearly all rows have."""
    import random

    import pyarrow as pa

    from folioforge.operators.resolve import sharing_words

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    rows = [(i * 7, ["all", *rnd.sample(words, rnd.randrange(7))]) for i in range(70)]
    titles = [(q, rnd.sample([*words, "all", "none"], 5), 1 + q % 5) for q in range(30)]
    table = lambda rows, names: pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    got = sharing_words(table(rows, ["ord", "have"]), table(titles, ["qid", "words", "least"]))
    assert sorted(zip(got["qid"].to_pylist(), got["ord"].to_pylist())) == sorted((q, o) for q, w, k in titles for o, h in rows if len(set(w) & set(h)) >= k)


def test_pieces_of_titles_are_not_gathered_on_the_driver(spark, monkeypatch):
    from folioforge import storage
    from folioforge.operators.similarity import similar_titles

    plans, save = {}, storage.Scratch.save
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(storage.Scratch, "save", lambda self, df, tag="t", **k: (plans.update({tag: planned(df)}), save(self, df, tag, **k))[1])
    rows = spark.createDataFrame([(1, "deep learning for birds", "2020"), (2, "deep learning for bards", "2020"), (3, "deep learning for birds", "2021"), (4, "tidal maps", "2020")], "ord long, title_norm string, year string")
    edges = similar_titles(rows)
    assert "SortMergeJoin [piece" in plans["pairs"] and "Broadcast" not in plans["pairs"]
    assert not [x for x in planned(edges).splitlines() if "BroadcastHashJoin [a#" in x or "BroadcastHashJoin [b#" in x]
    assert {(r.a, r.b) for r in edges.collect()} == {(1, 2)}


def test_sessions_find_documents_without_rare_words(spark):
    """The best document has none of the query's three rarest words; a word that is no part of the fit finds documents, too."""
    titles = ["alpha noise", "bravo noise", "charlie noise", *[f"graph tensor kernel filler{i}" for i in range(5)], "graph tensor kernel sparse", "sparse noise", *[f"sparse other{i}" for i in range(9)], "notes from sea"]
    rows = spark.createDataFrame([(f"k{i:02d}", t, 0.5) for i, t in enumerate(titles)], "key string, title string, score double")
    open_sessions = spark.createDataFrame([(1, "alpha bravo charlie graph tensor kernel sparse"), (2, "from"), (3, "none of it")], "session long, query string")
    found = {(r.session, r.place): r.title for r in session.retrieve(open_sessions, session.indexed(rows).localCheckpoint(), 2).collect()}
    assert found == {(1, 1): "graph tensor kernel sparse", (1, 2): "graph tensor kernel filler0", (2, 1): "notes from sea"}


def test_best_documents_of_a_block_with_all_words_as_probes():
    """Common and rare words, many equal fits: what is left aside changes nothing."""
    import random

    import pyarrow as pa

    from folioforge.operators.session import best_of_block

    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    pick = lambda k: list({words[min(299, int(rnd.paretovariate(0.6)) - 1)] for _ in range(k)})
    docs = [(i, f"k{i:04d}", rnd.randrange(5) / 5, pick(9)) for i in range(700)]
    sessions = [(s, p[: rnd.randrange(len(p) + 1)], p) for s in range(150) for p in [pick(8)]]
    table = lambda rows, names: pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    got = best_of_block(table(docs, ["doc", "key", "score", "words"]), table(sessions, ["session", "asked", "probes"]), 5)
    want = []
    for s, a, probes in sessions:
        hits = sorted((d for d in docs if set(d[3]) & set(probes)), key=lambda d: (-len(set(a) & set(d[3])), -d[2], d[1]))
        want += [(s, d[0], len(set(a) & set(d[3]))) for d in hits[:5]]
    assert list(zip(*[got[x].to_pylist() for x in ("session", "doc", "fit")])) == want
