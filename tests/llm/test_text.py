"""Problems 3, 8, 9 and 10."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import mixing, stuffing, tokenize, truncation

SENTENCES = ["Recall was measured twice in the spring.", "The method needs no tuning at all.", "Most failures come from old maps.", "Results are released with the scans.", "Two of the sites withdrew before the test.", "Archives grow every year in the north."]


def texts(n, seed, k=6):
    rng = random.Random(seed)
    return [" ".join(rng.choice(SENTENCES).replace("two", str(rng.randrange(99))) for _ in range(k)) + f" Number {rng.randrange(10**6)} is the last of the scans." for _ in range(n)]


def test_limits_marks_and_tails(spark):
    whole = texts(300, 1)
    rows = [(f"w{i}", "feed", t) for i, t in enumerate(whole)] + [(f"l{i}", "feed", t[:120]) for i, t in enumerate(texts(40, 2))]
    rows += [("m1", "web", whole[0][:100] + "…"), ("m2", "web", whole[1][:100] + " [...]"), ("m3", "web", whole[2][:90] + " (continued on the site)"), ("t1", "web", "Recall was measured twice in the spring. The method needs no tun"),
             ("ok", "web", whole[3].rstrip(".")), ("p", "web", "<p>" + whole[4] + "</p>"), ("r", "web", whole[5] + " © 2001 The Authors. All rights reserved."), ("n", "web", None), ("e", "web", ""), ("na", "web", "n/a"), ("sp", None, "  ")]
    df = spark.createDataFrame(rows, "id string, source string, text string").withColumn("title", F.col("id"))
    got = {r.id: r.verdict for r in truncation.judged(df).collect()}
    cut = {f"l{i}" for i in range(40) if not texts(40, 2)[i][:120].rstrip().endswith(".")}
    assert {k for k, v in got.items() if v == "limit"} == cut
    assert {got[k] for k in ("m1", "m2", "m3")} == {"mark"} and got["t1"] == "tail"
    assert got["ok"] == got["p"] == got["r"] == got["w0"] == "whole"
    assert not {"n", "e", "na", "sp"} & got.keys()
    assert truncation.judged(df.limit(0)).count() == 0


def test_spikes_do_not_count_copies(spark):
    v = spark.createDataFrame([("s", 100 + i % 40, 100 + i % 40, i) for i in range(80)] + [("s", 70, 70, 5)] * 50, "source string, chars int, bytes int, h long")
    assert truncation.spikes(v).count() == 0


@pytest.fixture(scope="module")
def machine():
    return tokenize.automaton()


def test_encoding_is_that_of_the_public_tokenizer(machine):
    import base64
    from pathlib import Path

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokenize.vocabulary_path()).open("rb"))}
    public = tiktoken.Encoding("own", pat_str=tokenize.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    sets = ["ab", "aA ", "etaoinshr", "\n \t", "=-_*#", "éöあ漢 字\U0001f600", "0123", "Ã\u0082"]
    cases = ["", " ", "a" * 5000, "<|endoftext|> it's we'll", *["".join(rng.choice(rng.choice(sets)) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]]
    for s in cases:
        ids = machine.encode(s)
        assert ids == public.encode_ordinary(s), s
        assert machine.decode(ids) == s


def test_ids_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "map scans"), (3, "map scans")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id, r.ids) for r in tokenize.encoded(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2


def test_splitting_tree_keeps_quotas():
    shares = mixing.split_blocks([100, 7, 0, 33], 6, np.random.default_rng(1))
    assert shares.shape == (6, 4) and shares.sum(0).tolist() == [100, 7, 0, 33] and (shares >= 0).all()


def test_mix_meets_targets_within_repeats(spark):
    rng = random.Random(7)
    docs = [(i, "map scans of the north " * rng.randrange(1, 9), s) for i, s in enumerate(["big"] * 400 + ["mid"] * 120 + ["small"] * 40 + ["none"] * 9)] + [(900, None, "big"), (901, "", "mid"), (902, "x", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixed(df, targets, n_shards=4)
    rows, rep = chosen.collect(), {r.source: r for r in report.collect()}
    assert {r.source for r in rows} == {"big", "mid", "small"} and len({(r.doc_id, r["repeat"]) for r in rows}) == len(rows)
    for s, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert abs(rep[s].share - share) < 0.02 and rep[s].most_repeats <= most
    assert rep["absent"].n_rows == 0
    assert sorted(r.position for r in rows if r.shard == 1) == list(range(1, sum(r.shard == 1 for r in rows) + 1))
    assert mixing.mixed(df.limit(0), targets)[0].count() == 0


PROSE = "In the north the archives of the towns are kept by people who know that maps change, and for this reason a second survey was made. It follows that the recall of the method cannot be improved without a loss in precision. We report what was found in the two sites."


def test_stuffed_pages(spark):
    rng = random.Random(9)
    sentences = PROSE.split(". ")
    docs = [(i, ". ".join(rng.sample(sentences, 3)) + ".", "en") for i in range(60)]
    docs += [(100, "cheap thesis help, urgent thesis help, " * 40, "en"), (101, "".join(f'<a href="https://x{i}.example/p/{i}">fast essay writing</a> ' for i in range(40)), None), (102, " ".join(f"#CheapHelp{i % 7}" for i in range(60)), "de"),
             (103, PROSE + ' See <a href="https://x.example">the notes</a>. #maps', "en"), (104, None, "en"), (105, "", None), (106, "one two", "en"), (107, PROSE + " " + " ".join("Home Contact Fees Submit".split() * 60), "en"),
             (108, "References\n" + "\n".join(f"[{i}] Kur. F and Bol. A survey of maps. Annals of Maps {i}, pp. 7-13 (20{10 + i % 9})." for i in range(20)), "en"),
             (109, "On 5 maps the method is good.\n" + "\n".join(f"deep parsing | {i}.5 | {i * 3}.1 | 88" for i in range(30)), "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted(r.doc_id for r in stuffing.judged(df).where("stuffed").collect()) == [100, 101, 102, 107]
    assert stuffing.judged(df.limit(0)).count() == 0


def test_short_lists_of_links_and_tags(spark):
    rng = random.Random(10)
    docs = [(i, ". ".join(rng.sample(PROSE.split(". "), 3)) + ".", "en") for i in range(60)]
    docs += [(200, "\n".join(f"https://pages{i}.example/essay/fast-help/{i}" for i in range(12)), "en"), (201, " ".join(f"#CheapEssayHelp{c}" for c in "ABCDEFG"), "en"),
             (202, "The notes are at https://maps.example/notes/of/the/second/survey/in/the/north/and/of/its/method", "en"), (203, "See https://a.example/b and https://c.example/d", None), (204, "Maps of the north #maps", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stuffing.judged(df).where("stuffed").collect()) == [200, 201]


def test_cut_words_are_cut_at_any_size(spark):
    tail = "Recall was measured twice in the spring. The method is held against the notes of three annotators tri."
    for times in (1, 10):
        rows = [(f"w{i}", t) for i, t in enumerate(texts(300 * times, 20))] + [(f"c{i}", f"Survey {i} of the scans is new. {tail}") for i in range(times)]
        rows += [("r", f"Survey 9999 of the scans is new. {tail} Copyright 2001 The Authors.")]
        df = spark.createDataFrame(rows, "id string, text string").withColumns({"source": F.lit("feed"), "title": F.col("id")})
        got = {r.id: r.verdict for r in truncation.judged(df).collect()}
        assert {got[f"c{i}"] for i in range(times)} == {"tail"} and got["w0"] == got["w7"] == "whole"
