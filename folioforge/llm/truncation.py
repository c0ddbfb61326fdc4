"""Problem 3: text cut off by field limits or on the way.

Per source and column, the lengths of the values (in characters and in bytes)
are counted; a length that far more different texts have than its neighbours
do is a field limit, and values of such a length without terminal punctuation
are cut.  What was cut elsewhere than at a limit is found by how it ends: with
a mark that something is missing, without terminal punctuation in words
that end no sentence anywhere in the column, or with a full stop after a piece of
a word.  The ends of sentences are counted over all rows.

A text of several sentences that stands under many different titles is a notice
of the site it was fetched from, and no abstract.

Defined results: null, empty, blank and placeholder values and notices are neither cut nor
complete; values that only lack the last full stop are complete; repeated rows
are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import letters_and_digits
from ..operators.skew import attach_unique
from ..storage import Scratch
from .common import table

#: Marks that say that the rest is missing, at the end of a text: characters, what stands in brackets, words.
MARK_CHARS = ("…", "...", "\ufffd")
MARK_IN_BRACKETS = r"(?i)(?:\[(?:…|\.\.\.)\]|[(\[](?:continued|more|read more|truncated)[^)\]]*[)\]])$"
MARK_WORDS = ("read more", "continue reading", "see more")
#: What ends a sentence.
TERMINAL = ".?!。？！"
#: Rights lines, which follow a text but say nothing about its end, and what each of them has.
RIGHTS = r"(?i)(?:©|\(c\)|copyright)\s*\d{4}\b.{0,80}$"
RIGHTS_SIGNS = ("©", "(c)", "copyright")
LABEL = r"(?i)^\s*\[?(?:abstract|summary|zusammenfassung|résumé|resumen|摘要)\]?\s*[:.—–-]\s*"
TAGS = r"</?[A-Za-z][A-Za-z0-9:]*(?:\s[^<>]*)?/?>"
#: Fewer words (or characters, in scripts without blanks) than this make no abstract.
LEAST_WORDS, LEAST_WIDE = 7, 8
WIDE = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
#: A spike: so many different texts of one length, and so many times the mean of the lengths around.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_AROUND = 5, 6.0, 20
#: Words that make an end of a sentence.
END_WORDS = 4
#: A last word counts as known if it ends sentences inside texts about as often as texts (INSIDE_SHARE), or
#: so large a share of all different texts (of few texts WORD_ENDS); shares, as cuts grow in number with the texts.  Of the unknown
#: ones those are pieces of words which begin a word that sentences inside texts have among their last ones,
#: and those of SHORT_WORD letters, as words so short are few and known.
INSIDE_SHARE, WORD_SHARE, WORD_ENDS, SHORT_WORD = 0.5, 0.005, 5, 3
#: A notice: at least so many different titles, and at least this share of its rows.
NOTICE_TITLES, NOTICE_SHARE = 5, 0.5
#: Characters that are looked at for the end.
END_CHARS = 240
CUT = ("limit", "mark", "tail")
SENTENCE_END = r"[.?!]+\s+|[。？！]+"
LAST_SENTENCE = r"(?s)^.*(?:[.?!]\s+|[。？！])(?=.)"


# A step that is used more than once has a projection of its own, as nested expressions would be
# worked out again for each use.


def _replaced(rows: DataFrame, name: str, signs: tuple[str, ...], pattern: str, by: str) -> DataFrame:
    """``pattern`` replaced in those texts of column ``name`` that have one of the signs, which are quick to look for."""
    low = rows.withColumn("_low", F.lower(name) if any(x != x.upper() for x in signs) else F.col(name))
    return low.withColumn(name, F.when(reduce(Column.__or__, [F.col("_low").contains(x) for x in signs]), F.regexp_replace(name, pattern, by)).otherwise(F.col(name))).drop("_low")


def with_end(rows: DataFrame, name: str) -> DataFrame:
    """``name``: the end of ``text`` without tags, label, rights line and blanks around."""
    out = rows.withColumn(name, F.right("text", F.lit(END_CHARS)))
    out = _replaced(_replaced(out, name, ("<",), TAGS, " "), name, RIGHTS_SIGNS, RIGHTS, "")
    out = out.withColumn(name, F.when(F.length("text") <= END_CHARS, F.regexp_replace(name, LABEL, "")).otherwise(F.col(name)))
    return out.withColumn(name, F.regexp_replace(F.regexp_replace(name, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", ""))


def with_essence(rows: DataFrame, name: str) -> DataFrame:
    """``name``: a hash of all letters and digits of ``text`` but its tags, label and rights line; "&" and "and" are alike."""
    out = _replaced(_replaced(rows.withColumn(name, F.col("text")), name, ("<",), TAGS, " "), name, RIGHTS_SIGNS, RIGHTS, "")
    out = _replaced(out, name, ("&",), r"&(?:amp;)?", "and")
    return out.withColumn(name, F.xxhash64(letters_and_digits(F.regexp_replace(name, LABEL, ""))))


def is_placeholder(core: Column) -> Column:
    """Too short to be a text: "n/a", "[Abstract]", "See PDF." and the like."""
    words = F.size(F.split(core, r"\s+"))
    wide = F.regexp_count(core, F.lit(WIDE))
    return (F.length(core) < END_CHARS // 2) & (words < LEAST_WORDS) & (wide < LEAST_WIDE)


def is_marked(core: Column) -> Column:
    """Whether the end says that the rest is missing."""
    words = F.rtrim(F.lower(F.right(core, F.lit(20))), F.lit("."))
    signs = [core.endswith(x) for x in MARK_CHARS] + [words.endswith(x) for x in MARK_WORDS]
    return reduce(Column.__or__, signs) | (F.right(core, F.lit(1)).isin(")", "]") & F.right(core, F.lit(60)).rlike(MARK_IN_BRACKETS))


def _is_wide(char: Column) -> Column:
    """Whether a character is one of WIDE."""
    n = F.ascii(char)
    return n.between(0x3040, 0x30FF) | n.between(0x3400, 0x9FFF) | n.between(0xAC00, 0xD7AF)


def _end_key(sentence: Column) -> Column:
    """The last words of a sentence (the last characters where no blanks are written), numbers alike."""
    words = F.when(_is_wide(F.right(sentence, F.lit(1))), F.right(sentence, F.lit(END_WORDS))).otherwise(F.substring_index(sentence, " ", -END_WORDS))
    return F.regexp_replace(F.lower(words), r"[0-9]+(?:\.[0-9]+)?", "0")


def spikes(values: DataFrame) -> DataFrame:
    """source, kind ('chars', 'bytes'), size: the lengths that are limits.

    ``values`` has source, chars, bytes and h, a hash of the text.  Different texts are counted, so copies of one text make no
    spike.  A length counts if at least SPIKE_LEAST texts have it and SPIKE_TIMES as many as
    the mean of the SPIKE_AROUND lengths on either side.
    """
    each = values.select(
        "source", "h",
        F.explode(F.array(F.struct(F.lit("chars").alias("kind"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("kind"), F.col("bytes").alias("size")))).alias("m"),
    )
    seen = each.select("source", "m.kind", "m.size", "h").distinct().groupBy("source", "kind", "size").agg(F.count(F.lit(1)).alias("n"))
    around = W.partitionBy("source", "kind").orderBy("size").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    local = (F.sum("n").over(around) - F.col("n")) / F.lit(2.0 * SPIKE_AROUND)
    return (
        seen.withColumn("local", local)
        .where((F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * F.greatest(F.col("local"), F.lit(0.5))))
        .select("source", "kind", "size")
    )


def judged(rows: DataFrame, essence: bool = False) -> DataFrame:
    """id, source, chars, verdict of rows (id, source, text, title) that have a text; verdict is 'limit',
    'mark', 'tail' (all three cut), 'whole', or 'notice'; ``essence``, a hash of what the text says, if asked for."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "truncation")
    texts = rows.where(F.trim("text") != "")
    kept = ["essence"] if essence else []
    ended = with_end(with_essence(texts, "essence") if essence else texts, "core")
    # a filter on what is exploded stays behind the end's projections
    base = ended.select(
        "id", F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"),
        F.xxhash64("text").alias("h"), "title", *kept, F.explode(F.array("core")).alias("core"),
    ).where(~is_placeholder(F.col("core")))
    parts = base.withColumns({"last": F.regexp_replace("core", LAST_SENTENCE, ""), "open_end": ~F.right("core", F.lit(1)).isin(*TERMINAL), "marked": is_marked(F.col("core"))})
    parts = parts.withColumn("stem", F.rtrim("last", F.lit(TERMINAL)))
    light = scratch.save(parts.select(
        "id", "source", "chars", "bytes", "open_end", "marked", "h", *kept,
        F.when(F.length("last") < F.length("core"), F.xxhash64(letters_and_digits(F.col("title")))).alias("t"),
        F.when(~F.col("marked"), F.when(F.col("open_end") & F.right("core", F.lit(120)).rlike(r"(?:\)|https?://\S+)$"), F.lit(")")).otherwise(_end_key(F.col("stem")))).alias("tail"),
    ), "ends")
    limit = spikes(light.select("source", "h", "chars", "bytes"))
    shared = (
        light.where("t is not null").groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("titles"), F.sum("n").alias("n"))
        .where((F.col("titles") >= NOTICE_TITLES) & (F.col("titles") >= NOTICE_SHARE * F.col("n")))
        .select("h", F.lit(True).alias("notice"))
    )
    light = scratch.save(attach_unique(light, scratch.save(shared, "notices"), "h", "left").drop("t"), "light")
    ends = scratch.save(inner_ends(texts.select("text")), "closing")
    known = light.where("tail is not null and tail != ')'").select("tail").distinct().join(ends.select("tail", "closes"), "tail", "left")
    # the last words of texts that end in a full stop
    word = F.substring_index("tail", " ", -1)
    finals = light.where("not open_end and tail is not null and notice is null").select("h", word.alias("word"))
    inside = ends.groupBy(word.alias("word")).agg(F.sum("m").alias("m"))
    spread = finals.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    spread = scratch.save(spread.join(inside, "word", "left").select("word", "n", F.coalesce("m", F.lit(0)).alias("m")), "spread")
    often = WORD_SHARE * (spread.agg(F.sum("n")).first()[0] or 0)
    unknown = spread.where((F.col("m") < INSIDE_SHARE * F.col("n")) & (F.col("n") < F.greatest(F.lit(often), F.lit(WORD_ENDS))) & (F.col("word") != "") & ~F.col("word").rlike(r"[0-9)]|" + WIDE))
    odd = unknown.join(_beginnings(ends), "word", "left_semi").unionByName(unknown.where(F.col("word").rlike("[<&]") | (F.length("word") <= SHORT_WORD))).select("word", F.lit(True).alias("odd")).distinct()
    known = scratch.save(known.withColumn("word", word).join(odd, "word", "left").select("tail", "closes", "odd"), "known")
    with_tail = attach_unique(light.where("tail is not null"), known, "tail", "left").unionByName(light.where("tail is null"), allowMissingColumns=True)
    limit = scratch.save(limit, "limits")
    sizes = {k: limit.where(F.col("kind") == k).select(F.coalesce("source", F.lit("")).alias("source"), F.col("size").alias(k), F.lit(True).alias(f"at_{k}")) for k in ("chars", "bytes")}
    out = with_tail.join(sizes["chars"], ["source", "chars"], "left").join(sizes["bytes"], ["source", "bytes"], "left")
    at_limit = F.coalesce("at_chars", "at_bytes", F.lit(False))
    closed = F.coalesce(F.col("closes"), F.lit(False)) | (F.col("tail") == ")")
    verdict = (
        F.when(F.col("notice"), "notice")
        .when(at_limit & F.col("open_end"), "limit")
        .when(F.col("marked"), "mark")
        .when(F.col("open_end") & ~F.coalesce(closed, F.lit(False)), "tail")
        .when(~F.col("open_end") & F.coalesce(F.col("odd"), F.lit(False)), "tail")
        .otherwise("whole")
    )
    return out.select("id", "source", "chars", *kept, verdict.alias("verdict"))


def inner_ends(texts: DataFrame) -> DataFrame:
    """tail, closes (true), m: how often sentences inside texts (the last one aside) end in a tail."""
    # one pass marks the ends of sentences, and a split at a single character needs no pattern;
    # the end before a rights line is that of the text, which closes a sentence but says nothing about its last word
    ended = F.split(F.regexp_replace("text", SENTENCE_END, "\x02\x01"), "\x01")
    inner = _replaced(texts, "text", RIGHTS_SIGNS, r"[.?!。？！]+\s*" + RIGHTS, "\x03\x01").select(F.explode(ended).alias("s"))
    inner = inner.where(F.col("s").endswith("\x02") | F.col("s").endswith("\x03")).select(F.rtrim("s", F.lit("\x02\x03")).alias("s"), F.col("s").endswith("\x02").alias("own"))
    # ends as they are written are counted first, so that there are fewer to be brought into one form
    raw = F.when(_is_wide(F.right("s", F.lit(1))), F.right("s", F.lit(END_WORDS))).otherwise(F.substring_index("s", " ", -END_WORDS))
    raw = inner.groupBy(raw.alias("raw")).agg(F.count_if("own").alias("m"))
    return raw.groupBy(_end_key(F.col("raw")).alias("tail")).agg(F.lit(True).alias("closes"), F.sum("m").alias("m"))


def _beginnings(ends: DataFrame) -> DataFrame:
    """word: every beginning of a longer word among the last words of sentences inside texts (``tail``, ``m`` of them)."""
    word = ends.where("m > 0").select(F.explode(F.split("tail", " ")).alias("whole")).distinct().where("length(whole) > 1")
    return word.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("whole") - 1), lambda i: F.substring("whole", F.lit(1), i))).alias("word")).distinct()


def _abstracts(papers: DataFrame) -> DataFrame:
    return papers.select("id", "source", F.col("abstract").alias("text"), "title")


def cut_abstracts(papers: DataFrame) -> DataFrame:
    """id of each row whose abstract was cut."""
    return judged(_abstracts(papers)).where(F.col("verdict").isin(*CUT)).select("id")


def cut_rates(papers: DataFrame) -> DataFrame:
    """source, n_abstracts, n_cut, share_cut: how often each source cuts; of the cut ones, how many stand at a
    limit (n_at_limit), among them at the largest length that its limits have (n_at_longest, longest), bear a
    mark (n_marked) or only end openly (n_open)."""
    cut, is_ = F.col("verdict").isin(*CUT), lambda v: F.col("verdict") == v
    each = judged(_abstracts(papers)).where("verdict != 'notice'").groupBy("source", "chars", "verdict").agg(F.count(F.lit(1)).alias("n"))
    longest = F.max(F.when(is_("limit"), F.struct(F.col("chars"), F.col("n"))))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    by_length = each.groupBy("source").agg(
        F.sum("n").alias("n_abstracts"), count(cut).alias("n_cut"), count(is_("limit")).alias("n_at_limit"), longest.alias("top"),
        count(is_("mark")).alias("n_marked"), count(is_("tail")).alias("n_open"),
    )
    return by_length.select(
        "source", "n_abstracts", "n_cut", "n_at_limit", F.coalesce("top.n", F.lit(0)).alias("n_at_longest"), F.col("top.chars").alias("longest"), "n_marked", "n_open",
        F.round(F.col("n_cut") / F.col("n_abstracts"), 6).alias("share_cut"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_abstracts(table(spark, sf_dir, "papers"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(table(spark, sf_dir, "papers"))
