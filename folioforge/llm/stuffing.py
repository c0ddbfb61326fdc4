"""Problem 10: keyword-stuffed pages, link lists and pages of product tags.

Every page gets its rank-frequency curve: words are counted by page, ranked in
a SQL window, and a line is fitted to log count against log rank.  Three
figures are held against those of the pages in the same language and of like
length: the slope, the residual of the fit, and the divergence of the page's
share of head words (the words that most texts of its language have) from that
of prose.  A page extreme in any of them is a candidate.  The check that
follows asks how much of a candidate can be prose, given its share of head
words: pages with less than half are flagged, unless they are tables of results
or lists of references, which have their own marks.

The language is the one whose head words the page has most of, as labels are
often wrong.  All counts are over all pages.

Texts under LEAST_WORDS words are too short for a curve; they are flagged if
addresses and tags make most of them and, taken apart, come to LEAST_WORDS.

Defined results: null, empty and blank texts and other texts under LEAST_WORDS
words are never flagged; copies are judged alike; a language of which there is little
text is held against all pages together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch, parts_by_size
from .common import table

#: Head words a language, and the share of all texts a language needs to have its own.
HEAD_WORDS, LANGUAGE_SHARE = 30, 0.005
#: And pages, so that no page is a language of its own.
LEAST_PAGES = 3
LEAST_WORDS = 16
#: Addresses and tags that make a short list of them.
LEAST_LINKS = 3
#: Less prose than PROSE_SHARE is stuffing; the share of a page of n words is known to about PROSE_ERROR / sqrt(n).
PROSE_SHARE, PROSE_ERROR = 0.5, 0.75
#: Median deviations from the median that make a slope or a residual extreme; nats of divergence that do.
EXTREME, DIVERGENT = 3.0, 0.05
#: Share of the lines (of one line: of what stands between sentences) that marks a list of references; of words that marks a table.
REFERENCE_LINES, TABLE_NUMBERS = 0.5, 0.3

_WIDE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Words; in texts with scripts that write no blanks each of their characters gets blanks around it before.
WORD = r"[\p{L}\p{M}]+|[0-9]+"
TAG = r"<[^<>]{1,400}>"
ADDRESS = r"(?i)(?:https?://|www\.)[^\s<>\")\]]+"
HASHTAG = r"(?<![\p{L}\p{N}&/])#[\p{L}\p{M}][\p{L}\p{M}\p{N}_]*"
#: Words of addresses and tags taken apart, at capitals too.
PART = rf"[{_WIDE}]|\p{{Lu}}?[\p{{Ll}}\p{{M}}]+|\p{{Lu}}+|[\p{{L}}&&[^\p{{Lu}}\p{{Ll}}{_WIDE}]]+|[0-9]+"
REFERENCE = r"(?i)\(?\b(?:19|20)[0-9]{2}[a-z]?\b\)?"
PAGES = r"(?i)\b(?:pp?\.\s*[0-9]+|[0-9]+\s*[-–]\s*[0-9]+|et al\b|vol\.|doi)"
PRICE = r"(?i)(?:[$€£¥]\s?[0-9]|\b(?:sku|art|item|ref)[-# ]?[0-9]{3,})"


#: Bytes of documents that one task takes apart; candidates whose ids (8 bytes each) are sent to all executors.
PAGE_BYTES, FEW_IDS = 4 << 20, 1_000_000


def page_words(pages: DataFrame) -> DataFrame:
    """pages (text and other columns) with their ``words`` in place of the text: lower-cased, without tags, an address
    being one word; scripts without blanks give single characters.  Steps that few texts need are looked for first."""
    has = lambda *signs: F.exists(F.array(*[F.lit(x) for x in signs]), lambda x: F.col("text").contains(x))
    bare = pages.withColumn("text", F.lower("text"))
    bare = bare.withColumn("text", F.when(F.col("text").contains("<"), F.regexp_replace("text", TAG, " ")).otherwise(F.col("text")))
    bare = bare.withColumn("text", F.when(has("http", "www."), F.regexp_replace("text", ADDRESS, " urladdress ")).otherwise(F.col("text")))
    wide = F.octet_length("text") > F.length("text")
    bare = bare.withColumn("text", F.when(wide, F.regexp_replace("text", f"([{_WIDE}])", " $1 ")).otherwise(F.col("text")))
    return bare.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).drop("text")


def _is_number(word: Column) -> Column:
    """Words are letters or digits throughout."""
    return F.ascii(word).between(48, 57)


def _word_number(word: Column) -> Column:
    """A word as a number, which is odd if the word is one: pages are counted by it, as numbers are quicker than texts."""
    h = F.xxhash64(word)
    return F.when(_is_number(word), h.bitwiseOR(F.lit(1).cast("long"))).otherwise(h.bitwiseAND(F.lit(-2).cast("long")))


def _marks(text: Column) -> dict[str, Column]:
    """Shares that tell tables and lists of references from stuffing."""
    lines = F.filter(F.split(text, r"\n+"), lambda s: F.length(F.trim(s)) > 0)
    count = F.greatest(F.size(lines), F.lit(1))
    cited = F.size(F.filter(lines, lambda s: s.rlike(REFERENCE) & s.rlike(PAGES)))
    celled = F.size(F.filter(lines, lambda s: s.rlike(r"(?:[|\t;,]|\s{2,})\s*[0-9]+(?:[.,][0-9]+)?\s*(?:%|±|[|\t;,]|\s{2,}|$)")))
    return {"cited": cited / count, "celled": celled / count, "priced": F.regexp_count(text, F.lit(PRICE))}


def _links(text: Column) -> dict[str, Column]:
    """Addresses (those in markup too) and tags of a page, and its size in words with these taken apart; of long pages none are counted."""
    few = F.size(F.split(text, r"\s+", 8 * LEAST_WORDS)) < 8 * LEAST_WORDS
    return {
        "links": F.when(few, F.regexp_count(text, F.lit(ADDRESS)) + F.regexp_count(text, F.lit(HASHTAG))).otherwise(0),
        "parts": F.when(few, F.regexp_count(text, F.lit(PART))).otherwise(0),
    }


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, lang (found, not labelled), n, slope, residual, divergence, prose, extreme, stuffed; one row a page that has words."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "stuffing")
    pages = documents.where(F.trim("text") != "")
    label = F.coalesce(F.nullif(F.regexp_extract(F.lower("lang"), r"^([a-z]{2,3})(?:[^a-z]|$)", 1), F.lit("")), F.lit("?"))
    labelled = pages.select("doc_id", label.alias("label"), "text")
    size = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("pages"))
    size = size.withColumn("kept", F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), LANGUAGE_SHARE * F.sum("pages").over(W.partitionBy()))).where("kept and label != '?'").select("label", "pages")
    each = page_words(labelled.select("label", "text")).select("label", F.explode(F.array_distinct("words")).alias("word"))
    by_word = each.where(~_is_number(F.col("word"))).groupBy("label", "word").agg(F.count(F.lit(1)).alias("df"))
    # at most HEAD_WORDS words for each of at most 1 / LANGUAGE_SHARE languages: a bounded table
    heads = (
        by_word.join(F.broadcast(size), "label")
        .withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(F.desc("df"), "word")))
        .where(F.col("place") <= HEAD_WORDS).groupBy("word").agg(F.collect_list("label").alias("langs"))
    )
    heads = scratch.save(heads, "heads")
    langs = sorted(r[0] for r in heads.select(F.explode("langs")).distinct().collect())

    # texts are shuffled, not words: a page's words stay in its task for the counts and the window
    placed = labelled.repartition(parts_by_size(labelled, PAGE_BYTES), "doc_id")
    words = page_words(placed.select("doc_id", "text")).select("doc_id", F.explode("words").alias("word")).select("doc_id", _word_number(F.col("word")).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("f"))
    # which of equally frequent words comes first makes no difference to the fit
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("f")))
    bits = lambda k: sum((F.when(F.array_contains("langs", code), 1 << i).otherwise(0) for i, code in enumerate(langs[60 * k : 60 * k + 60])), F.lit(0).cast("long"))
    masks = [f"_mask_{k}" for k in range(len(langs) // 60 + 1)]
    heads = heads.select(_word_number(F.col("word")).alias("word"), *[bits(k).alias(m) for k, m in enumerate(masks)])
    marked = words.join(F.broadcast(heads), "word", "left").withColumn("rank", rank)
    number = F.col("word").bitwiseAND(F.lit(1)) == 1
    x, y = F.log("rank"), F.log("f")
    hits = [F.sum(F.when(F.col(f"_mask_{i // 60}").bitwiseAND(F.lit(1 << (i % 60))) != 0, F.col("f")).otherwise(0)).alias(f"_in_{i}") for i in range(len(langs))]
    curve = marked.groupBy("doc_id").agg(
        F.sum("f").alias("all_words"), F.sum(F.when(number, 0).otherwise(F.col("f"))).alias("n"), F.count(F.lit(1)).alias("v"),
        F.sum(F.when(F.col("_mask_0").isNotNull(), F.col("f")).otherwise(0)).alias("head"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), *hits,
    )
    v = F.col("v")
    sxx, sxy, syy = F.col("sxx") - F.col("sx") ** 2 / v, F.col("sxy") - F.col("sx") * F.col("sy") / v, F.col("syy") - F.col("sy") ** 2 / v
    slope = F.coalesce(sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(F.col(f"_in_{i}").alias("k"), F.lit(code).alias("code")) for i, code in enumerate(langs)])) if langs else None
    found = F.when(best["k"] > 0, best["code"]).otherwise(F.col("label")) if langs else F.col("label")
    curve = curve.join(labelled.select("doc_id", "label"), "doc_id")
    fitted = scratch.save(curve.select(
        "doc_id", found.alias("lang"), "n", "all_words", (F.col("head") / F.greatest("n", F.lit(1))).alias("covered"), slope.alias("slope"),
        F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0)) / v).alias("residual"), F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int").alias("scale"),
    ), "curves")

    # the same figures of like pages; few languages and lengths, so a small table
    mid = lambda c: F.percentile_approx(c, 0.5, 200)
    centre = fitted.where(F.col("n") >= LEAST_WORDS).groupBy("lang", "scale").agg(mid("slope").alias("m_slope"), mid("residual").alias("m_residual"), mid("covered").alias("m_covered"), F.count(F.lit(1)).alias("like"))
    overall = fitted.where(F.col("n") >= LEAST_WORDS).agg(mid("slope").alias("o_slope"), mid("residual").alias("o_residual"), mid("covered").alias("o_covered")).first()
    if overall is None or overall["o_slope"] is None:
        return fitted.select("doc_id", "lang", "n", "slope", "residual", F.lit(0.0).alias("divergence"), F.lit(1.0).alias("prose"), F.lit(False).alias("extreme"), F.lit(False).alias("stuffed"))
    enough = F.col("like") >= 20
    near = fitted.join(centre, ["lang", "scale"], "left").withColumns({
        k: F.when(enough, F.col(f"m_{k}")).otherwise(F.lit(float(overall[f"o_{k}"]))) for k in ("slope", "residual", "covered")
    } | {"own_slope": F.col("slope"), "own_residual": F.col("residual"), "own_covered": F.col("covered")})
    spread = near.where(F.col("n") >= LEAST_WORDS).agg(mid(F.abs(F.col("own_slope") - F.col("slope"))).alias("s"), mid(F.abs(F.col("own_residual") - F.col("residual"))).alias("r")).first()
    q, p = F.greatest(F.least(F.col("own_covered"), F.lit(0.999)), F.lit(0.001)), F.greatest(F.least(F.col("covered"), F.lit(0.999)), F.lit(0.001))
    divergence = F.when(q < p, q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    prose = F.least(F.col("own_covered") / F.greatest("covered", F.lit(0.05)), F.lit(1.0))
    extreme = (
        (F.abs(F.col("own_slope") - F.col("slope")) > EXTREME * F.lit(spread["s"] or 0.0))
        | (F.abs(F.col("own_residual") - F.col("residual")) > EXTREME * F.lit(spread["r"] or 0.0))
        | (divergence > DIVERGENT)
    )
    figures = scratch.save(near.select(
        "doc_id", "lang", "n", "all_words", F.col("own_slope").alias("slope"), F.col("own_residual").alias("residual"), divergence.alias("divergence"), prose.alias("prose"), extreme.alias("extreme"),
    ), "figures")
    # what tells tables and lists of references from stuffing is looked for in the texts of candidates only
    doubt = lambda n: F.lit(PROSE_ERROR) / F.sqrt(n)
    candidate = F.col("extreme") & ((F.col("n") < LEAST_WORDS) | (F.col("prose") < PROSE_SHARE - doubt(F.col("n"))))
    doubtful = figures.where(candidate)
    few = doubtful.count() <= FEW_IDS
    texts = pages.select("doc_id", "text").join(F.broadcast(doubtful.select("doc_id")) if few else doubtful.select("doc_id"), "doc_id", "left_semi")
    doubtful = doubtful.join(texts, "doc_id")
    marks = _marks(F.col("text")) | _links(F.col("text"))
    doubtful = doubtful.select("doc_id", "n", "all_words", "prose", *[v.alias(k) for k, v in marks.items()])
    table_like = (F.col("celled") >= REFERENCE_LINES) & ((F.col("all_words") - F.col("n")) >= TABLE_NUMBERS * F.col("all_words")) & (F.col("priced") < 3)
    reference_like = (F.col("cited") >= REFERENCE_LINES) & (F.col("priced") < 3)
    listed = (F.col("n") < LEAST_WORDS) & (F.col("parts") >= LEAST_WORDS) & (F.col("links") >= LEAST_LINKS) & (F.col("links") >= PROSE_SHARE * F.col("n"))
    short_of_prose = F.col("prose") < PROSE_SHARE - doubt(F.when(listed, F.col("parts")).otherwise(F.col("n")))
    found = doubtful.where(((F.col("n") >= LEAST_WORDS) | listed) & short_of_prose & ~table_like & ~reference_like).select("doc_id", F.lit(True).alias("stuffed")).distinct()
    return figures.join(found, "doc_id", "left").select("doc_id", "lang", "n", "slope", "residual", "divergence", "prose", "extreme", F.coalesce("stuffed", F.lit(False)).alias("stuffed"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).where("stuffed").select("doc_id")
