"""Problem 9: mixing sources to target weights.

Sizes are tokens of a public tokenizer.  Each source's documents are permuted
by a seeded hash and cut into blocks (ranges of that hash); a repeat is another
pass over the source.  The size of the mix is the largest at which every source
that has any text can give its share within its repeats.  Blocks are shared out
over output shards by a splitting tree: the shards are halved again and again,
and each time the block quotas of the sources are divided by a draw from the
multivariate hypergeometric distribution, so every shard holds a random mix and
the quotas stay exact.  Shards then take disjoint runs of each source's
permuted blocks, and each shard shuffles its own rows.

Only sums by block come to the driver, shards times BLOCKS_PER_SHARD of them a source.

Defined results: documents without text, of no source, or of a source without
target are not taken; a target source without documents keeps its row in the
report with share 0, and its target is spread over the others in proportion;
a target or a number of repeats that is null or not positive takes nothing;
empty tables give an empty selection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch
from .common import table
from .tokenize import counted

SEED = 20_240_229
BLOCKS_PER_SHARD = 16
#: Shards if no number is given (the selection depends on it, so it isn't taken from the session), and the most there may be.
SHARDS, MAX_SHARDS = 64, 4096
_HASH_SPAN = 1 << 40


def plan_quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens that each source gives: shares in proportion to the targets, as many as all repeats allow."""
    usable = {s: (t, r) for s, (t, r) in targets.items() if t and t > 0 and r and r > 0 and sizes.get(s, 0) > 0}
    if not usable:
        return {}
    whole = sum(t for t, _ in usable.values())
    total = min(sizes[s] * r * whole / t for s, (t, r) in usable.items())
    return {s: int(total * t / whole) for s, (t, r) in usable.items()}


def split_blocks(quotas: list[int], n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block counts, shards x sources; every column adds up to its quota."""
    if n_shards == 1:
        return np.array([quotas], dtype=np.int64)
    left_shards = n_shards // 2
    total = int(sum(quotas))
    take = total * left_shards // n_shards
    left = rng.multivariate_hypergeometric(quotas, take, method="marginals") if take else np.zeros(len(quotas), dtype=np.int64)
    right = np.array(quotas, dtype=np.int64) - left
    return np.vstack([split_blocks(list(map(int, left)), left_shards, rng), split_blocks(list(map(int, right)), n_shards - left_shards, rng)])


def mixed(documents: DataFrame, targets: DataFrame, n_shards: int | None = None, seed: int = SEED, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, repeat, n_tokens, shard, position) and the report
    (source, target_share, max_repeats, n_rows, n_tokens, most_repeats, share)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    n_shards = n_shards or SHARDS
    if n_shards > MAX_SHARDS:
        raise ValueError(f"no more than {MAX_SHARDS} shards, as sums by block of each come to the driver")
    n_blocks = n_shards * BLOCKS_PER_SHARD
    goals = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()}
    sized = counted(documents.where("text is not null and text != '' and source is not null").select("doc_id", "source", "text"), tokenizer)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id")), F.lit(_HASH_SPAN))
    docs = scratch.save(
        sized.where("n_tokens > 0").withColumn("place", place).withColumn("block", F.expr(f"cast(place * {n_blocks} div {_HASH_SPAN} as int)")), "sized"
    )
    per_block = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).where(F.col("source").isin(list(goals))).collect()
    sums: dict[str, np.ndarray] = {}
    for r in per_block:
        sums.setdefault(r["source"], np.zeros(n_blocks, dtype=np.int64))[r["block"]] = r["n"]
    quotas = plan_quotas({s: int(v.sum()) for s, v in sums.items()}, goals)
    sources = sorted(quotas)

    # whole blocks of each source in the order of its passes, and the block in which the quota ends
    runs, cuts = [], []
    for s in sources:
        size = int(sums[s].sum())
        passes, rest = divmod(quotas[s], size)
        upto = np.cumsum(sums[s])
        cut = int(np.searchsorted(upto, rest, side="right")) if rest else 0
        runs.append(passes * n_blocks + cut + (1 if rest else 0))
        cuts.append((s, passes, cut, rest - (int(upto[cut - 1]) if cut else 0) if rest else 0))
    rng = np.random.default_rng(seed)
    shares = split_blocks(runs, n_shards, rng) if sources else np.zeros((n_shards, 0), dtype=np.int64)
    # run k of a source is pass k // n_blocks, block k % n_blocks; shards take consecutive runs
    rows = []
    for i, s in enumerate(sources):
        edges = np.concatenate([[0], np.cumsum(shares[:, i])])
        for shard in range(n_shards):
            if edges[shard] < edges[shard + 1]:
                rows.append((s, int(edges[shard]), int(edges[shard + 1]), shard))
    runs_of = spark.createDataFrame(rows, "source string, first long, past long, shard int").select(
        "source", "shard", F.explode(F.sequence("first", F.col("past") - 1)).alias("run")
    ).select("source", "shard", F.expr(f"cast(run div {n_blocks} as int)").alias("repeat"), F.expr(f"cast(run % {n_blocks} as int)").alias("block"))
    # rows of the last block stay, in their permuted order, while their sizes fit into what is left of the quota
    ends = spark.createDataFrame(cuts, "source string, last_pass int, last_block int, room long")
    drawn = docs.join(runs_of, ["source", "block"]).join(F.broadcast(ends), "source")  # one row a source of the target table
    in_last = (F.col("repeat") == F.col("last_pass")) & (F.col("block") == F.col("last_block"))
    running = F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy("place", "doc_id"))
    tail = drawn.where(in_last).withColumn("running", running).where("running <= room")
    chosen = scratch.save(
        drawn.where(~in_last).select("doc_id", "source", "repeat", "n_tokens", "shard").unionByName(tail.select("doc_id", "source", "repeat", "n_tokens", "shard")), "chosen"
    )
    shuffled = chosen.withColumn("position", F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "repeat"), "doc_id", "repeat")))
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.max(F.col("repeat") + 1).alias("most_repeats"))
    whole = sum(r["n_tokens"] for r in got.select("n_tokens").collect()) or 1  # one row a source of the target table
    report = targets.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_tokens", "most_repeats")],
        F.round(F.coalesce("n_tokens", F.lit(0)) / F.lit(whole), 6).alias("share"),
    )
    return shuffled, report


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
