"""Mixing sources to target shares of the tokens, by entropy balancing.

For each mix the total is the largest that its targets allow: the least over sources of
``max_repeats * tokens / target_share``. Document rates are as close (in relative entropy) to drawing
every document once as the constraints allow. Two constraints per source: its tokens, and its mean
document length, so that reaching a share never favours short or long documents. The convex dual has
two variables per source; rates are exponentially tilted,

    rate_i / (cap - rate_i) = c * exp(a_k + b_k * z_i),    z_i = (tokens_i - mean_k) / spread_k,

with cap = max_repeats (the entropy is that of rates bounded by the cap) and c the odds of one copy
each (of half a copy where the cap is one), and damped Newton steps solve for (a, b): every step is one distributed aggregation of gradient and
Hessian over the (source, tokens) histogram. Rates become copies by floor plus one for documents
whose hash lies under a per-source threshold; the threshold is set on prefix sums of a hash
histogram, refined twice, so that the tokens drawn hit the target as nearly as whole documents can.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.llm.tokens import TOKENIZER_DIR, with_tokens
from skerry.session import materialize, table

STEPS = 30
TOLERANCE = 1e-7
BINS = 4096
#: Targets up to this many rows are broadcast.
SMALL_TARGETS = 100_000
#: Bounded exponential tilt of the base rate least(1, cap / 2).
RATE = "cap / (1 + (cap / least(1D, cap / 2) - 1) * exp(-greatest(least(a + b * z, 50D), -50D)))"


def normal_source(c):
    """Lower-cased, without surrounding white space; null where nothing is left."""
    t = F.lower(F.trim(c))
    return F.when(t != "", t)


def solve_rates(hist: DataFrame, targets: DataFrame, steps: int = STEPS) -> tuple[dict, dict]:
    """(duals, goals) from ``hist(source, tokens, n)`` and ``targets(mix_id, source, target_share, max_repeats)``.

    duals: (mix, source) -> (a, b, mean, spread, cap); goals: (mix, source) -> tokens wanted.
    """
    small = F.broadcast if targets.count() <= SMALL_TARGETS else (lambda d: d)
    joined = hist.where("tokens > 0").join(small(targets), "source")
    base = joined.groupBy("mix_id", "source").agg(
        F.sum(F.expr("n * tokens")).alias("total"), F.sum("n").alias("n"), F.sum(F.expr("1.0D * n * tokens * tokens")).alias("sq"),
        F.first("target_share").alias("share"), F.first("max_repeats").alias("cap"),
    ).collect()
    room: dict = {}
    for r in base:
        room.setdefault(r.mix_id, []).append(r.cap * r.total / r.share)
    duals, goals, open_ = {}, {}, set()
    for r in base:
        key, mean = (r.mix_id, r.source), r.total / r.n
        spread = max((r.sq / r.n - mean * mean) ** 0.5, 1e-9)
        goals[key] = min(room[r.mix_id]) * r.share
        duals[key] = [0.0, 0.0, mean, spread, float(r.cap)]
        if goals[key] >= r.cap * r.total * (1 - 1e-9):
            duals[key][0] = 50.0  # every document at its cap
        else:
            open_.add(key)
    spark = hist.sparkSession
    for _ in range(steps):
        if not open_:
            break
        rows = [(m, s, *duals[m, s], goals[m, s]) for m, s in sorted(open_)]
        d = spark.createDataFrame(rows, "mix_id int, source string, a double, b double, mean double, spread double, cap double, goal double")
        e = hist.where("tokens > 0").join(F.broadcast(d), "source").withColumn("z", F.expr("(tokens - mean) / spread"))
        e = e.withColumn("w", F.expr(RATE)).withColumn("h", F.expr("w * (1 - w / cap)"))
        # constraints in units of documents: sum of rates = goal / mean, sum of rate * z = 0
        g = e.groupBy("mix_id", "source").agg(
            *[F.sum(F.expr(x)).alias(k) for k, x in (("s0", "n * w"), ("s1", "n * w * z"), ("h00", "n * h"), ("h01", "n * h * z"), ("h11", "n * h * z * z"))], F.first(F.expr("goal / mean")).alias("want")
        ).collect()
        for r in g:
            key = r.mix_id, r.source
            g0, g1 = r.s0 - r.want, r.s1
            if max(abs(g0), abs(g1)) <= TOLERANCE * r.want:
                open_.discard(key)
                continue
            h00, h11 = r.h00 + 1e-12, r.h11 + 1e-9 * r.h00 + 1e-12
            det = h00 * h11 - r.h01 * r.h01
            if det <= 1e-12 * h00 * h11:
                da, db = -g0 / h00, 0.0
            else:
                da, db = -(h11 * g0 - r.h01 * g1) / det, -(h00 * g1 - r.h01 * g0) / det
            big = max(abs(da), abs(db))
            damp = min(1.0, 2.0 / big) if big else 1.0
            duals[key][0] += damp * da
            duals[key][1] += damp * db
    if open_:
        warnings.warn(f"{len(open_)} of {len(duals)} targets not within {TOLERANCE} after {steps} steps", stacklevel=2)
    return duals, goals


def mix(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drawn, goals): ``drawn(mix_id, id, source, tokens, copies)`` with copies > 0.

    ``docs(id, source, tokens)``. A null id, a null source, a source without a target and documents
    without tokens are never drawn; repeated rows count once; targets that are null or not positive
    are left out; a target whose source has no documents leaves its share to nobody. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    t = targets.where("target_share > 0 and max_repeats > 0 and mix_id is not null").select("mix_id", normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").distinct()
    d = docs.where("id is not null and tokens > 0").select("id", normal_source(F.col("source")).alias("source"), "tokens").where("source is not null").distinct()
    hist = materialize(d.groupBy("source", "tokens").agg(F.count("*").alias("n")), "mix_histogram")
    duals, goals = solve_rates(hist, t)
    rows = [(m, s, *v, goals[m, s]) for (m, s), v in duals.items()]
    p = F.broadcast(spark.createDataFrame(rows, "mix_id int, source string, a double, b double, mean double, spread double, cap double, goal double"))
    e = d.join(p, "source").withColumn("z", F.expr("(tokens - mean) / spread")).withColumn("w", F.expr(RATE))
    # u: an even hash in [0, 1); one copy more where u < frac + shift of the source
    u = (F.pmod(F.xxhash64("id", "mix_id"), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    e = e.select("mix_id", "id", "source", "tokens", "cap", "goal", F.floor(F.col("w") + 1e-9).alias("whole"), F.greatest(F.expr("w - floor(w + 1e-9)"), F.lit(0.0)).alias("frac"), u)
    e = materialize(e.withColumn("key", F.expr("if(whole >= cap, 2D, u - frac)")), "mix_rates")
    low, width = {k: -1.0 for k in goals}, 2.0
    fixed = {(r.mix_id, r.source): r.t for r in e.groupBy("mix_id", "source").agg(F.sum(F.expr("whole * tokens")).alias("t")).collect()}
    lack = {k: goals[k] - (fixed.get(k) or 0) for k in goals}
    for _ in range(3):
        step = width / BINS
        b = spark.createDataFrame([(m, s, v) for (m, s), v in low.items()], "mix_id int, source string, low double")
        h = e.join(F.broadcast(b), ["mix_id", "source"]).where(F.expr(f"key >= low and key < low + {width!r}D and key < 1.5"))
        h = h.groupBy("mix_id", "source", F.floor((F.col("key") - F.col("low")) / step).alias("bin")).agg(F.sum("tokens").alias("t"))
        run = h.select("mix_id", "source", "bin", "t", F.sum("t").over(W.partitionBy("mix_id", "source").orderBy("bin")).alias("upto"))
        wish = spark.createDataFrame([(m, s, float(v)) for (m, s), v in lack.items()], "mix_id int, source string, lack double")
        over = run.join(F.broadcast(wish), ["mix_id", "source"]).where("upto >= lack").groupBy("mix_id", "source").agg(F.min_by(F.struct("bin", "t", "upto"), "bin").alias("x"))
        crossed = over.collect()
        for r in crossed:
            key = r.mix_id, r.source
            lack[key] -= r.x.upto - r.x.t
            low[key] += r.x.bin * step
        missing = {k for k in goals} - {(r.mix_id, r.source) for r in crossed}
        for key in missing:
            low[key] += width if lack[key] > 0 else 0.0
            lack[key] = 0.0
        width = step
    # the last bin goes in when that is nearer to the goal than leaving it out
    b = spark.createDataFrame([(m, s, v, float(lack[m, s])) for (m, s), v in low.items()], "mix_id int, source string, low double, lack double")
    e = e.join(F.broadcast(b), ["mix_id", "source"])
    edge = W.partitionBy("mix_id", "source", F.expr(f"key >= low and key < low + {width!r}D")).orderBy("key", "id")
    inside = F.expr(f"key >= low and key < low + {width!r}D")
    edges = e.where(inside).withColumn("run", F.sum("tokens").over(edge)).select("mix_id", "id", F.expr("run - tokens / 2D <= lack").alias("edge_in"))
    out = e.join(edges, ["mix_id", "id"], "left").withColumn("copies", F.expr("cast(whole + if(key < low or coalesce(edge_in, false), 1, 0) as int)"))
    out = out.withColumn("copies", F.least("copies", F.col("cap").cast("int"))).where("copies > 0")
    g = spark.createDataFrame([(m, s, float(v)) for (m, s), v in goals.items()], "mix_id int, source string, goal_tokens double")
    return out.select("mix_id", "id", "source", "tokens", "copies"), g


def _docs(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    d = with_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", folder)
    return materialize(d.withColumnRenamed("doc_id", "id"), "token_sizes")


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their number of copies."""
    out, _ = mix(_docs(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return out.select("mix_id", F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source: target and actual share of the tokens, copies, and the most repeats."""
    drawn = p8_drawn(spark, sf_dir).groupBy("mix_id", "source").agg(F.sum(F.expr("tokens * copies")).alias("drawn_tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    t = table(spark, sf_dir, "mix_targets").select("mix_id", normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    out = t.join(drawn, ["mix_id", "source"], "left").na.fill(0, ["drawn_tokens", "documents", "copies", "most_repeats"])
    share = F.round(F.col("drawn_tokens") / F.sum("drawn_tokens").over(W.partitionBy("mix_id")), 6)
    return out.withColumn("actual_share", share)


QUERIES = {"p8_drawn": p8_drawn, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
