"""Filling fixed-capacity containers: a configuration LP over the length histogram.

Only the histogram of lengths reaches the driver (at most ``capacity`` entries, however many items
there are). A *configuration* is a multiset of lengths that fits a container. The covering LP

    minimise  sum x_c   subject to   sum_c x_c * count(l in c) >= n_l   for every length l

is solved by multiplicative weights. An outer round prices every length by the weights, finds the
best-priced configurations by a knapsack dynamic programme over all lengths, and adds them; between
prices the inner game - weights on lengths against weights on the configurations found so far, both
multiplicative, with optimistic steps - settles how often each configuration is used. The best price
found by the dynamic programme bounds the LP from below, and rounds go on until the value is within
``GAP`` of that bound (or nothing is gained any more, or ``ROUNDS`` are over; the plan reports both). Histograms of more than ``CLASSES`` lengths
are grouped: neighbouring lengths form a class that counts as its longest member.

The solution is rounded to whole containers, fractions being carried on from one configuration to the next.
Members of a class are drawn longest first, which splits a configuration into runs of containers that
hold exactly the same lengths; what a run leaves free is filled by a knapsack of short items that were kept
out of the LP. Items still left, if any, are packed longest first.

The plan assigns *ranks within a length* to containers, as intervals; items get their rank by salted
counting, so a length that holds a third of all items is no hot group, and find their container by
binary search in the plan. Its size is bounded by the lengths and configurations, not by the items.
Items longer than the capacity are cut into full containers and a remainder; no other item is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.llm.tokens import TOKENIZER_DIR, with_tokens
from skerry.session import materialize, table

#: Classes of lengths in the LP, and cells of its knapsack table.
CLASSES, CELLS = 256, 1024
#: The LP is solved once its value is within this share of the lower bound.
GAP = 0.005
#: Within four times that, rounds without a gain of a tenth of it after which the LP counts as solved as well as its grid allows.
STALL = 6
#: Outer rounds (prices) at most, configurations added in each, inner steps of each.
ROUNDS, COLUMNS, STEPS = 60, 48, 1500
SALTS = 64


class Knapsack:
    """The table of best-priced fillings: lengths, their prices and how many of each there are."""

    def __init__(self, length: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int):
        best = np.zeros(capacity + 1)
        self.n, self.steps = len(length), []
        for i in range(self.n):
            left, size, w1, p1 = int(min(most[i], capacity // length[i])), 1, int(length[i]), float(price[i])
            while left > 0:
                m = min(size, left)
                w = m * w1
                trial, now = best[: capacity + 1 - w] + m * p1, best[w:]
                self.steps.append((i, m, w, trial > now + 1e-15))
                best[w:] = np.maximum(now, trial)
                left -= m
                size *= 2
        self.best = best

    def filling(self, room: int) -> np.ndarray:
        """How many of each length the best filling of ``room`` holds."""
        count = np.zeros(self.n, np.int64)
        for i, m, w, better in reversed(self.steps):
            if w <= room and better[room - w]:
                count[i] += m
                room -= w
        return count


def knapsack(length: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length the best-priced filling of one container holds."""
    return Knapsack(length, price, most, capacity).filling(capacity)


@dataclass
class Solution:
    """Configurations as arrays (class, count), their numbers of containers, the LP's value and bound."""

    configs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: float = 0.0
    bound: float = 0.0


def configuration_lp(length: np.ndarray, n: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> Solution:
    """Solve the covering LP for distinct ascending lengths; every n is covered."""
    if not len(length):
        return Solution()
    unit = max(1, capacity // CELLS)
    cells, room = -(-length // unit), capacity // unit
    mass = (length * n).astype(float)
    base = max(mass.sum() / capacity, 1e-9)
    most = np.minimum(room // cells, n)
    seen: dict[tuple, int] = {}
    own: list[np.ndarray] = []
    times: list[np.ndarray] = []

    def add(count: np.ndarray) -> None:
        used = np.flatnonzero(count)
        key = tuple(used.tolist()), tuple(count[used].tolist())
        if len(used) and key not in seen:
            seen[key] = len(own)
            own.append(used)
            times.append(count[used])

    covered = np.zeros(len(length))

    def spread_out(how_many: int, eta: float = 8.0, step: float = 0.25) -> None:
        """Configurations that cover every length, each priced by what is covered so far. A length takes
        part with about its share in an average container, which keeps configurations varied."""
        share = np.minimum(most, np.ceil(2 * n / base).astype(np.int64) + 1)
        for _ in range(how_many):
            r = covered / n
            count = Knapsack(cells, mass / n * np.exp(-eta * (r - r.min())), share, room).filling(room)
            used = np.flatnonzero(count)
            add(count)
            covered[used] += step * (n[used] / count[used]).min() * count[used]

    spread_out(2 * len(length))
    while covered.min() == 0:
        spread_out(len(length) // 4 + 1)
    bound, value, x = base, np.inf, np.zeros(0)
    best, idle = np.inf, 0
    start = np.log(mass / mass.sum())
    for _ in range(rounds):
        size = np.array([len(u) for u in own])
        col = np.repeat(np.arange(len(own)), size)
        row, a = np.concatenate(own), np.concatenate(times).astype(float)
        v = a * base / n[row]
        q_sum, x_sum = np.zeros(len(length)), np.zeros(len(own))
        last_x, last_q = np.zeros(len(own)), np.zeros(len(length))
        # the weights of the configurations start where the last round ended, a new one's at the mean
        held = np.log(np.concatenate([np.maximum(x / max(x.sum(), 1e-12), 1e-6), np.full(len(own) - len(x), 1 / len(own))]))
        weight = start.copy()
        for t in range(1, STEPS + 1):
            p = np.exp(held - held.max())
            p /= p.sum()
            q = np.exp(weight - weight.max())
            q /= q.sum()
            cover, worth = np.bincount(row, v * p[col], len(length)), np.bincount(col, v * q[row], len(own))
            held, weight = held + 0.2 * (2 * worth - last_x), weight - 0.2 * (2 * cover - last_q)
            last_x, last_q = worth, cover
            x_sum += t * p
            q_sum += t * q
        for p in (x_sum / x_sum.sum(), p):
            got = 1 / max(np.bincount(row, v * p[col], len(length)).min(), 1e-12)
            if got * base < value:
                value, x = got * base, p * got * base
        x = np.append(x, np.zeros(len(own) - len(x)))
        start = np.log(np.maximum(q_sum / q_sum.sum(), 1e-9))
        prices = []
        for q in (q_sum / q_sum.sum(), q):
            k = Knapsack(cells, q / n, most, room)
            prices.append(k)
            bound = max(bound, 1 / max(k.best[-1], 1e-12))
        gained = value < best * (1 - gap / 10)
        best, idle = (value, 0) if gained else (best, idle + 1)
        if value <= (1 + gap) * bound or (idle >= STALL and value <= (1 + 4 * gap) * bound):
            break
        # the best filling of all, and the best beside one of each of the lengths that weigh most
        k = prices[0]
        add(k.filling(room))
        add(prices[1].filling(room))
        for i in np.argsort(-q_sum)[:COLUMNS]:
            count = k.filling(room - int(cells[i]))
            if count[i] < most[i]:
                count[i] += 1
                add(count)
    # configurations that hardly count are left out; the others make up for them
    keep = np.flatnonzero(x > 1e-4 * x.max())
    return Solution([(own[i], times[i]) for i in keep], x[keep], float(value), float(bound))


def classes(length: np.ndarray, n: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """The class of every length: themselves, or ``most`` classes of about equal mass."""
    if len(length) <= most:
        return np.arange(len(length))
    mass = np.cumsum(length * n)
    return np.unique(np.minimum((mass - 1) * most // mass[-1], most - 1), return_inverse=True)[1]


@dataclass
class Plan:
    """``rows``: (length, first rank, end rank, first container, items per container); ``value`` and ``bound`` are
    those of the LP, over all but the short items kept out of it."""

    rows: np.ndarray
    containers: int
    from_configurations: int
    value: float
    bound: float


def pack_plan(length: np.ndarray, n: np.ndarray, capacity: int) -> Plan:
    """``length`` distinct, positive, ascending, at most ``capacity``."""
    rows: list[tuple[int, int, int, int, int]] = []
    left, rank = n.astype(np.int64).copy(), np.zeros(len(n), np.int64)
    made = 0

    def take(i: int, copies: int, first: int, runs: int) -> None:
        """``copies`` items of length number i in each of ``runs`` containers from ``first`` on."""
        rows.append((int(length[i]), int(rank[i]), int(rank[i] + copies * runs), first, copies))
        rank[i] += copies * runs
        left[i] -= copies * runs

    def top_up(room: int, first: int, runs: int) -> None:
        """Fill the same room of ``runs`` containers as well as what is left allows."""
        pick = np.flatnonzero((left >= runs) & (length <= room))
        if room <= 0 or not len(pick):
            return
        unit = max(1, room // CELLS)
        for i, m in zip(pick, knapsack(-(-length[pick] // unit), length[pick].astype(float), left[pick] // runs, room // unit)):
            if m:
                take(int(i), int(m), first, runs)

    total = length * n
    group = classes(length, n)
    if len(length) and group[-1] + 1 < len(length):
        # grouping rounds lengths up; short items of one and a half times that mass fill what it leaves free
        longest = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(longest, group, length)
        lost = ((longest[group] - length) * n).sum()
        short = (np.cumsum(total) <= 1.5 * lost) & (length <= capacity // 8)
        group = np.where(short, -1, group)
        group[~short] = classes(length[~short], n[~short])
    members = [np.flatnonzero(group == g)[::-1] for g in range(group.max() + 1)] if len(length) else []
    longest = np.array([length[m[0]] for m in members], np.int64)
    lp = configuration_lp(longest, np.array([n[m].sum() for m in members], np.int64), capacity)
    carried = 0.0
    for j in np.argsort(-lp.x, kind="stable"):
        carried += lp.x[j]
        runs = int(carried + 1e-9)
        if not runs:
            continue
        carried -= runs
        # slot by slot, the longest members first: (item length, containers from, to)
        cuts, slots = {0, runs}, []
        for g, m in zip(*lp.configs[j]):
            for _ in range(m):
                at = 0
                for i in members[g]:
                    k = int(min(left[i], runs - at))
                    if k:
                        slots.append((int(length[i]), at, at + k))
                        take(int(i), 1, made + at, k)
                        at += k
                        cuts.add(at)
                    if at == runs:
                        break
        if not slots:
            continue
        edges = sorted(cuts)
        load = np.zeros(runs + 1, np.int64)
        for w, a, b in slots:
            load[a] += w
            load[b] -= w
        load = np.cumsum(load)
        for a, b in zip(edges[:-1], edges[1:]):
            if load[a]:
                top_up(capacity - int(load[a]), made + a, b - a)
        # containers that no item was left for stand at the end
        made += int((load[:-1] > 0).sum())
    planned = made
    while left.any():
        big = int(np.flatnonzero(left)[-1])
        copies = int(min(left[big], capacity // length[big]))
        runs = int(left[big] // copies)
        first, made = made, made + runs
        take(big, copies, first, runs)
        top_up(capacity - copies * int(length[big]), first, runs)
    return Plan(np.array(rows, np.int64).reshape(-1, 5), made, planned, lp.value, lp.bound)


def _look_up(batches: Iterator[pa.RecordBatch], index: dict[int, tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    starts = {k: (a[:, 0] << 40) + a[:, 1] for k, (a, _) in index.items()}
    for b in batches:
        limit, length, rank = (b.column(c).to_numpy() for c in ("limit_id", "tokens", "rank"))
        box = np.zeros(len(limit), np.int64)
        for k in np.unique(limit):
            rows = np.flatnonzero(limit == k)
            a, fulls = index[int(k)]
            j = np.searchsorted(starts[int(k)], (length[rows].astype(np.int64) << 40) + rank[rows], "right") - 1
            box[rows] = fulls + a[j, 3] + (rank[rows] - a[j, 1]) // a[j, 4]
        cols = [b.column(c) for c in ("limit_id", "id", "piece", "tokens")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(box)], ["limit_id", "id", "piece", "tokens", "container"])


def pack(sizes: DataFrame, limits: DataFrame) -> tuple[DataFrame, dict[int, Plan]]:
    """``(limit_id, id, piece, tokens, container)``: every item of ``sizes(id, tokens)`` in a container
    of each capacity of ``limits(limit_id, capacity_tokens)``; and the plan of each limit.

    An item longer than the capacity becomes ``tokens // capacity`` full pieces, each alone in a
    container, and a remainder piece. Items without tokens share a container. Ids that are null and
    limits that are null or not positive are left out; of a repeated limit the largest capacity
    counts; repeated items count once. An empty table gives an empty result. The driver holds the
    capacities and at most one row per capacity and length below it.
    """
    kind = sizes.schema["id"].dataType.simpleString()
    caps = {int(r[0]): int(r[1]) for r in limits.where("limit_id is not null and capacity_tokens > 0").groupBy("limit_id").agg(F.max("capacity_tokens")).collect()}
    spark = sizes.sparkSession
    if not caps:
        return spark.createDataFrame([], f"limit_id int, id {kind}, piece int, tokens int, container long"), {}
    cap = F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("cap")) for k, c in sorted(caps.items()))))
    items = sizes.where("id is not null").groupBy("id").agg(F.max(F.coalesce("tokens", F.lit(0))).alias("total"))
    each = items.select("id", "total", cap.alias("c")).select("c.limit_id", "id", "c.cap", "total")
    full = each.where("total > cap").select("limit_id", "id", "cap", F.explode(F.expr("sequence(0, cast(total div cap as int) - 1)")).alias("piece"))
    rest = each.select("limit_id", "id", F.expr("if(total > cap, cast(total div cap as int), 0)").alias("piece"), F.expr("if(total > cap, total % cap, total)").cast("int").alias("tokens"), "total")
    rest = rest.where("tokens > 0 or total = 0").withColumn("salt", F.pmod(F.xxhash64("id", "limit_id"), F.lit(SALTS)).cast("int"))
    hist = materialize(rest.groupBy("limit_id", "tokens", "salt").agg(F.count("*").alias("n")), "length_histogram")
    per = hist.groupBy("limit_id", "tokens").agg(F.sum("n").alias("n")).toPandas()
    fulls = {int(r[0]): int(r[1]) for r in each.where("total > cap").groupBy("limit_id").agg(F.sum(F.expr("total div cap"))).collect()}
    plans, index = {}, {}
    for k, c in caps.items():
        own = per[(per.limit_id == k) & (per.tokens > 0)].sort_values("tokens")
        plan = plans[k] = pack_plan(own.tokens.to_numpy(np.int64), own.n.to_numpy(np.int64), c)
        zero = int(per[(per.limit_id == k) & (per.tokens == 0)].n.sum())
        rows = np.concatenate([plan.rows, [[0, 0, zero, 0, zero]]]) if zero else plan.rows
        index[k] = rows[np.lexsort((rows[:, 1], rows[:, 0]))], fulls.get(k, 0)
    before = W.partitionBy("limit_id", "tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = hist.select("limit_id", "tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rest.withColumn("k", F.row_number().over(W.partitionBy("limit_id", "tokens", "salt").orderBy("id")) - 1).join(base, ["limit_id", "tokens", "salt"])
    ranked = ranked.select("limit_id", "id", "piece", "tokens", (F.col("k") + F.col("base")).cast("long").alias("rank"))
    small = ranked.mapInArrow(lambda it: _look_up(it, index), f"limit_id int, id {kind}, piece int, tokens int, container long")
    # full pieces: containers 0 .. fulls-1, numbered by salted counting as well
    f = full.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int"))
    fc = f.groupBy("limit_id", "salt").agg(F.count("*").alias("n"))
    fb = fc.select("limit_id", "salt", F.coalesce(F.sum("n").over(W.partitionBy("limit_id").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    fr = f.withColumn("k", F.row_number().over(W.partitionBy("limit_id", "salt").orderBy("id", "piece")) - 1).join(fb, ["limit_id", "salt"])
    big = fr.select("limit_id", "id", "piece", F.col("cap").alias("tokens"), (F.col("k") + F.col("base")).cast("long").alias("container"))
    return small.unionByName(big), plans


def _sizes(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    return materialize(with_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text", folder).withColumnRenamed("doc_id", "id"), "token_sizes")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, Plan]]:
    got, plans = pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_limits"))
    return got.select("limit_id", F.col("id").alias("doc_id"), "piece", "tokens", F.col("container").alias("container_id")), plans


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document, or piece of one, goes, for each capacity."""
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, the least number possible for the tokens, the share filled, the value of the LP
    over the pieces below the capacity, its lower bound, and the containers that come from its configurations."""
    got, plans = _packed(spark, sf_dir)
    boxes = got.groupBy("limit_id", "container_id").agg(F.sum("tokens").alias("t"))
    lim = table(spark, sf_dir, "pack_limits").where("capacity_tokens > 0").groupBy("limit_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    lp = spark.createDataFrame([(k, p.value, p.bound, p.from_configurations, p.containers) for k, p in plans.items()], "limit_id int, lp_value double, lp_bound double, from_configurations long, mixed_containers long")
    out = boxes.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).join(lim, "limit_id").join(lp, "limit_id")
    return out.select(
        "limit_id", "capacity_tokens", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 5).alias("fill"),
        F.round("lp_value", 2).alias("lp_value"), F.round("lp_bound", 2).alias("lp_bound"), "mixed_containers", "from_configurations",
    )


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
