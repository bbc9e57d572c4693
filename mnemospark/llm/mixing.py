"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialize

BLOCK_DOCS = 4_096
STEPS = 200


def tempered(sizes: dict[str, int], entropy: float | None = None, max_repeats: float | None = None, total: float | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, weights): shares of the sources' tokens raised to an exponent in [0, 1].

    The exponent is the one nearest to 1 whose weights reach `entropy` (in nats; natural
    shares where they have it already, equal shares where none does), or, with
    `max_repeats`, the one nearest to 0 at which no source is used more often than that
    in a mix of `total` tokens. Bisection: entropy falls and repetition falls as the
    exponent grows. Sources without tokens get weight 0.
    """
    full = {s: n for s, n in sizes.items() if n > 0}
    if not full:
        return 1.0, dict.fromkeys(sizes, 0.0)
    whole = sum(full.values())

    def weights(a: float) -> dict[str, float]:
        raised = {s: math.exp(a * math.log(n / whole)) for s, n in full.items()}
        z = sum(raised.values())
        return {s: w / z for s, w in raised.items()}

    def fits(a: float) -> bool:
        w = weights(a)
        if entropy is not None and -sum(x * math.log(x) for x in w.values() if x > 0) < entropy - 1e-12:
            return False
        return True

    def repeats(a: float) -> bool:
        return all(w * (total or whole) <= max_repeats * full[s] * (1 + 1e-12) for s, w in weights(a).items())

    lo, hi = 0.0, 1.0
    if max_repeats is not None:
        a = 0.0 if repeats(0.0) else 1.0
        if a:
            for _ in range(STEPS):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if repeats(mid) else (mid, hi)
            a = hi
    else:
        a = 1.0 if fits(1.0) else 0.0
        if not a and fits(0.0):
            for _ in range(STEPS):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if fits(mid) else (lo, mid)
            a = lo
    return a, {s: weights(a).get(s, 0.0) for s in sizes}


def budgets(weights: dict[str, float], sizes: dict[str, int], repeats: dict[str, int], total: float) -> dict[str, int]:
    """Tokens of each source: in proportion to its weight, at most repeats times its size, `total` together if the sources allow it.

    The factor on the weights is found by bisection; what capped sources can't give
    goes to the others in proportion, which keeps the shares as near to the targets as
    the limits allow. Sources without tokens or weight get 0.
    """
    caps = {s: max(0, repeats.get(s) or 0) * sizes.get(s, 0) for s in weights}
    live = {s: w for s, w in weights.items() if w and w > 0 and caps[s] > 0}
    out = dict.fromkeys(weights, 0)
    if not live:
        return out
    goal = min(total, sum(caps[s] for s in live))
    lo, hi = 0.0, max(caps[s] / w for s, w in live.items())
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(min(caps[s], mid * w) for s, w in live.items()) >= goal else (mid, hi)
    out.update({s: int(min(caps[s], hi * w) + 1e-6) for s, w in live.items()})
    return out


def draw(docs: DataFrame, plan: list[tuple[str, str, int]], seed: int = 0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats): the documents of a mix and how often each is used.

    `docs` has source, doc_id, n_tokens; `plan` has (mix_name, source, budget). A source
    is used whole as often as its budget holds it; the rest is taken in a seeded order:
    documents fall by a hash into blocks of about `block_docs` documents, whole blocks
    are taken while they fit, and only in the block where the budget ends are documents
    taken one by one, the last being the one after which the budget is best met. Block
    sizes are pre-aggregated, so no source makes one large sort, and the same seed gives
    the same mix.
    """
    spark = docs.sparkSession
    some = docs.filter(F.col("n_tokens") > 0)
    count = {r["source"]: r["n"] for r in some.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    wanted = spark.createDataFrame([(*p, max(1, -(-count.get(p[1], 1) // block_docs))) for p in plan if p[2] > 0], "mix_name string, source string, budget bigint, _blocks bigint")
    sized = some.join(wanted, "source")
    sized = sized.withColumn("_h", F.xxhash64("mix_name", "doc_id", F.lit(seed))).withColumn("_block", F.pmod("_h", F.col("_blocks"))).drop("_blocks")
    per = sized.groupBy("mix_name", "source", "budget", "_block").agg(F.sum("n_tokens").alias("_size"))
    by = Window.partitionBy("mix_name", "source")
    per = per.withColumn("_all", F.sum("_size").over(by)).withColumn("_before", F.coalesce(F.sum("_size").over(by.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("_whole", F.floor(F.col("budget") / F.col("_all"))).withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("_all"))
    per = per.select("mix_name", "source", "_block", "_whole", (F.col("_rest") - F.col("_before")).alias("_left"), "_size")
    rows = sized.drop("budget").join(per, ["mix_name", "source", "_block"])
    once = F.lit(1).cast("bigint")
    taken = rows.filter(F.col("_left") >= F.col("_size")).withColumn("_extra", once)
    none = rows.filter((F.col("_left") <= 0)).withColumn("_extra", once * 0)
    edge = rows.filter((F.col("_left") > 0) & (F.col("_left") < F.col("_size")))
    w = Window.partitionBy("mix_name", "source", "_block").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_sofar", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    edge = edge.withColumn("_extra", (F.col("_sofar") + F.col("n_tokens") / 2 <= F.col("_left")).cast("bigint")).drop("_sofar")
    out = taken.unionByName(none).unionByName(edge).withColumn("repeats", F.col("_whole") + F.col("_extra"))
    return out.filter("repeats > 0").select("mix_name", "source", "doc_id", "n_tokens", "repeats")


def towards_targets(targets: dict[str, float], sizes: dict[str, int], repeats: dict[str, int], total: float) -> tuple[float, dict[str, float]]:
    """(exponent, weights): targets tempered towards the natural shares, target^(1 - a) share^a, with the smallest a at which no source is used more often than it may be.

    At a = 0 the weights are the targets; at a = 1 every source is used equally often.
    Bisection: the most repeated source's use falls as the exponent grows. Where even
    equal use is too much, a is 1.
    """
    live = {s: w for s, w in targets.items() if w and w > 0 and sizes.get(s, 0) > 0 and (repeats.get(s) or 0) > 0}
    whole = sum(sizes[s] for s in live)

    def weights(a: float) -> dict[str, float]:
        raised = {s: math.exp((1 - a) * math.log(w) + a * math.log(sizes[s] / whole)) for s, w in live.items()}
        z = sum(raised.values())
        return {s: w / z for s, w in raised.items()}

    def fits(a: float) -> bool:
        return all(w * total <= repeats[s] * sizes[s] * (1 + 1e-12) for s, w in weights(a).items())

    if not live or fits(0.0):
        return 0.0, weights(0.0) if live else {}
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi, weights(hi)


def distances(docs: DataFrame, targets: DataFrame) -> list[tuple[str, float, float, float]]:
    """(mix_name, exponent, tempered, budgeted): half the sum of the differences between targets and the shares of tempered weights, and between targets and those of `budgets`, in plan."""
    sizes, corpus = source_sizes(docs)
    out = []
    rows = targets.collect()  # a small table of settings
    for mix in sorted({t["mix_name"] for t in rows if t["mix_name"] is not None}):
        own = [t for t in rows if t["mix_name"] == mix and t["source"] is not None]
        want = {t["source"]: t["target_weight"] or 0.0 for t in own}
        whole = sum(want.values()) or 1.0
        most = {t["source"]: t["max_repeats"] for t in own}
        total = max((t["total_ratio"] or 0.0) for t in own) * corpus
        a, w = towards_targets(want, sizes, most, total)
        got = budgets(want, sizes, most, total)
        n = sum(got.values()) or 1
        far = lambda share: sum(abs(share.get(s, 0.0) - v / whole) for s, v in want.items()) / 2
        out.append((mix, a, far(w), far({s: b / n for s, b in got.items()})))
    return out


def source_sizes(counted: DataFrame) -> tuple[dict[str, int], int]:
    """Tokens per source, and of the whole corpus with the documents that have no source. One row per source reaches the driver."""
    rows = counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    return {r["source"]: int(r["n"] or 0) for r in rows if r["source"] is not None}, sum(int(r["n"] or 0) for r in rows)


def plan_mixes(targets: list, sizes: dict[str, int], corpus: int) -> list[tuple[str, str, int]]:
    """(mix_name, source, budget) for rows of (mix_name, source, target_weight, max_repeats, total_ratio)."""
    plan = []
    for mix in sorted({t["mix_name"] for t in targets if t["mix_name"] is not None}):
        own = [t for t in targets if t["mix_name"] == mix and t["source"] is not None]
        if not own:
            continue
        ratio = max((t["total_ratio"] or 0.0) for t in own)
        got = budgets({t["source"]: t["target_weight"] or 0.0 for t in own}, sizes, {t["source"]: t["max_repeats"] for t in own}, ratio * corpus)
        plan += [(mix, s, b) for s, b in got.items()]
    return plan


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of all mixes, see draw. `docs` has doc_id, source and n_tokens and is read three times: pass a stored table.

    The targets are a small table of settings. Documents without a source, of a source
    without a target, or without tokens are in no mix; their tokens count in the corpus
    that total_ratio refers to. Repeated rows count as further documents. Empty tables
    give an empty result.
    """
    sizes, corpus = source_sizes(docs)
    return draw(docs.select("doc_id", "source", "n_tokens"), plan_mixes(targets.collect(), sizes, corpus), seed)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, share, tokens): the wanted and the reached share of every target."""
    by = Window.partitionBy("mix_name")
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    t = targets.select("mix_name", "source", (F.col("target_weight") / F.sum("target_weight").over(by)).alias("target_share"))
    out = t.join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return out.select("mix_name", "source", "target_share", (F.col("tokens") / F.sum("tokens").over(by)).alias("share"), "tokens")


def temperature_mix(docs: DataFrame, name: str, entropy: float | None = None, max_repeats: int | None = None, total: float | None = None, seed: int = 0) -> DataFrame:
    """A mix without targets: shares of the sources' tokens tempered to an entropy or a repetition limit, see tempered."""
    docs = materialize(docs.select("doc_id", "source", "n_tokens"), "sized")
    sizes, corpus = source_sizes(docs)
    goal = total or corpus
    _, w = tempered(sizes, entropy, max_repeats, goal)
    limit = max_repeats or 10**6
    got = budgets(w, sizes, dict.fromkeys(w, limit), goal)
    return draw(docs, [(name, s, b) for s, b in got.items()], seed)
