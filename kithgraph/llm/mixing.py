"""Mixing sources to target weights by entropy balancing.

Every source has a number of words that the mix shall take from it. Among all document
rates within [0, 2] that meet these token constraints, the ones nearest to one in
relative entropy are min(2, exp(lambda * size)), with one multiplier for each source:
the dual is convex, its gradient and curvature are sums over documents, and Newton's
method solves it. The sums depend on a document's source and size only, so Spark reduces
the corpus to a histogram of sizes by source first; each iteration is one aggregation of
it for all sources at once, kept inside brackets where a step would leave them. Sums are
of decimals, so their order doesn't matter and reruns agree.

Rates become whole copies: sizes are walked from the longest on, carrying the words
over or under what the rates ask for, so a source misses its target by about half a
short document (one row for each different size of a source is in hand there). Which
documents of one source and size get the extra copy follows the order of a hash of their
ids and texts; rows that agree in both are numbered, so each copy is decided singly.

Defined results: null texts and empty texts have size 0, take no words and stay once;
a null source is a source, the last one; of rows with equal ids, texts and sources as
many get the extra copy as the target asks for, whichever they are; an empty table gives
no rows; other columns are carried on by repeated(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm import shared

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a part of all words.
SHARE = 1.5
#: Most copies of a document.
MOST = 2.0
#: How near a source's rates come to its target, and what their sums are taken in.
TOLERANCE = 1e-9
_EXACT = "decimal(38, 6)"
#: Rows up to which the table of decisions is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 300_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For sizes (source, size): source, source_size, target.

    Sources share by weight; none gets over `most` times its size, and what is over is
    shared again. That is one water level: target = min(cap, level * weight). Works on
    one row for each source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    each = each.withColumn("_cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("source").asc_nulls_last())
    each = each.withColumns(
        {
            "_before": F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_rest": F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "_all": F.sum("source_size").over(Window.partitionBy()),
            "_rank": F.row_number().over(by_ratio),
        }
    )
    level = (share * F.col("_all") - F.col("_before")) / F.col("_rest")
    each = each.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), F.struct("_rank", level.alias("level"))))
    each = each.withColumn("_level", F.min("_level").over(Window.partitionBy())["level"])
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return each.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _rate(size: Column, most: float) -> Column:
    """The rate of a document by its source's multiplier `at` and mean size."""
    return F.least(F.lit(most), F.exp(F.least(F.col("at") * size / F.col("mean"), F.lit(700.0))))


def tilted(histogram: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = TOLERANCE, rounds: int = 100) -> DataFrame:
    """targets (key columns _s and _null, target) with `mean` and `at`: the source's rates are min(most, exp(at * size / mean)).

    histogram has _s, _null, size and n. A target that no finite multiplier reaches gets one that comes as near as matters.
    """
    keys = ["_s", "_null"]
    sized = histogram.where("size > 0")
    words, n = F.sum((F.col("n") * F.col("size")).cast(_EXACT)), F.sum("n")
    state = targets.join(sized.groupBy(*keys).agg((words / n).cast("double").alias("mean"), words.cast("double").alias("words")), keys, "left")
    reached = F.col("mean").isNull() | (F.col("target") <= 0) | (F.col("target") >= most * F.col("words") * (1 - 1e-12))
    start = F.when(F.col("target") <= 0, F.lit(-1e9)).when(reached, F.lit(1e9)).otherwise(F.lit(0.0))
    state = state.withColumns({"at": start, "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "done": reached}).drop("words")
    sources = None
    for _ in range(rounds):
        state = shared.staged(state, "mix-multipliers", sources)
        sources, left = state.agg(F.count("*"), F.count_if(~F.col("done"))).first()
        if not left:
            break
        open_ = state.where(~F.col("done"))
        open_ = F.broadcast(open_) if sources <= BROADCAST_ROWS else open_
        x, rate = F.col("size") / F.col("mean"), _rate(F.col("size"), most)
        share = F.col("n") * F.col("size") * rate
        steep = F.when(rate < most, share * x).otherwise(0.0)
        sums = sized.join(open_.select(*keys, "mean", "at"), keys).groupBy(*keys).agg(F.sum(share.cast(_EXACT))
            .cast("double").alias("taken"), F.sum(steep.cast(_EXACT)).cast("double").alias("curve"))
        at, gap = F.col("at"), F.col("taken") - F.col("target")
        low, high = F.when(gap <= 0, at).otherwise(F.col("low")), F.when(gap > 0, at).otherwise(F.col("high"))
        newton = F.when(F.col("curve") > 0, at - gap / F.col("curve"))
        between = F.when((low > float("-inf")) & (high < float("inf")), (low + high) / 2).otherwise(at - F.signum(gap) * F.greatest(F.lit(
            1.0), F.abs(at)))
        done = F.abs(gap) <= tolerance * F.col("target")
        moved = F.when(done, at).when((newton > low) & (newton < high), newton).otherwise(between)
        state = state.join(sums, keys, "left").select(
            *targets.columns, "mean", F.when(F.col("done"), at).otherwise(moved).alias("at"), F.coalesce(low, "low").alias("low"), F.coalesce(
                high, "high").alias("high"), (F.col("done") | F.coalesce(done, F.lit(False))).alias("done")
        )
    return state.drop("low", "high", "done")


def whole_copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Copies for each group of n documents of a size, longest first, near the rates in words."""
    least, most = n * np.floor(rate + 1e-12), n * np.ceil(rate - 1e-12)
    wanted = taken = 0.0
    out = np.zeros(len(size), np.int64)
    for k in np.argsort(-size, kind="stable").tolist():
        wanted += n[k] * rate[k] * size[k]
        out[k] = min(max(round((wanted - taken) / size[k]), least[k]), most[k])
        taken += out[k] * size[k]
    return out


def _rounded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Copies for one source's histogram with rates."""
    rows = rows.sort_values("size", ignore_index=True)  # one order, so that reruns agree
    n, some = rows["n"].to_numpy(), rows["size"].to_numpy() > 0
    copies = n.copy()
    if some.any():
        copies[some] = whole_copies(*(rows[c].to_numpy(np.float64)[some] for c in ("size", "n", "rate")))
    return rows.drop(columns="n").assign(floor=copies // n, extra=copies % n)


def _keyed(df: DataFrame) -> DataFrame:
    """_s and _null stand for the source, so that joins find null sources."""
    return df.withColumns({"_s": F.coalesce(F.col("source").cast("string"), F.lit("")), "_null": F.col("source").isNull()})


def decisions(sizes: DataFrame) -> DataFrame:
    """For sizes (doc_id, source, size, _h), staged: one row for each source and size.

    A document gets `floor` copies, and one more if its place by (salt, hash) is before
    the limit's; of the `tied` documents at the limit itself `ties` get one more.
    """
    spark = sizes.sparkSession
    keys = ["_s", "_null", "size"]
    histogram = shared.staged(_keyed(sizes).groupBy("source", *keys).agg(F.count("*").alias("n")), "mix-histogram")
    targets = source_targets(histogram.select("source", (F.col("size") * F.col("n")).alias("size")))
    multipliers = tilted(histogram.select(*keys, "n"), _keyed(targets).drop("source"))
    rated = histogram.select(*keys, "n").join(multipliers, ["_s", "_null"])
    rated = rated.select(*keys, "n", "source_size", "target", F.when(F.col("size") > 0, _rate(F.col("size"), MOST)).otherwise(1.0).alias("rate"))
    solved = rated.groupBy("_s", "_null").applyInPandas(_rounded,
        "_s string, _null boolean, size long, source_size long, target double, rate double, floor long, extra long")
    solved = shared.staged(solved, "mix-rates")
    # The extra-th document of each source and size, by ranks inside salted groups.
    some = solved.where("extra > 0").select(*keys, "extra")
    some = _keyed(sizes).select(*keys, "_h").join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, keys)
    # Salts are dealt by other bits than the order, so ranks run over (salt, hash).
    ranked = shared.salted(some, keys, ["_h"], _salt(spark))
    by_hash = Window.partitionBy(*keys, "_salt").orderBy("_h")
    ranked = ranked.withColumns({"_first": F.rank().over(by_hash) - 1, "tied": F.count("*").over(by_hash.rangeBetween(0, 0))})
    counts = ranked.groupBy(*keys, "_salt").agg(F.count("*").alias("n"))
    placed = ranked.join(shared.salt_offsets(counts, keys).select(*keys, "_salt", "_off"), [*keys, "_salt"])
    at_limit = placed.where(F.col("_off") + F.col("_nth") == F.col("extra") - 1)
    limits = at_limit.select(*keys, F.col("_salt").alias("last_salt"), F.col("_h").alias("last_hash"), "tied", (F.col("extra") - F.col(
        "_off") - F.col("_first")).alias("ties"))
    return shared.staged(solved.join(limits, keys, "left"), "mix-decisions")


def _salt(spark: SparkSession) -> Column:
    return F.pmod(F.shiftright("_h", 7), F.lit(shared.salts(spark)))


def order_hash() -> Column:
    """What decides which documents of a source and size get the extra copy."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def mixed(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs (source, size, _h and others) without _h, with source_size, target, rate and copies."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "_h"]
    numbered = not decided.where("ties < tied").isEmpty()
    if decided.count() <= BROADCAST_ROWS:
        decided = F.broadcast(decided)
    joined = _keyed(docs).join(decided, ["_s", "_null", "size"])
    salt = _salt(spark)
    before = (salt < F.col("last_salt")) | ((salt == F.col("last_salt")) & (F.col("_h") < F.col("last_hash")))
    at_limit = F.coalesce((salt == F.col("last_salt")) & (F.col("_h") == F.col("last_hash")), F.lit(False))
    unsettled = at_limit & (F.col("ties") < F.col("tied"))

    def told(rows: DataFrame, one_more: Column) -> DataFrame:
        return rows.select(*names, "source_size", "target", "rate", (F.col("floor") + F.when((F.col("extra") > 0) & one_more, 1)
            .otherwise(0)).cast("long").alias("copies"))

    if not numbered:
        return told(joined, before | at_limit)
    keys = ["_s", "_null", "size"]
    alike = shared.staged(joined.where(unsettled).withColumn("_row", F.monotonically_increasing_id()), "mix-ties")
    ranked = shared.salted(alike, keys, ["_row"], F.pmod(F.xxhash64("_row"), F.lit(shared.salts(spark))))
    offsets = shared.salt_offsets(ranked.groupBy(*keys, "_salt").agg(F.count("*").alias("n")), keys)
    ranked = ranked.join(offsets.select(*keys, "_salt", "_off"), [*keys, "_salt"])
    return told(joined.where(~unsettled), before | at_limit).unionByName(told(ranked, F.col("_off") + F.col("_nth") < F.col("ties")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies for every document."""
    sizes = shared.staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_hash().alias("_h")), "mix-sizes")
    return mixed(sizes, decisions(sizes))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it has copies."""
    sized = [F.col("source"), n_words(F.col("text")).alias("size"), order_hash().alias("_h")]
    sizes = shared.staged(docs.select(*sized), "mix-sizes")
    # Names that cannot clash with columns of docs.
    inner = {c: f"_doc{k}" for k, c in enumerate(docs.columns)}
    named = docs.select(*(shared.own_column(c).alias(n) for c, n in inner.items()), *sized)
    rows = mixed(named, decisions(sizes)).where("copies > 0")
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_time")
    return rows.select(*inner.values(), times).select(*(F.col(n).alias(c) for c, n in inner.items()))
