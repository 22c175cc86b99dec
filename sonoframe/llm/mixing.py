"""Problem 7: a mix of sources with target shares of its tokens.

Entropy balancing: among all document rates w_i in [0, max_repeats] the mix takes those closest to 1 in relative entropy
under one constraint a source, that the tokens of its documents sum to its target. The convex dual has one multiplier a
source; its optimum makes the rates exponential tilts of the documents' sizes, w_i = min(cap, exp(multiplier * size)).
The documents are counted by source and size first, combined before the shuffle. The dual is a sum over the sources, so that
each source's multiplier is found by Newton's method from its own counts, in a task of its own.

Rates become whole copies by rounding with a hash of the document, moved by one offset a source so that the tokens of the
rounded mix meet the target too. The table of sources is joined, never listed; only totals of it reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.tokens import TOKENIZER, with_token_counts
from sonoframe.session import BROADCAST_LIMIT_BYTES, cut_lineage

#: Steps after which a source's multiplier counts as not found, which is an error; bracketed steps halve what is left.
MAX_ITERATIONS, TOLERANCE = 200, 1e-9
#: Offsets tried in rounding: each step moves a 4096th of a source's documents by one copy.
ROUNDING_STEPS = 4096
#: Largest exponent of a tilt; no cap of repeats is as large.
_LARGEST = 30.0


def _of_sources(rows: DataFrame) -> DataFrame:
    """A table of a row a source, broadcast where its counted rows are few."""
    return F.broadcast(rows) if 256 * rows.count() <= BROADCAST_LIMIT_BYTES else rows


def planned(live: DataFrame, total: float | None = None) -> DataFrame:
    """live (source, share, cap, tokens), sources that have tokens, with wanted, the tokens wanted of each.

    Shares are taken among these sources. Without ``total``, the mix is the largest in which every source can still give its
    share; with it, sources that can't give theirs give all they may, and the others share the rest.
    """
    live = live.withColumns({"most": F.col("cap") * F.col("tokens").cast("double"), "full": F.lit(False)})
    if total is None:
        row = live.agg(F.sum("share").alias("weight"), F.min(F.col("most") / F.col("share")).alias("least")).first()
        total = (row["weight"] or 0.0) * (row["least"] or 0.0)
    while True:
        row = live.agg(F.sum(F.when(~F.col("full"), F.col("share"))).alias("weight"), F.sum(F.when(F.col("full"), F.col("most"))).alias("given")).first()
        if not row["weight"]:
            break
        wanted = F.col("share") * (max(0.0, total - (row["given"] or 0.0)) / row["weight"])
        more = live.withColumns({"wanted": F.when(F.col("full"), F.col("most")).otherwise(wanted), "full": F.col("full") | (wanted >= F.col("most"))})
        more = cut_lineage(more.withColumn("wanted", F.least("wanted", "most")))
        if more.filter("full").count() == live.filter("full").count():
            return more
        live = more
    return live.withColumn("wanted", F.col("most"))


def multiplier_for(sizes: np.ndarray, documents: np.ndarray, cap: float, wanted: float) -> float:
    """Newton's method on the dual of one source: of the documents' tokens, in units of their mean, and how many have them."""
    tokens = sizes * documents
    scale = tokens.sum() / documents.sum()
    if wanted >= cap * tokens.sum() * (1 - 1e-12):
        return math.inf
    now, low, high = 0.0, -math.inf, math.inf
    for _ in range(MAX_ITERATIONS):
        rate = np.minimum(np.exp(np.minimum(now * sizes / scale, _LARGEST)), cap)
        miss = float((rate * tokens).sum()) - wanted
        if abs(miss) <= TOLERANCE * wanted:
            return now
        slope = float((rate * tokens * sizes / scale)[rate < cap].sum())
        low, high = (low, now) if miss > 0 else (now, high)
        step = now - miss / slope if slope > 0 else math.nan
        # Newton's step where it stays within what is known to hold the optimum, else bisection or a wider search
        if not low < step < high:
            step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else now * 2 + (1 if miss < 0 else -1)
        step = max(now - 8, min(now + 8, step))
        if step == now:
            return now  # no nearer number
        now = step
    raise ArithmeticError(f"no multiplier meets {wanted} tokens within {TOLERANCE}")


def _multipliers(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, multiplier, scale): of sizes (source, n_tokens, documents), as many rows a source as it has different sizes."""

    def solve(table: pa.Table) -> pa.Table:
        n, documents = (table.column(c).to_numpy().astype(float) for c in ("n_tokens", "documents"))
        cap, wanted = table.column("cap")[0].as_py(), table.column("wanted")[0].as_py()
        found = multiplier_for(n, documents, float(cap), float(wanted))
        return pa.table({"source": table.column("source").slice(0, 1), "multiplier": [min(found, 1e9)], "scale": [float((n * documents).sum() / documents.sum())]})

    return sizes.join(goals.select("source", "cap", "wanted"), "source").groupBy("source").applyInArrow(solve, "source string, multiplier double, scale double")


def rate_column() -> Column:
    exponent = F.least(F.col("multiplier") * F.col("n_tokens") / F.col("scale"), F.lit(_LARGEST))
    return F.least(F.exp(exponent), F.col("cap").cast("double"))


def _offsets(rated: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, offset): how far each source's rounding has to move so that its copies' tokens come nearest to the target.

    A document gets floor(rate + u + offset) copies. As the offset rises from -1 to 1 the tokens rise; how much at which
    step is summed by source and step (at most 2 * ROUNDING_STEPS + 3 rows a source).
    """
    edge = F.col("rate") + F.col("u")
    room = F.ceil(edge) - edge  # the offset at which the document gets its next copy, from 0 up
    step = lambda c: F.ceil(c * ROUNDING_STEPS).cast("int")
    base = F.least(F.greatest(F.floor(edge) - 1, F.lit(0)), F.col("cap"))
    first = F.lit(-ROUNDING_STEPS - 1)
    # crossings at room - 1 and room, as far as the copies stay within 0 and the cap
    crossing = [F.struct(step(room - 1 + k).alias("step"), F.when((F.floor(edge) + k >= 1) & (F.floor(edge) + k <= F.col("cap")), F.col("n_tokens")).otherwise(0).alias("tokens")) for k in (0, 1)]
    moved = rated.select("source", F.explode(F.array(F.struct(first.alias("step"), (base * F.col("n_tokens")).alias("tokens")), *crossing)).alias("c"))
    sums = moved.groupBy("source", "c.step").agg(F.sum("c.tokens").alias("tokens"))

    def nearest(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("step").to_numpy())
        steps, total = table.column("step").to_numpy()[order], np.cumsum(table.column("tokens").to_numpy()[order])
        at = steps[1:] if len(steps) > 1 else np.zeros(1)
        best = int(np.argmin(np.abs(total[1:] - table.column("wanted")[0].as_py()))) if len(steps) > 1 else 0
        return pa.table({"source": table.column("source").slice(0, 1), "offset": [float(at[best]) / ROUNDING_STEPS]})

    return sums.join(goals.select("source", "wanted"), "source").groupBy("source").applyInArrow(nearest, "source string, offset double")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, tokenizer_path: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies): how often each document of the target sources stands in the mix.

    Every document of a target source has one row, with 0 copies where it is left out; no document stands in the mix more
    often than its source's max_repeats. Documents of other or null sources are no part of it; null and empty texts have
    0 tokens and 0 copies. A source that has no tokens is left out and its share goes to the others in proportion.
    Rows that come twice are rounded alike. Empty tables give an empty result. Sources whose multiplier can't be found are an
    error.
    """
    goal = targets.groupBy("source").agg(F.max("target_share").cast("double").alias("share"), F.max("max_repeats").cast("long").alias("cap")).filter("source is not null and share > 0 and cap > 0")
    caps = _of_sources(goal.select(F.col("source").alias("__source"), "cap"))
    mine = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).join(caps, F.col("source") == F.col("__source")).drop("__source")
    sized = cut_lineage(with_token_counts(mine, "text", "n_tokens", tokenizer_path))
    sizes = cut_lineage(sized.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("documents")))
    stats = sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("documents")).alias("tokens"))
    goals = planned(cut_lineage(stats.join(goal, "source")), total_tokens)
    tilts = cut_lineage(_multipliers(sizes, goals))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rate = F.when(F.col("n_tokens") > 0, rate_column()).otherwise(0.0)
    rated = sized.join(_of_sources(tilts), "source", "left").withColumns({"rate": F.coalesce(rate, F.lit(0.0)), "u": uniform})
    part = goals.filter("wanted < most * (1 - 1e-12)")
    offsets = cut_lineage(_offsets(rated.filter("rate > 0"), part))
    moved = rated.join(_of_sources(offsets), "source", "left")
    copies = F.when(F.col("rate") > 0, F.least(F.greatest(F.floor(F.col("rate") + F.col("u") + F.coalesce("offset", F.lit(0.0))), F.lit(0)), F.col("cap"))).otherwise(0)
    return moved.select("doc_id", "source", "n_tokens", "rate", copies.cast("long").alias("copies"))


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its documents, those in the mix, copies, tokens, shares wanted and reached, most repeats."""
    by_source = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("copies") > 0).alias("documents_used"), F.sum("copies").alias("copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"),
    )
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = wanted.join(by_source, "source", "left").na.fill(0, ["documents", "documents_used", "copies", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row a source
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), total.cast("double")), F.lit(0.0))
    return every.withColumn("actual_share", share)
