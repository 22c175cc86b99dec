"""Studies of runs that need the texts again: key terms, word-level changes, loops, bootstrap intervals."""

from __future__ import annotations

import math
import random
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions import native as N
from sonoframe.functions import text as T
from sonoframe.operators import aggregates as A
from sonoframe.operators import draws as D
from sonoframe.operators import ranks as R
from sonoframe.session import cut_lineage
from sonoframe.text import postcorrect

_NO_TERMS = "cast(array() as array<struct<text: string, kind: string>>)"


def with_terms(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """runs with the key terms of their samples; none where the sample is unknown."""
    terms = samples.dropDuplicates(["id"]).select(F.col("id").alias("sampleId"), "keyTerms")
    return runs.join(terms, "sampleId", "left").withColumn("keyTerms", F.coalesce("keyTerms", F.expr(_NO_TERMS)))


def rescored(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Records with rates, counts and flags worked out anew from their texts; failed ones keep null rates."""
    scored = T.once(with_terms(runs, samples), ["reference", "text", "keyTerms"], c=T.compare_texts("reference", "text"), f=T.critical_flags("reference", "text", "keyTerms"))
    ok = A.succeeded()
    pick = lambda c: F.when(ok, c)
    names = {"wer": "wer", "cer": "cer", "substitutions": "substitutions", "deletions": "deletions", "insertions": "insertions", "referenceWords": "reference_words"}
    out = scored.withColumns({n: pick(F.col(f"c.{m}")) for n, m in names.items()} | {"critical": F.when(ok, F.col("f")).otherwise(F.col("critical"))})
    return out.withColumn("hasCritical", F.exists("critical", lambda x: x["severity"] == "critical")).drop("c", "f", "keyTerms")


def key_term_summary(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """(configuration, kind, occurrences, missed) over all repetitions of successful runs."""
    counted = runs.filter(A.succeeded()).groupBy(*A.CONFIG, "sampleId", "reference", "text").agg(F.count(F.lit(1)).alias("n"))
    ok = with_terms(counted, samples).filter(F.size("keyTerms") > 0)
    outcomes = T.once(ok, ["reference", "text", "keyTerms"], o=T.term_outcomes("reference", "text", "keyTerms")).select(*A.CONFIG, "n", F.explode("o").alias("o"))
    return outcomes.groupBy(*A.CONFIG, F.col("o.kind").alias("kind")).agg(F.sum("n").alias("occurrences"), F.sum(F.when(~F.col("o.found"), F.col("n")).otherwise(0)).alias("missed"))


def near_terms(texts: DataFrame, terms: DataFrame, longest: int, preset: str = "strict") -> DataFrame:
    """(stretch, term, distance): stretches of up to ``longest`` words of the texts (text), without blanks and accents, and the
    terms (term) that are no further from them than the preset allows, but not equal.

    A theta join without a cross join: the distinct stretches meet the terms of their first letter and about their length.
    """
    rules = postcorrect.PRESETS[preset]
    plain = lambda c: F.transform(N.word_list(F.col(c)), N.fold_accents)
    words = texts.select(plain("text").alias("w"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w")))).alias("k")
    placed = words.filter("size(w) > 0").select("w", sizes).select("w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    stretches = placed.select(F.array_join(F.slice("w", F.col("i"), F.col("k")), "").alias("stretch")).distinct().filter(F.length("stretch") >= rules.min_len)
    known = terms.select(F.array_join(plain("term"), "").alias("term")).distinct().filter(F.length("term") >= rules.min_len)
    most = rules.max_distance
    block = lambda c, d: [F.substring(c, 1, 1).alias("a"), (F.length(c) + d).alias("n")]
    near = known.select("term", F.explode(F.array(*map(F.lit, range(-most, most + 1)))).alias("d")).select("term", *block("term", F.col("d")))
    pairs = stretches.select("stretch", *block("stretch", F.lit(0))).join(near, ["a", "n"]).filter("stretch != term")
    distance = F.levenshtein("stretch", "term", most)
    allowed = F.least(F.floor(F.length("term") * rules.ratio), F.lit(most))
    return pairs.withColumn("distance", distance.cast("long")).filter((F.col("distance") >= 0) & (F.col("distance") <= allowed)).select("stretch", "term", "distance")


def found_from_flags(scored: DataFrame, samples: DataFrame) -> DataFrame:
    """(configuration, kind, occurrences, found), told from the records' flags alone: a flag's message begins with the kind of
    the term that wasn't found. Counts first repetitions; kinds that no sample has are left out."""
    first = scored.filter(A.first_repetition())
    terms = with_terms(first.groupBy(*A.CONFIG, "sampleId").agg(F.count(F.lit(1)).alias("n")), samples).select(*A.CONFIG, "n", F.explode("keyTerms.kind").alias("kind"))
    occurrences = terms.groupBy(*A.CONFIG, F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit("term")).alias("kind")).agg(F.sum("n").alias("occurrences"))
    flags = first.select(*A.CONFIG, F.explode(F.filter("critical", lambda f: f["kind"] == "keyTerm")).alias("f"))
    missed = flags.groupBy(*A.CONFIG, F.regexp_extract("f.message", "^expected (.*) term not found", 1).alias("kind")).agg(F.count(F.lit(1)).alias("missed"))
    both = occurrences.join(missed, [*A.CONFIG, "kind"], "left")
    return both.select(*A.CONFIG, "kind", "occurrences", (F.col("occurrences") - F.coalesce("missed", F.lit(0))).alias("found"))


def word_changes(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Reference words that one run of a pair heard and the other didn't, by position; texts of unequal length are left out."""
    flat = with_terms(pairs, samples).select("*", *(F.col(f"{side}.{c}").alias(f"__{side}_{c}") for side in "bv" for c in ("reference", "text")))
    paired = T.once(flat, ["__b_reference", "__b_text"], x=T.word_statuses("__b_reference", "__b_text"))
    paired = T.once(T.once(paired, ["__v_reference", "__v_text"], y=T.word_statuses("__v_reference", "__v_text")), ["keyTerms"], keys=T.key_words("keyTerms"))
    zipped = paired.filter(F.size("x") == F.size("y")).select(*A.CONFIG, "sampleId", "repetition", "keys", F.posexplode(F.arrays_zip("x", "y")).alias("place", "z"))
    changed = zipped.filter(F.col("z.x.correct") != F.col("z.y.correct"))
    in_term = F.exists(F.split("z.x.word", "'"), lambda p: F.array_contains(F.col("keys"), p))
    return changed.select(
        *A.CONFIG, "sampleId", "repetition", "place", F.col("z.x.word").alias("reference_word"), F.col("z.x.heard").alias("baseline"), F.col("z.y.heard").alias("variant"),
        in_term.alias("in_key_term"), F.col("z.y.correct").alias("fixed"),
    )


def word_deltas(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Per configuration: pairs, words fixed and broken, broken outside key terms, and extra words."""
    by = word_changes(pairs, samples).groupBy(*A.CONFIG).agg(
        F.count_if("fixed").alias("fixes"), F.count_if(~F.col("fixed")).alias("regressions"), F.count_if(~F.col("fixed") & ~F.col("in_key_term")).alias("regressions_outside")
    )
    extra = pairs.groupBy(*A.CONFIG).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("v.insertions") - F.col("b.insertions")).alias("insertions_delta"))
    return extra.join(by, A.CONFIG, "left").na.fill(0)


def first_examples(changes: DataFrame, most: int = 25) -> DataFrame:
    order = Window.partitionBy(*A.CONFIG, "fixed").orderBy("sampleId", "repetition", "place")
    return changes.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def chunking_study(runs: DataFrame, mode: str = "mode") -> DataFrame:
    """Per configuration and mode: rates, runaways, loops, lost endings and how long the texts are."""
    length = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))) / F.greatest(F.lit(1), F.col("referenceWords"))
    judged = T.once(runs, ["text", "reference"], loop=T.has_loop("text", "reference"), lost=T.ending_missing("text", "reference")).withColumn("ratio", length)
    return judged.groupBy(*A.CONFIG, mode).agg(
        F.count(F.lit(1)).alias("samples"), F.try_divide(F.sum(A.word_errors()).cast("double"), F.sum("referenceWords").cast("double")).alias("wer_micro"), F.count_if(F.col("wer") >= 1).alias("runaway"),
        F.count_if("loop").alias("loops"), F.count_if("lost").alias("endings_missing"), F.min("ratio").alias("length_ratio_min"), F.max("ratio").alias("length_ratio_max"),
        F.sum("inferenceMs").alias("inference_ms"), F.sum("chunkingMs").alias("chunking_ms"),
    )


def _interval(sorted_values: np.ndarray, percent: float) -> float:
    return float(sorted_values[min(len(sorted_values) - 1, max(0, round(percent / 100 * (len(sorted_values) - 1))))])


class Draws:
    """What random.Random(seed).choice picks, in its order, by the same generator's raw numbers in bulk."""

    def __init__(self, seed: int):
        key = random.Random(seed).getstate()[1]
        self.source = np.random.MT19937()
        self.source.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], dtype=np.uint32), "pos": key[-1]}}
        self.rest = np.zeros(0, dtype=np.uint64)

    def picks(self, n: int, count: int) -> np.ndarray:
        """The next ``count`` choices among 0..n-1. Numbers of the bits of n are drawn again until they are below n."""
        found, have = [], 0
        shift = np.uint64(32 - n.bit_length())
        while have < count:
            raw = self.rest if len(self.rest) else self.source.random_raw(2 * (count - have) + 64)
            usable = np.flatnonzero((raw >> shift) < n)[: count - have]
            used = int(usable[-1]) + 1 if len(usable) == count - have else len(raw)
            found.append((raw[usable] >> shift).astype(np.int64))
            have += len(usable)
            self.rest = raw[used:]
        return np.concatenate(found)

    def resampled(self, n: int, resamples: int, block: int = 4_000_000):
        """Blocks of resamples of n picks each, as an array (resamples of the block, n)."""
        step = max(1, block // n)
        for i in range(0, resamples, step):
            rows = min(step, resamples - i)
            yield self.picks(n, rows * n).reshape(rows, n)


def bootstrap(runs: DataFrame, resamples: int = 5000, seed: int = 7, most_samples: int = 100_000) -> DataFrame:
    """Intervals of each configuration's micro rate, and of its difference to the best one, on samples that all have.

    The same draws serve all configurations. What is resampled is a table of samples by configurations, two numbers each.
    As all draws are one generator's sequence they are made on the driver, where the table is brought after it was
    counted: a set of more than ``most_samples`` is an error, not a sample of it; use ``spread_bootstrap`` for those.
    """
    key = [*A.CONFIG, "sampleId"]
    rated = A.latest_deliveries(runs.filter(A.first_repetition()), key, ["timestampMs", "runId", "ingestedAt"])
    table = rated.join(A.complete_samples(rated), "sampleId", "left_semi").select(*key, A.word_errors().alias("e"), F.col("referenceWords").alias("w"))
    size = table.select("sampleId").distinct().count()
    if size > most_samples:
        raise ValueError(f"{size} samples; the bootstrap is for evaluation sets of at most {most_samples}")
    rows = table.collect()
    samples = sorted({r["sampleId"] for r in rows})
    configs = sorted({(r["modelId"], r["decoding"]) for r in rows})
    shape = "modelId string, decoding string, samples long, wer double, low double, high double, diff_low double, diff_high double, verdict string"
    spark = runs.sparkSession
    if not samples:
        return spark.createDataFrame([], shape)
    at = {s: i for i, s in enumerate(samples)}
    errors, words = np.zeros((len(configs), len(samples))), np.zeros((len(configs), len(samples)))
    for r in rows:
        c = configs.index((r["modelId"], r["decoding"]))
        errors[c, at[r["sampleId"]]], words[c, at[r["sampleId"]]] = r["e"], r["w"]
    rate = lambda e, w: np.divide(e, w, out=np.zeros_like(e), where=w > 0)
    full = rate(errors.sum(axis=1), words.sum(axis=1))
    blocks = Draws(seed).resampled(len(samples), resamples)
    drawn = np.concatenate([np.stack([rate(errors[c][p].sum(axis=1), words[c][p].sum(axis=1)) for c in range(len(configs))], axis=1) for p in blocks])
    best = int(full.argmin())
    out = []
    for c, (model, decoding) in enumerate(configs):
        own, diff = np.sort(drawn[:, c]), np.sort(drawn[:, c] - drawn[:, best])
        low = _interval(diff, 2.5)
        verdict = "-" if c == best else "clearly worse" if low > 0 else "not distinguishable"
        out.append((model, decoding, len(samples), float(full[c]), _interval(own, 2.5), _interval(own, 97.5), low, _interval(diff, 97.5), verdict))
    return spark.createDataFrame(out, shape)


def _weights(sample: int, seed: int, resamples: int) -> np.ndarray:
    """How often a sample is drawn in each resample: Poisson numbers of mean one, from a hash of sample, seed and resample."""
    x = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((sample ^ seed * 0x632BE59BD9B4E019) & (1 << 64) - 1)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right").astype(np.float64)


#: Cumulated probabilities of the Poisson distribution of mean one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def spread_bootstrap(runs: DataFrame, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """``bootstrap`` for sets of any size: each resample counts a sample a Poisson number of times, so that the draws of a sample
    are made where its rows are and only sums by configuration and resample are shuffled.

    All configurations share a sample's draws. The intervals are those of ``bootstrap`` but for the draws, which are others. An
    empty table gives an empty result.
    """
    key = [*A.CONFIG, "sampleId"]
    rated = A.latest_deliveries(runs.filter(A.first_repetition()), key, ["timestampMs", "runId", "ingestedAt"])
    table = rated.join(A.complete_samples(rated), "sampleId", "left_semi").select(*A.CONFIG, F.xxhash64("sampleId").alias("s"), A.word_errors().cast("double").alias("e"), F.col("referenceWords").cast("double").alias("w"))
    rows = table.na.fill(0, ["e", "w"]).repartition("s").sortWithinPartitions("s")

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        last, drawn = None, None
        for batch in batches:
            for model, decoding, s, e, w in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if s != last:
                    last, drawn = s, _weights(s, seed, resamples)
                got = sums.get((model, decoding))
                if got is None:
                    got = sums[model, decoding] = np.zeros((2, resamples))
                got += np.outer((e, w), drawn)
        for (model, decoding), (e, w) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([model] * resamples, pa.string()), pa.array([decoding] * resamples, pa.string()), pa.array(np.arange(resamples)), pa.array(e), pa.array(w)], ["modelId", "decoding", "resample", "e", "w"])

    ratio = lambda e, w: F.coalesce(F.try_divide(F.sum(e), F.sum(w)), F.lit(0.0))
    drawn = rows.mapInArrow(run, "modelId string, decoding string, resample long, e double, w double").groupBy(*A.CONFIG, "resample").agg(ratio("e", "w").alias("rate"))
    full = cut_lineage(table.groupBy(*A.CONFIG).agg(F.count(F.lit(1)).alias("samples"), ratio("e", "w").alias("wer")))  # a row a configuration
    best = full.agg(F.min(F.struct("wer", *A.CONFIG)).alias("b")).select(*(F.col(f"b.{c}").alias(f"best_{c}") for c in A.CONFIG))
    is_best = F.col("modelId").eqNullSafe(F.col("best_modelId")) & F.col("decoding").eqNullSafe(F.col("best_decoding"))
    rates = cut_lineage(drawn.join(F.broadcast(best)))
    of_best = rates.filter(is_best).select("resample", F.col("rate").alias("best_rate"))
    both = rates.join(of_best, "resample").select(*A.CONFIG, "rate", (F.col("rate") - F.col("best_rate")).alias("diff"))
    wanted = {"low": R.nearest_index(2.5), "high": R.nearest_index(97.5)}
    own = R.order_statistics(both, A.CONFIG, "rate", wanted).drop("n")
    apart = R.order_statistics(both, A.CONFIG, "diff", wanted).select(*A.CONFIG, F.col("low").alias("diff_low"), F.col("high").alias("diff_high"))
    verdict = F.when(is_best, "-").when(F.col("diff_low") > 0, "clearly worse").otherwise("not distinguishable")
    out = full.join(own, A.CONFIG).join(apart, A.CONFIG).join(F.broadcast(best))
    return out.select(*A.CONFIG, "samples", "wer", "low", "high", "diff_low", "diff_high", verdict.alias("verdict"))


def _in_blocks(rows: DataFrame, key: list[str], numbers: list[str]) -> DataFrame:
    """(key..., part, nth, n, sums of the numbers, the first two as packed values): rows in their order, a row for each stretch of
    a key; null numbers are 0."""

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in key])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            values = [batch.column(c).fill_null(0).to_numpy() for c in numbers]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                out.append({c: batch.column(c)[a].as_py() for c in key} | {"part": part, "nth": nth, "n": b - a} | {c: int(v[a:b].sum()) for c, v in zip(numbers, values)} | {f"{c}s": v[a:b].tobytes() for c, v in zip(numbers[:2], values)})
                nth += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    packed = [f"{c}s" for c in numbers[:2]]
    arrow = pa.schema([(c, pa.string()) for c in key] + [(c, pa.int64()) for c in ("part", "nth", "n", *numbers)] + [(c, pa.binary()) for c in packed])
    shape = ", ".join([*(f"{c} string" for c in key), *(f"{c} long" for c in ("part", "nth", "n", *numbers)), *(f"{c} binary" for c in packed)])
    return rows.mapInArrow(run, shape)


def bootstrap_by_language(runs: DataFrame, languages: tuple[str, ...] = ("fr", "en"), resamples: int = 5000, seed: int = 7) -> DataFrame:
    """As ``bootstrap``, for each configuration and language on its own records; one generator serves all in their order.

    The draws are that one sequence, but made in pieces by many tasks (``draws``). A task holds two numbers for each record of one
    configuration and language; the driver has a row for each of these and bounded counts.
    """
    spark, key = runs.sparkSession, [*A.CONFIG, "language"]
    order = [*key, "runId", "sampleId", "timestampMs", "e", "w"]
    rated = runs.filter(A.first_repetition() & F.col("language").isin(*languages))
    numbers = {"e": A.word_errors(), "w": F.col("referenceWords"), "c": F.col("hasCritical").cast("int")}
    narrow = rated.select(*order[:-2], *(c.cast("long").alias(n) for n, c in numbers.items()))
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select(*key, "e", "w", "c")
    blocks = cut_lineage(_in_blocks(ordered, key, ["e", "w", "c"]))
    groups = blocks.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("n", "e", "w", "c"))).collect()
    groups.sort(key=lambda r: ([(r[c] is not None, r[c] or "") for c in A.CONFIG], languages.index(r["language"])))
    shape = "modelId string, decoding string, language string, samples long, wer double, low double, high double, critical_samples long"
    if not groups:
        return spark.createDataFrame([], shape)

    plan = D.Plan(seed, [r["n"] for r in groups], resamples)
    sizes, length = plan.sizes, plan.block
    most = max(-(-plan.total // (8 * spark.sparkContext.defaultParallelism)), 1 << 22)  # raw numbers of a task
    asked = [(i, *x) for i, x in enumerate(plan.expected(-(-most // length)))]

    def count(batches):
        for batch in batches:
            rows = [(g, first, D.counted(seed, sizes[g], first, last, length)) for g, first, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["g", "first", "counts"])

    apart = lambda df, n: df.repartitionById(n, F.col("id").cast("int"))
    for r in apart(spark.createDataFrame(asked, "id long, g long, first long, last long"), len(asked)).mapInArrow(count, "g long, first long, counts array<long>").collect():
        plan.add(r["g"], r["first"], r["counts"])
    pieces = [(i, p.group, p.start, p.end, p.first, *(groups[p.group][c] for c in key)) for i, p in enumerate(plan.pieces(-(-most // length)))]

    def draw(batches):
        rows = (r for b in batches for r in b.to_pylist())
        for (g, start, end, first), own in groupby(rows, lambda r: (r["g"], r["start"], r["end"], r["first"])):
            held = [(r["es"], r["ws"]) for r in own]
            columns = [np.frombuffer(b"".join(x), dtype=np.int64) for x in zip(*held)]
            begin, found = D.sums(seed, start, end, first, columns, resamples)
            size = found.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(size, g), np.arange(begin, begin + size), *found)], ["g", "resample", "e", "w"])

    named = spark.createDataFrame(pieces, "id long, g long, start long, end long, first long, " + ", ".join(f"__{c} string" for c in key))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key))
    given = blocks.join(F.broadcast(named), same).select("id", "g", "start", "end", "first", "part", "nth", "es", "ws")
    drawn = apart(given, len(pieces)).sortWithinPartitions("id", "part", "nth").mapInArrow(draw, "g long, resample long, e long, w long")
    summed = drawn.groupBy("g", "resample").agg(F.sum("e").alias("e"), F.sum("w").alias("w"))
    rate = F.when(F.col("w") > 0, F.col("e").cast("double") / F.col("w").cast("double")).otherwise(F.lit(0.0))
    rates = summed.groupBy("g").agg(F.sort_array(F.collect_list(rate)).alias("rates"))  # as many as there are resamples
    at = {c: F.element_at("rates", round(percent / 100 * (resamples - 1)) + 1).alias(c) for c, percent in (("low", 2.5), ("high", 97.5))}
    bounds = {r["g"]: (r["low"], r["high"]) for r in rates.select("g", *at.values()).collect()}
    out = [(*(r[c] for c in key), r["n"], r["e"] / r["w"] if r["w"] else 0.0, *bounds[g], r["c"]) for g, r in enumerate(groups)]
    return spark.createDataFrame(out, shape)
