"""Dictionary post-correction with a vocabulary of any size.

A vocabulary that was counted to be small goes to the workers as a list. Beyond that, stretches of the texts meet the terms in a
blocked join: each distinct stretch is measured once, in the JVM, whatever the number of texts that hold it; only texts that
hold something near a term are walked through, with what the join found for them. Both ways give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import native as N
from sonoframe.functions import text as T
from sonoframe.session import cut_lineage
from sonoframe.text import postcorrect

#: Terms that are sent to the workers as a list: a few megabytes.
MOST_LISTED = 50_000

_STRETCHES = "array<struct<k: bigint, folded: string, plain: string>>"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1))


def _prepared(terms: DataFrame, rules: postcorrect.Preset) -> DataFrame:
    """(surface, folded, plain, k) of the usable terms: k words may stand for them, one fewer or more than they have."""
    words = _words(F.col("term"))
    known = terms.filter("term is not null").select(F.col("term").alias("surface"), words.alias("w")).distinct()
    usable = known.filter(~F.exists("w", lambda x: F.coalesce(N.is_protected(x), F.lit(False))))
    formed = usable.select("surface", F.array_join(F.transform("w", N.fold_accents), "").alias("folded"), F.size("w").cast("long").alias("size")).filter(F.length("folded") >= rules.min_len)
    return formed.select("surface", "folded", F.lower("surface").alias("plain"), F.explode(F.sequence(F.greatest(F.col("size") - 1, F.lit(1)), F.col("size") + 1)).alias("k"))


def _near(asked: DataFrame, terms: DataFrame, rules: postcorrect.Preset) -> DataFrame:
    """(k, folded, distance, surface): terms that a stretch (k, folded) may be a misspelling of."""
    most = rules.max_distance
    block = lambda c, d: [F.substring(c, 1, 1 if rules.same_first_letter else 0).alias("__a"), (F.length(c) + d).alias("__n")]
    spread = terms.select("k", "surface", F.col("folded").alias("term"), F.explode(F.array(*map(F.lit, range(-most, most + 1)))).alias("__d")).select("k", "surface", "term", *block("term", F.col("__d")))
    met = asked.select("k", "folded", *block("folded", F.lit(0))).join(spread, ["k", "__a", "__n"])
    distance, allowed = F.levenshtein("folded", "term", most), F.least(F.floor(F.length("term") * rules.ratio), F.lit(most))
    near = met.withColumn("distance", distance.cast("long")).filter((F.col("distance") >= 0) & (F.col("distance") <= allowed))
    mark = lambda a, b: (F.length(a) == F.length(b) + 1) & F.col(a).startswith(F.col(b)) & F.substring(a, -1, 1).isin("s", "x")
    near = near.filter(~mark("folded", "term") & ~mark("term", "folded"))
    # a stretch that is itself a term, but for accents, is no misspelling of another
    own = terms.groupBy("folded").agg(F.min("surface").alias("__low"), F.max("surface").alias("__high"))
    alone = F.col("__low").isNull() | (F.col("__low") == F.col("surface")) & (F.col("__high") == F.col("surface"))
    return near.join(own, "folded", "left").filter(alone).select("k", "folded", "distance", "surface")


def post_corrected(texts: DataFrame, terms: DataFrame, preset: str = "strict", most_listed: int = MOST_LISTED) -> DataFrame:
    """(text, corrected, changes) of each distinct text that isn't null; ``texts`` has text, ``terms`` term.

    Null, empty and protected terms count for nothing; of terms that differ in case only, give one. An empty vocabulary
    changes nothing, an empty table gives an empty result. Up to ``most_listed`` terms are sent as a list.
    """
    listed = [r["term"] for r in terms.filter("term is not null").select("term").distinct().limit(most_listed + 1).collect()]
    if len(listed) <= most_listed:
        once = texts.filter("text is not null").select("text").distinct()
        done = T.spread(once).select("text", T.post_correct("text", sorted(listed), preset).alias("c"))
        return done.select("text", F.col("c.text").alias("corrected"), F.col("c.changes").alias("changes"))
    return joined_corrections(texts, terms, preset)


def joined_corrections(texts: DataFrame, terms: DataFrame, preset: str = "strict") -> DataFrame:
    """``post_corrected`` by a join of stretches and terms."""
    rules = postcorrect.PRESETS[preset]
    known = _prepared(terms, rules)
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # a handful: words of a term
    once = texts.filter("text is not null").select("text").distinct()
    if not sizes:
        return once.select("text", F.col("text").alias("corrected"), F.expr("cast(array() as array<struct<`from`: string, `to`: string, distance: bigint>>)").alias("changes"))
    longest = max(sizes)
    cut = T.on_batches(lambda text: [dict(zip(("k", "folded", "plain"), x)) for x in postcorrect.stretches(text, longest, rules)], _STRETCHES, 1)
    keyed = T.spread(once).select(F.xxhash64("text").alias("__a"), F.xxhash64(F.lit(3), "text").alias("__b"), "text")
    held = cut_lineage(keyed.select("__a", "__b", F.explode(cut("text")).alias("s")).select("__a", "__b", "s.*"))
    known = cut_lineage(known)
    near = cut_lineage(_near(held.select("k", "folded").distinct(), known, rules))
    exact = held.select("k", "plain").distinct().join(known.select("k", "plain").distinct(), ["k", "plain"])
    hits = held.join(near, ["k", "folded"]).select("__a", "__b", F.struct("k", F.col("folded").alias("what"), "distance", "surface").alias("h"))
    whole = held.join(exact, ["k", "plain"]).select("__a", "__b", F.struct("k", F.col("plain").alias("what"), F.lit(None).cast("long").alias("distance"), F.lit(None).cast("string").alias("surface")).alias("h"))
    # of a text at most the near terms of its own stretches
    by_text = hits.unionByName(whole).distinct().groupBy("__a", "__b").agg(F.collect_list("h").alias("hits"), F.count("h.surface").alias("__near")).filter("__near > 0")

    def walk(text: str, found: list[dict]) -> dict:
        exact_by, near_by = {}, {}
        for h in found:
            if h["surface"] is None:
                exact_by.setdefault(h["k"], set()).add(h["what"])
            else:
                near_by.setdefault((h["k"], h["what"]), []).append((h["distance"], h["surface"]))
        corrected, changes = postcorrect.correct_by(text, postcorrect.Looked(rules, sizes, exact_by, near_by))
        return {"text": corrected, "changes": changes}

    walked = T.on_batches(walk, T.CORRECTED, 2)
    done = keyed.join(by_text, ["__a", "__b"]).select("__a", "__b", walked("text", "hits").alias("c"))
    out = keyed.join(done, ["__a", "__b"], "left")
    none = F.expr("cast(array() as array<struct<`from`: string, `to`: string, distance: bigint>>)")
    return out.select("text", F.coalesce("c.text", "text").alias("corrected"), F.coalesce("c.changes", none).alias("changes"))
