"""Look-alikes, truncation, repetition and percentiles on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.llm import lookalikes, quantiles, queries, repetition, truncation

SAME = [
    ("été", "été"), ("ab c", "a​b c"), ("ａｂ１", "ab1"), ("ﬁn", "fin"), ("pаssе", "passe"), ("ⅼе", "le"),
    ("ѐ", "è"), ("a　b", "a b"), ("μg", "µg"), ("", "​"), ("­do", "do"), ("ոսօ", "nuo"),
]
APART = [("ete", "été"), ("m2", "m²"), ("1", "①"), ("a b", "a  b"), ("%", "‰"), ("d", "д"), ("l", "λ"), ("a", "A"), ("oe", "œ"), ("ab", "ab"), (None, "a"), (None, None)]


def test_look_alikes(spark):
    rows = [(i, a, b, "x") for i, (a, b) in enumerate(SAME + APART)] + [(0, *SAME[0], "x")]
    df = spark.createDataFrame(rows, "id long, l string, r string, canonical string")
    found = lookalikes.differing_only_in_characters(df, "l", "r").collect()
    assert {r.id for r in found} == set(range(len(SAME))) and len(found) == len(SAME) + 1
    forms = {r.id: (r.l, r.r) for r in lookalikes.normalize(df, ["l", "r"]).collect()}
    for i, (a, b) in enumerate(SAME + APART):
        assert (forms[i][0] == forms[i][1]) == (i < len(SAME) or a == b)
        assert (forms[i][0] is None) == (a is None)
    assert lookalikes.normalize(df.limit(0), ["l", "r"]).collect() == []


def test_hyphens_look_alike():
    table = lookalikes.look_alike_table()
    assert table["\u2010"] == table["\u2011"] == "-" and table["\u0f0c"] == "\u0f0b" and table["\u202f"] == " "


WHOLE = "Le patient prend deux comprimés chaque matin avant le repas du soir. La secrétaire confirme le rendez-vous de jeudi prochain avec le médecin."
CUT = [WHOLE[:50], WHOLE[:57] + "…", WHOLE[:95], WHOLE[:118] + " ", WHOLE[:101] + "..."]
NOT_CUT = [WHOLE, WHOLE.rstrip("."), WHOLE[:68], WHOLE.lower().replace(".", ""), "coupe le son", "", None, WHOLE[:-1] + "…"]


def _records(spark, texts):
    return spark.createDataFrame([("transcribe_results", str(i), "p", "fr", t) for i, t in enumerate(texts)], "origin string, record_key string, source string, language string, text string")


def test_truncation(spark):
    texts = CUT + NOT_CUT + [WHOLE.replace("deux", "trois"), WHOLE.replace("jeudi", "mardi")]
    df = _records(spark, texts)
    got = {int(r.record_key): r.truncated for r in truncation.assess(df.unionByName(df.limit(3))).collect()}
    assert got == {i: i < len(CUT) for i in range(len(texts))}
    rates = truncation.rates(truncation.assess(df)).collect()
    assert len(rates) == 1 and rates[0].truncated == len(CUT) and rates[0].records == len(texts)
    assert truncation.assess(df.limit(0)).collect() == []


def _features(spark, texts):
    rows = _records(spark, texts).select(F.xxhash64("text").alias("tid"), "text")
    return truncation.features(rows).cache()


def _brute(rows):
    """Verified pairs of open texts with all texts: (tid, copy) and the vote."""
    words = {r.tid: r.words.split(" ") for r in rows}
    votes = {(a.tid, b.tid): truncation.closing_vote(words[a.tid], words[b.tid], b.ends, b.dots) for a in rows for b in rows if not a.closed and a.tid != b.tid}
    return {pair: vote for pair, vote in votes.items() if vote is not None}


def test_open_texts_of_a_band_are_verified_or_meet_all_of_it(spark, monkeypatch):
    opening = "le docteur demande au bureau un rendez vous et"
    rest = [" ".join(f"m{i * 7 + j * (i + 3)}" for j in range(20)) for i in range(25)]
    texts = [f"{opening} {x}. Merci." for x in rest] + [opening + " encore" * 500 + ". Oui."]
    cut = [f"{opening} {' '.join(x.split()[:12])}" for x in rest] + [opening + " toujours bien"]
    # a near-copy without a sentence's end tells of a word cut off
    texts += ["deux grandes boîtes de paracétamol pour", *cut, "deux grandes boîtes de paracé"]
    feats = _features(spark, texts)
    rows = feats.collect()
    bands = {r.tid: (set(r.asks), set(r.answers)) for r in rows}
    met = {a for (a, b) in _brute(rows) if bands[a][0] & bands[b][1]}
    short = {a for (a, _) in _brute(rows)} - met
    assert len(met) >= 24 and len(short) == 1
    for block in (1024, 7):
        monkeypatch.setattr(truncation, "BLOCK", block)
        got = truncation._votes(feats).collect()
        assert {r.tid for r in got} == met | short and all(r.cut > r.complete for r in got)


def test_blocks_give_all_pairs_of_a_band(spark, monkeypatch):
    opening = "le docteur demande au bureau un rendez vous et"
    said = ["de jeudi sans faute avec elle", "de mardi sans faute avec elle", "de jeudi sans faute avec moi"]
    feats = _features(spark, [f"{opening} {x}{end}" for x in said for end in (".", " hier. Oui.", "")])
    banded = feats.select("tid", "closed", F.explode("answers").alias("band"))
    asked = feats.filter("not closed").select("tid", F.explode("asks").alias("band"))
    rows = feats.collect()
    expected = {}
    for (a, _), vote in _brute(rows).items():
        cut, complete = expected.get(a, (0, 0))
        expected[a] = (cut + vote, complete + 1 - vote)
    assert len(expected) == 3
    for block in (1024, 2):
        monkeypatch.setattr(truncation, "BLOCK", block)
        assert {r.tid: (r.cut, r.complete) for r in truncation._block_votes(feats, banded, asked).collect()} == expected


def test_every_text_of_the_bands_votes(spark):
    """Not only a few that stand for a band: each near-copy that shares one, once, however many bands it shares."""
    opening = "le docteur demande au bureau un rendez vous et le patient de"
    said = [f"{opening} {x} arrive avec {y}" for x in ("paris", "lyon", "lille", "nice", "brest") for y in ("elle", "moi", "lui")]
    feats = _features(spark, [x + ". Merci." for x in said] + [x + " hier. Oui." for x in said] + said[:4] + [f"{opening} ly", f"{opening} li"])
    rows = feats.collect()
    expected = {}
    bands = {r.tid: (set(r.asks), set(r.answers)) for r in rows}
    for (a, b), vote in _brute(rows).items():
        if bands[a][0] & bands[b][1]:
            cut, complete = expected.get(a, (0, 0))
            expected[a] = (cut + vote, complete + 1 - vote)
    assert len(expected) == 6 and max(sum(x) for x in expected.values()) > 4
    assert {r.tid: (r.cut, r.complete) for r in truncation._votes(feats).collect()} == expected


def test_votes_in_arrays_are_those_of_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = "a ab abc le les 1 12 123 de dem demain été x xy".split()
    seen = set()
    for n in (2, 3, 9, 14, 40):
        base = rng.choice(vocabulary, n + 12)
        rows = []
        for tid in range(60):
            words = np.where(rng.random(n + 12) < 0.1, rng.choice(vocabulary, n + 12), base)[rng.integers(0, 2) : rng.integers(n + 1, n + 13) - (tid % 3 == 0)]
            rows.append(([] if tid % 3 == 0 else None, [], tid, " ".join(words), "".join(rng.choice(["0", "0", "0", "1"], len(words))), bool(tid % 2)))
        pairs = truncation.block_votes(rows)
        for many, at_once in ((1, 1 << 18), (1, 100), (10_000, 1)):
            monkeypatch.setattr(truncation, "MANY", many)
            monkeypatch.setattr(truncation, "AT_ONCE", at_once)
            assert sorted(truncation.block_votes(rows)) == sorted(pairs)
        split = {r[2]: (r[3].split(" "), r[4], r[5]) for r in rows}
        votes = {t: [truncation.closing_vote(split[t][0], *split[u]) for u in split if u != t] for t in split if t % 3 == 0}
        assert {t: (cut, complete) for t, cut, complete in pairs} == {t: (v.count(1), v.count(0)) for t, v in votes.items() if v.count(1) + v.count(0)}
        seen |= {x for v in votes.values() for x in v}
    assert seen == {0, 1, None}


def test_short_texts_count_their_near_copies(spark):
    feats = _features(spark, ["ouvre la", "ouvre la porte.", "ouvre la porte du bas. Oui.", "ouvre le", "ouvre", "ouvre la por", "Ouvre la porte", "va vite…", "va vi", "non. va"])
    rows = feats.collect()
    expected = {}
    for (a, _), vote in _brute(rows).items():
        cut, complete = expected.get(a, (0, 0))
        expected[a] = (cut + vote, complete + 1 - vote)
    got = {r.tid: (r.cut, r.complete) for r in truncation._short_votes(feats).collect()}
    assert got == expected and len(got) >= 4


def test_a_beginning_of_a_number_needs_the_word_before():
    words = "merci de joindre le reçu au dossier 12 34".split()
    assert truncation.closing_vote(words, "merci de joindre le bail au dossier 77 3456 demain".split(), "0000000001", False) is None
    assert truncation.closing_vote(words, "merci de joindre le reçu au dossier 12 3456 demain".split(), "0000000001", False) == 1


def test_a_cut_at_the_length_of_others_is_told_by_closings(spark):
    """Without near-copies terminality alone finds the cut, at every size of the corpus."""
    said = lambda i: " ".join(f"{chr(97 + (i * j) % 26)}{i}x{j}" for j in range(3, 9))
    for size in (40, 400):
        texts = [f"{said(i)} pour {said(i + 900)} demain." for i in range(size)] + ["entre nous tout est pour", "entre nous tout est dit demain"]
        got = {int(r.record_key): r.truncated for r in truncation.assess(_records(spark, texts)).collect()}
        assert [i for i, x in got.items() if x] == ([size] if size > 100 else [])


def test_fragments_are_found_however_often_they_are_met(spark):
    said = lambda i, k: " ".join(f"{chr(97 + (i * j + k) % 26)}{i}x{j}" for j in range(3, 6 + i % 9))
    many = [f"{said(i, 1)} du traite" for i in range(60)]
    whole = [f"{said(i, 2)} du traitement." for i in range(100, 130)]
    for cut in (many[:1], many[:7], many):
        got = {int(r.record_key): r.truncated for r in truncation.assess(_records(spark, cut + whole)).collect()}
        assert got == {i: i < len(cut) for i in range(len(cut) + len(whole))}


def test_field_limit(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima"]
    texts = [" ".join(words[(i * 7 + j * (i + 1)) % 12] for j in range(30))[:100] for i in range(12)] + ["Tout va bien."] * 3
    got = {int(r.record_key): r.truncated for r in truncation.assess(_records(spark, texts)).collect()}
    assert all(got[i] for i in range(12)) and not any(got[i] for i in range(12, 15))


def _share(text):
    words = repetition._WORD.findall((text or "").lower())
    runs, marks = set(), set()
    for i in range(len(words) - 2):
        run = tuple(words[i : i + 3])
        if run in runs:
            marks |= {i, i + 1, i + 2}
        runs.add(run)
    return len(marks) / max(1, len(words))


def test_repetition(spark):
    texts = ["a b c d", "la la la la la la la la la la la la", "Un deux trois. " * 5, "x y z " + "w" * 3000 + " x Y Z", "", None, "de l'eau " * 400, *(" ".join(f"w{i * j}" for j in range(20)) for i in range(40))]
    df = _records(spark, texts)
    got = repetition.assess(df.unionByName(df), None).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.share == pytest.approx(_share(texts[int(r.record_key)])) and 0 <= r.threshold <= 1
    cases = {int(r.record_key) for r in repetition.cases(repetition.assess(df, None)).collect()}
    assert cases == {i for i, t in enumerate(texts) if _share(t) >= 0.3 and len(repetition._WORD.findall(t or "")) >= 12}
    assert repetition.assess(df.limit(0), None).collect() == []


def test_thresholds_follow_the_group(spark):
    """The same text is suspicious where others hardly repeat themselves, and not where most do."""
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    some = lambda i: plain(i) + " so it goes so it goes"
    rows = [("o", f"a{i}", "calm", "fr", plain(i), i % 5) for i in range(300)] + [("o", f"b{i}", "wordy", "fr", some(i), i % 5) for i in range(300)]
    rows += [("o", "a", "calm", "fr", some(1000), 7), ("o", "b", "wordy", "fr", some(1000), 7), ("o", "c", None, None, some(1000), None)]
    df = spark.createDataFrame(rows, "origin string, record_key string, source string, language string, text string, day int")
    got = {r.record_key: r for r in repetition.assess(df).collect()}
    assert got["a"].suspicious and not got["b"].suspicious and got["a"].share == got["b"].share < repetition.ALWAYS
    assert got["a"].threshold < got["b"].threshold and not repetition.cases(repetition.assess(df)).collect()
    without_days = {r.record_key: r.suspicious for r in repetition.assess(df, None).collect()}
    assert without_days == {k: r.suspicious for k, r in got.items()}


def test_cases_are_found_without_thresholds(spark, monkeypatch):
    """Thresholds say who is suspicious; the fixed share of the cases needs none, so none is worked out for it."""
    texts = ["la " * 12, "la " * 11, "so it goes on so it goes on " + " ".join(f"w{i}" for i in range(14)), "so it goes on so it goes on " + " ".join(f"w{i}" for i in range(4)), "", None]
    df = _records(spark, texts).withColumn("day", F.lit(None).cast("date"))
    monkeypatch.setattr(queries, "_records", lambda spark, sf_dir: df.unionByName(df))
    planned = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    found = queries.p3_found(spark, "")
    assert sorted(r.record_key for r in found.collect()) == ["0", "3"] and found.columns == ["origin", "record_key"]
    assert "kll" not in planned(found) and "kll" in planned(queries.p3_shares(spark, ""))


def test_long_texts_are_counted_alike(monkeypatch):
    words = [w for i in range(60) for w in f"w{i % 7} x{i % 5} y{i % 3} la la".split()]
    short = repetition.repeated_words(words)
    monkeypatch.setattr(repetition, "LONG_TEXT", 10)
    assert repetition.repeated_words(words) == short == round(_share(" ".join(words)) * len(words))


def test_sketches_of_parts_add_up(spark):
    rng = np.random.default_rng(2)
    shares = spark.createDataFrame([("o", "fr", str(i % 3), int(i % 7), 20, float(x)) for i, x in enumerate(rng.random(3000))], "origin string, language string, source string, day int, n_words long, share double")
    daily = repetition.share_sketches(shares, "origin", "language", "source", "day")
    assert daily.count() == 21
    limit = repetition.thresholds(daily, quantile=0.2)
    assert all(abs(r.threshold - 0.2) < 0.03 and r.n_texts == 1000 for r in limit.collect())


def test_codes_keep_the_order():
    values = np.array([-math.inf, -1e300, -2.5, -1e-9, 0.0, -0.0, 1e-9, 0.3, 1.0, 7.0, 1e9, math.inf])
    codes = quantiles.encode(values)
    assert (np.diff(codes) >= 0).all() and codes[4] == codes[5] and codes.min() >= 0 and codes.max() < 1 << quantiles.CODE_BITS
    for x in (0.013, 1.0, 12345.0, -7.5):
        assert quantiles.decode(int(quantiles.encode(np.array([x]))[0])) == pytest.approx(x, rel=2**-8)


def test_sketch_ranks_deletions_and_merging():
    rng = np.random.default_rng(1)
    values, wrong = rng.lognormal(0, 1, 60_000), rng.lognormal(3, 1, 20_000)
    sketch, other = np.zeros(quantiles.CELLS, np.int64), np.zeros(quantiles.CELLS, np.int64)
    quantiles.add(sketch, values[:30_000])
    quantiles.add(other, values[30_000:])
    quantiles.add(other, wrong)
    quantiles.add(other, wrong, -1)
    whole = np.zeros(quantiles.CELLS, np.int64)
    quantiles.add(whole, values)
    assert (sketch + other == whole).all()
    ranked = np.sort(values)
    for part, value in zip((0.01, 0.5, 0.9, 0.99), quantiles.quantiles(whole, [0.01, 0.5, 0.9, 0.99])):
        assert abs(np.searchsorted(ranked, value) / len(ranked) - part) < 0.01
    assert quantiles.quantiles(np.zeros(quantiles.CELLS, np.int64), [0.5]) == [None]


@pytest.mark.parametrize("kind", ["ties", "clusters", "wide"])
def test_the_bound_holds_for_many_values(kind):
    rng = np.random.default_rng(6)
    n = 2_000_000
    if kind == "ties":  # a third of all values is one
        values = np.where(rng.random(n) < 0.34, 1.25, rng.lognormal(0, 2, n))
    elif kind == "clusters":  # nearly all codes share the exact levels' prefix
        values = 1.0 + rng.random(n) * 2.0**-4
    else:
        values = np.exp(rng.uniform(-300, 300, n)) * rng.choice([-1, 1], n)
    sketch = np.zeros(quantiles.CELLS, np.int64)
    for part in np.array_split(values, 4):
        quantiles.add(sketch, part)
    bound = quantiles.rank_error(sketch)
    ranked = np.sort(quantiles.encode(values))
    parts = [p / 100 for p in quantiles.PERCENTILES]
    for part, value in zip(parts, quantiles.quantiles(sketch, parts)):
        code = int(quantiles.encode(np.array([value]))[0])
        low, high = np.searchsorted(ranked, code, "left") / n, np.searchsorted(ranked, code, "right") / n
        assert low - bound <= part <= high + bound and bound < 0.12


def test_percentiles_of_a_table(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.lognormal(0, 1, 5000)] + [("b", 3.0)] * 5 + [("c", None), ("c", math.nan), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    cells = quantiles.sketches(df, ["g"])
    got = {r.g: r for r in quantiles.percentiles(cells, ["g"]).collect()}
    assert set(got) == {"a", "b", None} and got["a"].n == 5000 and got["b"].p50 == pytest.approx(3, rel=0.01)
    exact = np.percentile([x for g, x in rows if g == "a"], 50)
    assert got["b"].rank_error == 0 < got["a"].rank_error < 0.1
    few = {r.g: r for r in quantiles.percentiles(quantiles.sketches(spark.createDataFrame([("x", float(i)) for i in range(10)], "g string, value double"), ["g"]), ["g"]).collect()}
    assert few["x"].p50 == pytest.approx(4, rel=0.01) and few["x"].p99 == pytest.approx(8, rel=0.01)  # ranks are rounded down
    assert got["a"].p50 == pytest.approx(exact, rel=0.03)
    undone = quantiles.sketches(df.withColumn("k", F.lit(-1)), ["g"], count="k")
    assert quantiles.percentiles(quantiles.add_sketches(cells.unionByName(undone), ["g"]), ["g"]).collect() == []
    assert quantiles.percentiles(quantiles.sketches(df.limit(0), ["g"]), ["g"]).collect() == []
