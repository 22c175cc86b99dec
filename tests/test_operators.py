"""Order statistics and operators on ordered rows against slow versions, with empty tables, nulls, ties and repeated rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sonoframe import session
from sonoframe.operators import corrections, ranks, sequences, termstudy, validation, voices
from sonoframe.plans import goldens
from sonoframe.sources import dataset
from sonoframe.text import postcorrect


def _rows(seed: int, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([rng.randrange(-5_000, 5_000), rng.randrange(20)])) for _ in range(n)]


def _by_key(rows):
    out = {}
    for k, x in rows:
        if x is not None:
            out.setdefault(k, []).append(x)
    return {k: sorted(v) for k, v in out.items()}


WANTED = {
    "nearest": (ranks.nearest_rank(95), lambda v: v[max(1, math.ceil(len(v) * 95 / 100)) - 1]),
    "least": (ranks.nearest_rank(0), lambda v: v[0]),
    "linear": (ranks.linear(30), lambda v: v[int((len(v) - 1) * 0.3)] + (v[math.ceil((len(v) - 1) * 0.3)] - v[int((len(v) - 1) * 0.3)]) * ((len(v) - 1) * 0.3 % 1)),
    "mid": (ranks.mid_median(), lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2),
    "upper": (ranks.upper_median(), lambda v: v[len(v) // 2]),
    "index": (ranks.nearest_index(50), lambda v: v[round((len(v) - 1) * 0.5)]),
}


@pytest.mark.parametrize("scale", [1, 1e-3, 1e12])
def test_order_statistics(spark, scale):
    rows = [(k, float(x * scale)) for k, x in _rows(1)] + [("none", None), ("one", 0.0), ("two", -math.inf), ("two", math.inf)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("n", F.lit("clash"))
    got = {r.k: r for r in ranks.order_statistics(df, ["k"], "x", {name: q for name, (q, _) in WANTED.items() if name != "mid"}).collect()}
    known = _by_key(rows)
    assert set(got) == set(known)
    for k, values in known.items():
        assert got[k].n == len(values)
        for name, (_, slow) in WANTED.items():
            if name not in ("mid", "linear") or k != "two":
                assert name == "mid" or got[k][name] == pytest.approx(slow(values), rel=1e-9), (k, name)
    medians = {r.k: r.mid for r in ranks.order_statistics(df.filter("k != 'two' or k is null"), ["k"], "x", {"mid": WANTED["mid"][0]}).collect()}
    assert medians == {k: pytest.approx(WANTED["mid"][1](v)) for k, v in known.items() if k != "two"}
    assert ranks.order_statistics(df.limit(0), ["k"], "x", {"mid": WANTED["mid"][0]}).collect() == []


def test_order_statistics_of_counts_and_of_everything(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "k string, x long")
    counted = df.groupBy("k", "x").count()
    wanted = {"p": ranks.nearest_rank(40)}
    plain = {r.k: (r.n, r.p) for r in ranks.order_statistics(df, ["k"], "x", wanted).collect()}
    assert plain == {r.k: (r.n, r.p) for r in ranks.order_statistics(counted, ["k"], "x", wanted, count="count").collect()}
    values = sorted(x for _, x in rows)
    assert ranks.order_statistics(df, [], "x", wanted).collect()[0].p == values[math.ceil(len(values) * 0.4) - 1]


@pytest.mark.parametrize("gap", [0, 3, 40])
def test_islands(spark, gap):
    rows = _rows(3)
    expected = []
    for k, values in _by_key(rows).items():
        start = n = 0
        for i, x in enumerate(values):
            if i and x - values[i - 1] > gap:
                expected.append((k, start, values[i - 1], n))
                n = 0
            start, n = (x if n == 0 else start), n + 1
        expected.append((k, start, values[-1], n))
    df = spark.createDataFrame(rows, "k string, at long")
    assert sorted(map(tuple, sequences.islands(df, ["k"], "at", gap).collect()), key=str) == sorted(expected, key=str)
    assert sequences.islands(df.limit(0), ["k"], "at", gap).collect() == []


@pytest.mark.parametrize("slot", [7, 1000, sequences.SLOT])
def test_interval_union(spark, slot):
    rng = random.Random(5)
    rows = [(k, x, x + rng.choice([0, 1, 5, 900, -3])) for k, x in _rows(4, 250)]
    expected = set()
    for k in {r[0] for r in rows}:
        open_ = None
        for a, b in sorted((a, b) for key, a, b in rows if key == k and a < b):
            if open_ and a <= open_[1]:
                open_[1] = max(open_[1], b)
            else:
                if open_:
                    expected.add((k, *open_))
                open_ = [a, b]
        if open_:
            expected.add((k, *open_))
    df = spark.createDataFrame(rows, "k string, a long, b long")
    got = [tuple(r) for r in sequences.interval_union(df, ["k"], "a", "b", slot=slot).collect()]
    assert len(got) == len(expected) and set(got) == expected


@pytest.mark.parametrize("limit", [0, 10, 700])
def test_greedy_groups(spark, limit):
    rows = [*_rows(6), ("a", None)]
    expected = []
    for k, values in _by_key(rows).items():
        group = []
        for x in values:
            if group and x - group[0] > limit:
                expected.append((k, float(group[0]), float(group[-1]), len(group)))
                group = []
            group.append(x)
        expected.append((k, float(group[0]), float(group[-1]), len(group)))
    df = spark.createDataFrame(rows, "k string, at long").repartition(3)
    got = [tuple(r) for r in sequences.greedy_groups(df, ["k"], "at", limit).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sequences.greedy_groups(df.limit(0), ["k"], "at", limit).collect() == []


@pytest.mark.parametrize("slot", [9, 1000])
def test_clock_and_as_of(spark, slot):
    rows = [(i, k, x, (i * 7) % 5 + 1) for i, (k, x) in enumerate(_rows(7, 200))]
    df = spark.createDataFrame(rows, "id long, k string, at long, length long").withColumn("pause", F.lit(2).cast("long"))
    got = {r.id: (r.begin, r.end) for r in sequences.running_clock(df, ["k"], ["at", "id"], "length", "pause", slot=slot).collect()}
    clock, expected = {}, {}
    for i, k, _, length in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        begin = clock.get(k, 0)
        expected[i], clock[k] = (begin, begin + length), begin + length + 2
    assert got == expected
    marks = {(k, x): x * 10 for k, x in _rows(8, 30)}
    right = spark.createDataFrame([(k, x, v) for (k, x), v in marks.items()], "k string, at long, v long")
    asked = sequences.as_of(df.select("id", "k", "at"), right, ["k"], "at", "v", slot=slot).collect()
    assert len(asked) == len(rows)
    for r in asked:
        known = [x for k, x in marks if k == r.k and x <= r.at]
        assert r.v == (max(known) * 10 if known else None)


def test_a_key_that_is_not_known_stops_the_lookup(spark):
    known = spark.createDataFrame([("a", 1)], "k string, v int")
    assert sequences.looked_up(spark.createDataFrame([("a",)], "k string"), known, "k").collect()[0].v == 1
    for k in ("b", None):
        with pytest.raises(Exception, match="unknown k"):
            sequences.looked_up(spark.createDataFrame([(k,)], "k string"), known, "k").collect()


def test_audio_held_against_samples(spark):
    samples = spark.createDataFrame([("1", "a.wav", 5), ("2", "b.wav", None), ("3", "c.wav", 7), ("4", None, 9)], "id string, audioFile string, durationMs long")
    audio = spark.createDataFrame([("a.wav", 11, None), ("b.wav", None, "no samples"), ("a.wav", 11, None)], "audioFile string, durationMs long, error string")
    measured, issues = validation.audio_issues(samples, audio)
    assert {r.id: r.durationMs for r in measured.collect()} == {"1": 11, "2": None, "3": 7, "4": 9}
    assert {r.id: r.message.split(":")[0] for r in issues.collect()} == {"2": "audio can't be read", "3": "audio file is missing", "4": "audio file is missing"}


def test_clips_are_refused_by_size_and_kind(spark):
    good = b"RIFF\0\0\0\0WAVE" + bytes(32)
    rows = [(good,), (good[:43],), (b"x" * 44,), (b"",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(validation.clip_verdict(F.col("c"))).collect()]
    assert got[0] is None and got[1:4] == ["size is outside the accepted range", "not a WAV file", "size is outside the accepted range"]


def test_voice_ids(spark):
    rows = [("a:b:3",), ("m:0",), ("m:-1",), ("m:",), ("m",), ("m:99999999999",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(voices.parsed_id(F.col("v"))).collect()]
    assert [tuple(x) if x else None for x in got] == [("a:b", 3), ("m", 0), None, None, None, None, None]
    listed = spark.createDataFrame([("m", 1, 4, 9, True), ("m", 2, 6, 9, True), ("n", 1, 0, 1, False)], "model string, place int, speaker int, speakers int, any_speaker boolean")
    asked = spark.createDataFrame([("m", 6), ("m", 5), ("m", 9), ("n", 3), ("x", 0)], "model string, speaker int")
    chosen = {(r.model, r.speaker): (r.listed, r.error) for r in voices.selected(asked, listed).collect()}
    assert chosen["m", 6] == (6, None) and chosen["m", 5] == (4, None)
    assert chosen["m", 9] == (None, "voice m has no speaker 9") and chosen["n", 3][1] == "voice n has no speaker 3" and chosen["x", 0][1] == "unknown model x"


def test_printed_results(spark):
    printed = "loading\n   text: Bonjour à tous \nwrote -> /x/y.wav in 2 s, RTF 0.125\n"
    r = spark.createDataFrame([(printed,), ("nothing",)], "s string").select(voices.scraped(F.col("s")).alias("r")).select("r.*").collect()
    assert tuple(r[0]) == ("Bonjour à tous", "/x/y.wav", 0.125) and tuple(r[1]) == (None, None, None)


def test_spread_bootstrap_agrees_with_the_single_stream(spark):
    rng = random.Random(11)
    rows = [(m, "d", f"s{i}", 1, None, 7, f"r{m}", 0, rng.randrange(int(4 * k)), 0, 0, 10) for m, k in (("a", 1), ("b", 2)) for i in range(120)]
    runs = spark.createDataFrame(rows, "modelId string, decoding string, sampleId string, repetition int, error string, timestampMs long, runId string, ingestedAt long, substitutions long, deletions long, insertions long, referenceWords long")
    one, other = ({r.modelId: r for r in f(runs).collect()} for f in (lambda r: termstudy.bootstrap(r, 2000), termstudy.spread_bootstrap))
    for m in "ab":
        assert one[m].wer == pytest.approx(other[m].wer) and one[m].samples == other[m].samples and one[m].verdict == other[m].verdict
        assert other[m].low == pytest.approx(one[m].low, abs=0.01) and other[m].high == pytest.approx(one[m].high, abs=0.01)
    assert termstudy.spread_bootstrap(runs.limit(0)).collect() == []


def test_near_terms_meet_stretches_of_several_words(spark):
    texts = spark.createDataFrame([("une insufisance renale grave",), ("du potasium",), ("",), (None,)], "text string")
    terms = spark.createDataFrame([("insuffisance rénale",), ("potassium",), ("kg",), (None,)], "term string")
    assert {tuple(r) for r in termstudy.near_terms(texts, terms, 3).collect()} == {("insufisancerenale", "insuffisancerenale", 1), ("potasium", "potassium", 1)}


@pytest.mark.parametrize("preset", ["strict", "medium", "loose"])
def test_corrections_by_join_and_by_list_agree(spark, preset):
    terms = sorted({t for _, v, _ in goldens.CORRECTED for t in v} | {"pôtassium", "anti", "insuffisance", "8mg", "", "le"})
    texts = [t for t, _, _ in goldens.CORRECTED] + ["potassiums potassium pottassium", "l'anti-inflamatoire, l'insuffisance renalle", "traction fraction", "x" * 3000, "sans le vin"]
    df = spark.createDataFrame([(t, "clash") for t in [*texts, texts[0], None]], "text string, changes string")
    known = spark.createDataFrame([(t,) for t in [*terms, terms[3], None]], "term string")
    got = [{r.text: (r.corrected, [tuple(c) for c in r.changes]) for r in corrections.post_corrected(df, known, preset, most).collect()} for most in (1000, 0)]
    assert got[0] == got[1] and set(got[0]) == set(texts)
    for t in texts:
        corrected, changes = postcorrect.correct(t, terms, postcorrect.PRESETS[preset])
        assert got[0][t] == (corrected, [(c["from"], c["to"], c["distance"]) for c in changes])
    assert corrections.joined_corrections(df, known.limit(0)).filter("corrected != text or size(changes) > 0").count() == 0
    assert corrections.joined_corrections(df.limit(0), known).collect() == []


def test_stored_files_stay_in_their_folder(tmp_path):
    folder = tmp_path / "clips"
    folder.mkdir()
    (folder / "a.wav").write_bytes(b"x")
    (tmp_path / "b.wav").write_bytes(b"y")
    (folder / "link.wav").symlink_to(tmp_path / "b.wav")
    assert dataset.read_stored(str(folder), "a.wav") == b"x"
    for name in ("../b.wav", "link.wav", str(tmp_path / "b.wav"), "a.txt", "none.wav", ".."):
        with pytest.raises(dataset.Refused):
            dataset.read_stored(str(folder), name)


def test_jobs_of_a_tag_can_be_cancelled(spark):
    import threading
    import time

    seen = []

    def work():
        with session.cancellable(spark, "slow"):
            try:
                spark.range(10**12).select(F.sum(F.rand())).collect()
            except Exception as e:
                seen.append(str(e))

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(40):
        time.sleep(0.5)
        session.cancel(spark, "slow")
        if not thread.is_alive():
            break
    thread.join(5)
    assert len(seen) == 1 and not thread.is_alive()
