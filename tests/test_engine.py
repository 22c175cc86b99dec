"""Sources, sinks, streaming, provider, comparison of copies, and the DuckDB twins of the registered queries."""

import glob
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sonoframe import schemas, sources, streaming
from sonoframe.audio import wav
from sonoframe.operators import draws, replica_diff, sequences, termstudy
from sonoframe.operators import aggregates as A
from sonoframe.plans import provider
from sonoframe.sources import dataset, sinks

RECORD = {
    "runId": "r", "timestampMs": 951782400000, "modelId": "m", "provider": "p", "decoding": "greedy", "sampleId": "s1", "speakerId": "x", "category": "c", "language": "fr", "domain": "d", "utteranceType": "u",
    "private": False, "repetition": 1, "coldStart": True, "loadMs": 100, "inferenceMs": 200, "audioMs": 1000, "rtf": 0.2, "threads": 4, "reference": "a b", "text": "a b", "wer": 0.0, "cer": 0.0, "substitutions": 0,
    "deletions": 0, "insertions": 0, "referenceWords": 2, "critical": [], "hasCritical": False,
}


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n\n".join(json.dumps(r) for r in rows), encoding="utf-8")


@pytest.fixture
def runs(spark, tmp_path):
    second = RECORD | {"sampleId": "s2", "wer": 0.5, "cer": 0.5, "substitutions": 1, "inferenceMs": 300, "coldStart": False, "text": "a c"}
    again, failed = second | {"repetition": 2, "text": "a d"}, RECORD | {"sampleId": "s3", "error": "out of memory", "wer": None, "text": ""}
    write(tmp_path / "runs.jsonl", RECORD, second, again, failed)
    return sources.runs(spark, str(tmp_path / "runs.jsonl"))


def test_old_records_get_defaults_and_are_summed_up(spark, runs, tmp_path):
    row = runs.filter("sampleId = 's1'").first()
    assert (row.scoringVersion, row.chunking, row.segments, row.biasing, row.rawText) == (1, "off", 1, "none", None)
    whole = {r.group: r for r in A.summarize(runs).collect()}["ALL"]
    assert (whole.samples, whole.runs, whole.failures, whole.unstable_samples) == (2, 4, 1, 1)
    assert (whole.wer_micro, whole.wer_macro, whole.inference_ms_median, whole.load_ms_cold_median) == (0.25, 0.25, 300, 100)
    sinks.write_run_folder(runs, str(tmp_path / "out"), {"cpu": "x"}, {"k": 1})
    lines = (tmp_path / "out/summary.csv").read_text().splitlines()
    assert lines[0].startswith("model,decoding,group,samples,runs,failures,wer_micro") and lines[1].startswith("m,greedy,ALL,2,4,1,0.2500,0.2500")
    assert sources.runs(spark, str(tmp_path / "out/runs.jsonl")).count() == 4
    assert "## Hard samples" in (tmp_path / "out/summary.md").read_text()


def test_dataset_files(spark, tmp_path):
    sample = {"id": "a", "language": "fr", "reference": "x", "keyTerms": [{"text": "t"}], "source": {"kind": "synthetic", "license": "l"}}
    write(tmp_path / "samples/a.json", sample)
    write(tmp_path / "samples-private/b.json", sample | {"id": "b"})
    rows = {r.id: r for r in sources.samples(spark, str(tmp_path)).collect()}
    assert rows["b"].private and not rows["a"].private and rows["a"].keyTerms[0].kind == "term" and rows["a"].category == ""
    (tmp_path / "scripts").mkdir()
    (tmp_path / "scripts/s.json").write_text(json.dumps([{"id": "1", "text": "x"}, {"id": "2", "text": "y"}]))
    assert sources.scripts(spark, str(tmp_path)).count() == 2
    assert sources.samples(spark, str(tmp_path / "nowhere")).collect() == []
    (tmp_path / "vocab.txt").write_text("﻿# c\n\n amoxicilline \nAmoxicilline\nKubernetes\n", encoding="utf-8")
    assert [r.text for r in sources.vocabulary(spark, str(tmp_path / "vocab.txt")).orderBy("line").collect()] == ["amoxicilline", "Kubernetes"]
    write(tmp_path / "clips/one__m1__vad.json", {"text": "x"})
    assert sources.clip_results(spark, str(tmp_path / "clips/*.json"), "text string").select("clip", "model", "mode").first() == ("one", "m1", "vad")


def test_audio_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.write(np.full(1600, 0.5), 16000))
    (tmp_path / "b.wav").write_bytes(b"ID3" + bytes(50))
    rows = {os.path.basename(r.path): r for r in sources.wav_files(spark, str(tmp_path / "*.wav")).collect()}
    assert rows["a.wav"].durationMs == 100 and rows["b.wav"].error.startswith("MP3") and rows["b.wav"].samples is None
    assert sources.clips(spark, str(tmp_path / "*.wav")).count() == 1
    named = sources.wav_files(spark, str(tmp_path / "a.wav")).withColumn("name", F.lit("copy"))
    sinks.write_wavs(named, str(tmp_path / "out"))
    assert (tmp_path / "out/copy.wav").read_bytes() == (tmp_path / "a.wav").read_bytes()


def test_import_and_delete(spark, tmp_path):
    sample = {
        "id": "fr-1", "language": "fr", "domain": "general", "utteranceType": "statement", "category": "c", "speaker": {"id": "s", "profile": "p"}, "reference": "  Un   texte\n",
        "keyTerms": [], "source": {"kind": "own-recording", "license": "l"}, "committable": False, "notes": "",
    }
    audio, root = wav.write(np.full(8000, 0.25), 8000), str(tmp_path)
    stored = dataset.import_sample(root, sample, audio, private=False)
    assert stored["durationMs"] == 1000 and stored["reference"] == "Un texte"
    for change, bad in (({"id": "Bad Id"}, audio), ({"reference": " "}, audio), ({"language": "xx"}, audio), ({}, audio), ({"id": "new"}, b"ID3" + bytes(60))):
        with pytest.raises(ValueError):
            dataset.import_sample(root, sample | change, bad, private=False)
    with pytest.raises(dataset.Refused):
        dataset.import_sample(root, sample | {"id": "x", "source": {"kind": "third-party-private", "license": "l"}}, audio, private=False)
    dataset.import_sample(root, sample, audio, private=True, replace=True)
    rows = sources.samples(spark, root).collect()
    assert [(r.id, r.private, r.reference) for r in rows] == [("fr-1", True, "Un texte")]
    assert dataset.delete_sample(root, "fr-1") and not dataset.delete_sample(root, "fr-1")
    assert dataset.private_voice_license(" Oui ").endswith("yes")
    with pytest.raises(dataset.Refused):
        dataset.private_voice_license("no")


def test_term_study(spark):
    base = [RECORD | {"sampleId": "s1", "reference": "le paracétamol aide bien", "text": "le paracetamol aide bien"}, RECORD | {"sampleId": "s2", "reference": "un deux trois", "text": "un deux trois"}]
    variant = [base[0] | {"text": "le paracétamol aide bien"}, base[1] | {"text": "un deux quatre"}]
    b, v = (spark.createDataFrame(rows, schemas.RUN) for rows in (base, variant))
    samples = spark.createDataFrame([("s1", [("paracétamol", "drug")])], "id string, keyTerms array<struct<text: string, kind: string>>")
    key, order = ["modelId", "decoding", "sampleId", "repetition"], ["timestampMs", "runId"]
    row = termstudy.word_deltas(A.pairs_of_runs(b, v, key, order), samples).first()
    assert (row.pairs, row.fixes, row.regressions, row.regressions_outside) == (2, 1, 1, 1)
    assert "| 0/1 |" in sinks.term_baseline_markdown(b, samples) and "| 1/1 |" in sinks.term_baseline_markdown(v, samples)
    text = sinks.term_comparison_markdown(b, v, samples, key, order)
    assert "Fixed: `s1` expected `paracétamol`, baseline `paracetamol`" in text and "(key term)" in text and "Broken: `s2`" in text
    scored = {r.sampleId: r for r in termstudy.rescored(b, samples).collect()}
    assert scored["s1"].substitutions == 1 and scored["s1"].hasCritical and scored["s2"].wer == 0.0


def test_streaming(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"in/{i}.json", RECORD | {"sampleId": f"s{i}", "substitutions": i})
    stream = streaming.running_rates(streaming.run_records(spark, str(tmp_path / "in"), 1))
    streaming.run_available(stream, "rates", str(tmp_path / "ck"))
    row = spark.table("rates").first()
    assert (row.runs, row.word_errors, row.words) == (3, 3, 6)


def _events(spark, path, *rows):
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(path / "events.parquet"))
    return str(path)


def test_streamed_windows_come_from_files(spark, tmp_path):
    at = _events(spark, tmp_path, (1, 1, "2024-01-01 00:01:00"), (2, 1, "2024-01-01 00:09:59"), (3, None, "2024-01-01 00:10:00"), (4, 1, "2023-01-01 00:00:00"), (5, 2, "2024-01-05 00:00:00"))
    got = __spark_entry__.queries()["str02_streamed_windows"](spark, at)
    assert got.inputFiles()  # a table in memory, which the driver holds as a whole, has none
    start = 1_704_067_200_000
    assert {tuple(r) for r in got.collect()} == {(start, 1, 2), (start + 600_000, None, 1), (start - 365 * 86_400_000, 1, 1), (start + 4 * 86_400_000, 2, 1)}


def test_streamed_sessions_come_from_files(spark, tmp_path):
    at = _events(spark, tmp_path, (1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:59:59"), (3, 1, "2024-01-01 02:00:00"), (4, None, "2024-01-01 00:00:00"), (5, 2, "2023-01-01 00:00:00"))
    got = __spark_entry__.queries()["str04_streamed_sessions"](spark, at)
    assert got.inputFiles()
    start, hour = 1_704_067_200_000, 3_600_000
    late = start + 2 * hour
    assert {tuple(r) for r in got.collect()} == {(1, start, late - 1000, 2), (1, late, late + hour, 1), (None, start, start + hour, 1), (2, start - 365 * 24 * hour, start - (365 * 24 - 1) * hour, 1)}


def test_provider(spark):
    registry = provider.Registry()
    with pytest.raises(KeyError):
        registry.maker("mock")
    registry.register("mock", provider.Mock)
    asked = spark.createDataFrame([("a", "x.wav", "m", "fr", 1000), ("b", "", "m", "fr", 1000), ("c", "x.wav", "m", "de", None)], "sample_id string, audio_path string, model_id string, language string, audio_ms long")
    rows = {r.sample_id: r for r in provider.transcribe(asked, registry.maker("mock")).collect()}
    assert rows["a"].is_mock and rows["a"].text.startswith("[MOCK]") and rows["b"].error == "audio path is empty" and rows["c"].error == "language not supported: de"


SIDE = "k string, n int, v double, t string, c array<struct<x: string, y: string>>, at long, field string"


def test_copies(spark):
    left = [("a", 1, 0.5, "x", [("p", None)], 1, "f"), ("b", 1, math.nan, None, [], 1, "f"), ("c", None, 1.0, "", None, 1, "f"), ("d", 1, 1.0, "x", [], 1, "f"), ("d", 1, 1.0, "x", [], 2, "f"), (None, 1, 1.0, "x", [], 1, "f"), ("only", 1, None, None, None, 1, None)]
    right = [("a", 1, 0.5 + 1e-12, "x", [(None, "p")], 9, "f"), ("b", 1, math.nan, "", [], 9, "f"), ("c", None, 1.0, "", [], 9, "f"), ("d", 1, 1.1, "x", [], 5, "f"), ("d", 1, 1.0, "x", [], 9, "f"), (None, 1, 1.0, "x", [], 9, "g"), ("new", 1, None, None, None, 9, None)]
    sides = [spark.createDataFrame(rows, SIDE) for rows in (left, right)]
    expected = {("a", 1, "c"), ("b", 1, "t"), ("c", None, "c"), (None, 1, "field"), ("only", 1, "only_in_left"), ("new", 1, "only_in_right")}
    run = lambda l, r, **kw: {tuple(x) for x in replica_diff.compare(l, r, ["k", "n"], ["at"], "at", **kw).collect()}
    # a column named like the result's own comes out under its name, too
    assert run(*(s.withColumnRenamed("field", "g") for s in sides)) == {(a, b, "g" if c == "field" else c) for a, b, c in expected}
    empty = sides[0].limit(0)
    assert run(empty, empty) == set() and len(run(empty, sides[1])) == 6 and len(run(sides[0], empty)) == 6


def test_copies_that_differ_everywhere(spark):
    make = lambda shift, n: spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") + shift).cast("double").alias("v"))
    for cells in (3, 64):  # too few cells to peel, and enough
        got = replica_diff.compare(make(0, 300), make(1, 290), ["k"], cells=cells, bucket_rows=100)
        assert {r["field"]: r["n"] for r in got.groupBy("field").agg(F.count("*").alias("n")).collect()} == {"v": 290, "only_in_left": 10}


def test_hashes_equal_sparks(spark):
    rows = [(0, -1, 2**62), (-(2**63), 5, 7)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long").select(F.xxhash64("a", "b", "c")).collect()]
    assert replica_diff.xxhash64_of_longs(*(np.array(x) for x in zip(*rows))).tolist() == got


def test_draws_are_pythons_own():
    rng, draws = random.Random(7), termstudy.Draws(7)
    for n, count in ((95, 950), (3, 10), (64, 200), (1, 5)):
        assert draws.picks(n, count).tolist() == [rng.choice(range(n)) for _ in range(count)]


def test_bootstrap(spark):
    rows = [RECORD | {"sampleId": f"s{i}", "modelId": m, "substitutions": k * (i % 3), "referenceWords": 10, "runId": "r"} for i in range(30) for m, k in (("good", 0), ("bad", 2))]
    runs = spark.createDataFrame([json.loads(json.dumps(r)) for r in rows], schemas.RUN).withColumn("ingestedAt", F.lit(0))
    got = {r.modelId: r for r in termstudy.bootstrap(runs, resamples=200).collect()}
    assert got["good"].verdict == "-" and got["bad"].verdict == "clearly worse" and got["bad"].low < got["bad"].wer < got["bad"].high
    rng, s = random.Random(7), sorted(f"s{i}" for i in range(30))
    rates = sorted(sum(2 * (int(x[1:]) % 3) for x in [rng.choice(s) for _ in s]) / 300 for _ in range(200))
    assert got["bad"].low == rates[round(0.025 * 199)] and got["bad"].high == rates[round(0.975 * 199)]


def test_pieces_of_draws_are_pythons_own(monkeypatch):
    monkeypatch.setattr(draws, "NEAR", 700)  # else so early places aren't jumped to
    sizes, rng = [95, 3, 64, 1, 777], random.Random(7)
    columns = [[np.arange(n) % 9, np.arange(n) * 3 % 50] for n in sizes]
    want = [[tuple(int(c[p].sum()) for c in own) for _ in range(100) for p in [[rng.choice(range(n)) for _ in range(n)]]] for n, own in zip(sizes, columns)]
    plan = draws.Plan(7, sizes, 100)
    plan.block = 5_000
    for g, first, last in plan.expected(3)[1:]:  # what wasn't counted is counted later
        plan.add(g, first, draws.counted(7, sizes[g], first, last, plan.block))
    got, pieces = [np.zeros((100, 2), dtype=int) for _ in sizes], plan.pieces(2)
    for p in pieces:
        first, found = draws.sums(7, p.start, p.end, p.first, columns[p.group], 100)
        got[p.group][first : first + found.shape[1]] += found.T
    assert len(pieces) > 10 and [[tuple(r) for r in g.tolist()] for g in got] == want


def test_bootstrap_by_language_of_many_records(spark):
    n = 2_000_001  # more was an error
    numbers = "id % 7 as substitutions, 0L as deletions, 0L as insertions, id % 11 as referenceWords, id % 5 = 0 as hasCritical"
    names = "'m' as modelId, 'd' as decoding, 'fr' as language, 'r' as runId, 0L as timestampMs, 1 as repetition, cast(null as string) as error"
    runs = spark.range(n).selectExpr(*names.split(", "), *numbers.split(", "), "lpad(id, 9, '0') as sampleId")
    row = termstudy.bootstrap_by_language(runs, resamples=5).first()
    e, w = np.arange(n) % 7, np.arange(n) % 11
    rates = sorted(float(e[p].sum() / w[p].sum()) for block in termstudy.Draws(7).resampled(n, 5) for p in block)
    assert tuple(row) == ("m", "d", "fr", n, float(e.sum() / w.sum()), rates[0], rates[4], 400_001)


def test_as_of_segments(spark):
    starts = spark.createDataFrame([(1, 0, 0), (1, 1250, 1), (1, 3100, 2)], "k int, ms long, segment int")
    asked = spark.createDataFrame([(1, t) for t in (500, 1100, 1250, 2800, 99_999, -5)], "k int, ms long")
    got = {r.ms: r.segment for r in sequences.as_of(asked, starts, ["k"], "ms", "segment").collect()}
    assert got == {500: 0, 1100: 0, 1250: 1, 2800: 1, 99_999: 2, -5: None}


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    df = __spark_entry__.queries()[name](spark, SF)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted([_plain(x) for x in row] for row in cursor.fetchall())
    assert sorted([_plain(r[c]) for c in columns] for r in df.collect()) == expected


def test_schemas_parse(spark):
    for schema in (schemas.RUN, schemas.SAMPLE, schemas.SCRIPT, schemas.MODEL, schemas.TTS_MEASURE):
        assert spark.createDataFrame([], schema).count() == 0
