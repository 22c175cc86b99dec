"""Writers: run folders with their summary, change logs, audio. Small reports are made on the driver, from bounded tables."""

from __future__ import annotations

import csv
import io
import json
import os

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.audio import wav
from sonoframe.operators import aggregates as A
from sonoframe.operators import ranks as R
from sonoframe.operators import termstudy
from sonoframe.sources import write_text

#: The summary's columns, the names they have in the file, and their decimals.
SUMMARY = {
    "modelId": ("model", None), "decoding": ("decoding", None), "group": ("group", None), "samples": ("samples", None), "runs": ("runs", None), "failures": ("failures", None),
    "wer_micro": ("wer_micro", 4), "wer_macro": ("wer_macro", 4), "cer_macro": ("cer_macro", 4), "runaway_outputs": ("runaway_outputs", None), "samples_with_critical": ("samples_with_critical", None),
    "critical_flags": ("critical_flags", None), "unstable_samples": ("unstable_samples", None), "rtf_median": ("rtf_median", 3), "inference_ms_median": ("inference_ms_median", 0),
    "inference_ms_p95": ("inference_ms_p95", 0), "load_ms_cold_median": ("load_ms_cold_median", 0), "peak_memory_mb_max": ("peak_memory_mb_max", 0), "avg_cores_median": ("avg_cores_median", 2),
}
MOST_REPORT_ROWS = 100_000


def _fixed(value, decimals: int | None) -> str:
    return "" if value is None else str(value) if decimals is None else f"{value:.{decimals}f}"


def bounded_rows(df: DataFrame, most: int = MOST_REPORT_ROWS) -> list:
    """The rows of a report's table; an error if there are more than a report may have."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return rows


def summary_csv(summary: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow([name for name, _ in SUMMARY.values()])
    for row in bounded_rows(summary.orderBy("modelId", "decoding", F.col("group") != "ALL", "group")):
        writer.writerow([_fixed(row[c], decimals) for c, (_, decimals) in SUMMARY.items()])
    return out.getvalue()


def markdown_table(header: list[str], rows: list[list]) -> str:
    cells = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([cells(header), "|" + "---|" * len(header), *map(cells, rows)]) + "\n"


def _percent(x: float | None) -> str:
    return "" if x is None else f"{x * 100:.1f} %"


def summary_markdown(runs: DataFrame, summary: DataFrame, flagged: int = 6) -> str:
    """Overall table, rates by category, hard samples, and the first flagged records of each configuration."""
    rows = bounded_rows(summary.orderBy("modelId", "decoding", "group"))
    label = lambda r: f"{r['modelId']} ({r['decoding']})"
    whole = [r for r in rows if r["group"] == "ALL"]
    parts = ["## Overall\n", markdown_table(["configuration", "samples", "failures", "WER", "CER", "critical samples", "RTF"], [[label(r), r["samples"], r["failures"], _percent(r["wer_micro"]), _percent(r["cer_macro"]), r["samples_with_critical"], _fixed(r["rtf_median"], 3)] for r in whole])]
    groups = sorted({r["group"] or "" for r in rows} - {"ALL"})
    by = {(label(r), r["group"] or ""): r["wer_micro"] for r in rows}
    parts += ["## WER by category\n", markdown_table(["configuration", *groups], [[label(r), *(_percent(by.get((label(r), g))) for g in groups)] for r in whole])]
    hard = bounded_rows(A.hard_samples(runs).orderBy(F.desc("wer_median"), "sampleId").limit(50))
    parts += ["## Hard samples\n", markdown_table(["sample", "median WER", "best"], [[r["sampleId"], _percent(r["wer_median"]), _percent(r["best_wer"])] for r in hard])]
    nth = F.row_number().over(Window.partitionBy(*A.CONFIG).orderBy("timestampMs", "runId", "sampleId", "repetition"))
    first = runs.filter(F.size("critical") > 0).withColumn("nth", nth).filter(F.col("nth") <= flagged).orderBy(*A.CONFIG, "nth")
    parts += ["## Flags\n"] + [f"- {label(r)} {r['sampleId']}: {f['message']} ({f['expected']} -> {f['found']})\n" for r in bounded_rows(first) for f in r["critical"]]
    return "\n".join(parts)


def write_run_folder(runs: DataFrame, folder: str, system: dict, config: dict) -> DataFrame:
    """runs.jsonl (a folder of parts), summary.csv, summary.md, system.json and config.json; returns the summary."""
    os.makedirs(folder, exist_ok=True)
    runs.write.mode("errorifexists").json(os.path.join(folder, "runs.jsonl"))
    summary = A.summarize(runs)
    texts = {"summary.csv": summary_csv(summary), "summary.md": summary_markdown(runs, summary), "system.json": json.dumps(system, indent=2), "config.json": json.dumps(config, indent=2)}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return summary


def measure_summary(measures: DataFrame) -> DataFrame:
    """(voice, sentence, n, generation, audio, rtf, load_max, peak_max) of measurements: medians of the warm rows of each voice
    and sentence, and the largest load time and memory of each voice."""
    key, warm = ["voice", "sentence"], measures.filter("not cold")
    of = {"generation": F.col("generationMs"), "audio": F.col("audioMs"), "rtf": A.number("rtf")}
    ranked = R.order_statistics(R.measures_in_rows(warm, key, of), [*key, "measure"], "value", {"median": R.mid_median()})
    most = measures.groupBy("voice").agg(F.max("loadMs").alias("load_max"), F.max("peakMemoryMb").alias("peak_max"))
    counted = warm.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(R.measures_in_columns(ranked, key, {m: (m, "median") for m in of}), key, "left").join(most, "voice")


def mode_overhead(measures: DataFrame, whole: str, pieces: str) -> DataFrame:
    """(voice, sentence, whole, pieces, overhead_percent): medians of warm generation times in two modes, where both are known."""
    key = ["voice", "sentence"]
    medians = R.order_statistics(measures.filter("not cold").filter(F.col("mode").isin(whole, pieces)), [*key, "mode"], "generationMs", {"median": R.mid_median()})
    wide = medians.groupBy(*key).pivot("mode", [whole, pieces]).agg(F.max("median")).toDF(*key, "whole", "pieces")
    return wide.filter("whole > 0 and pieces is not null").withColumn("overhead_percent", (F.col("pieces") - F.col("whole")) * 100 / F.col("whole"))


def write_measures(measures: DataFrame, folder: str, whole: str = "whole", pieces: str = "pieces") -> None:
    """tts-measure.jsonl (a folder of parts), and summary and overhead as folders of CSV and, for reading, one text each."""
    measures.write.mode("errorifexists").json(os.path.join(folder, "tts-measure.jsonl"))
    tables = {"summary": measure_summary(measures), "overhead": mode_overhead(measures, whole, pieces)}
    for name, df in tables.items():
        df.write.mode("errorifexists").option("header", True).csv(os.path.join(folder, f"{name}.csv"))
        rows = bounded_rows(df.orderBy("voice", "sentence"))
        text = markdown_table(df.columns, [[f"{x:.3f}" if isinstance(x, float) else x for x in r] for r in rows])
        write_text(measures.sparkSession, os.path.join(folder, f"{name}.md"), text)


def write_rescored(runs: DataFrame, folder: str, version: int) -> str:
    """Rescored records beside the old ones, which are never overwritten while they are read."""
    path = os.path.join(folder, f"runs.scoring-v{version}.jsonl")
    runs.withColumn("scoringVersion", F.lit(version)).write.mode("errorifexists").json(path)
    return path


def change_log(corrected: DataFrame, path: str) -> None:
    """One line a change of (model, decoding, sample, corrected.changes)."""
    flat = corrected.select("model", "decoding", "sample", F.explode("changes").alias("c")).select("model", "decoding", "sample", "c.from", "c.to", "c.distance")
    flat.write.mode("errorifexists").json(path)


def without_texts(df: DataFrame) -> DataFrame:
    """What may be shown of results without anyone's words."""
    return df.drop("text", "rawText", "reference", "critical")


def write_wavs(audio: DataFrame, folder: str, scaling: str = "round") -> None:
    """A 16-bit file for each (name, samples, sampleRate), written where the rows are."""

    def run(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, os.path.basename(r["name"]) + ".wav"), "wb") as f:
                f.write(wav.write(np.array(r["samples"], dtype=np.float32), r["sampleRate"], scaling))

    audio.select("name", "samples", "sampleRate").foreachPartition(run)


def term_baseline_markdown(runs: DataFrame, samples: DataFrame) -> str:
    """A row a configuration: samples, rate, key terms found of each kind, samples with a critical flag."""
    ok = runs.filter(A.succeeded())
    by = ok.groupBy(*A.CONFIG).agg(F.count(F.lit(1)).alias("samples"), F.sum(A.word_errors()).alias("e"), F.sum("referenceWords").alias("w"), F.count_if("hasCritical").alias("critical"))
    kinds: dict[tuple, dict] = {}
    for r in bounded_rows(termstudy.key_term_summary(runs, samples)):
        kinds.setdefault((r["modelId"], r["decoding"]), {})[r["kind"]] = f"{r['occurrences'] - r['missed']}/{r['occurrences']}"
    names = sorted({k for found in kinds.values() for k in found})
    rows = [
        [f"{r['modelId']} ({r['decoding']})", r["samples"], _percent(r["e"] / r["w"] if r["w"] else 0.0), *(kinds.get((r["modelId"], r["decoding"]), {}).get(k, "0/0") for k in names), r["critical"]]
        for r in bounded_rows(by.orderBy(*A.CONFIG))
    ]
    return markdown_table(["configuration", "samples", "WER", *(f"{k} found" for k in names), "samples with a critical flag"], rows)


def term_comparison_markdown(base: DataFrame, variant: DataFrame, samples: DataFrame, key: list[str], order: list[str], examples: int = 25) -> str:
    """Words fixed and broken by a variant, and the first examples of each configuration and kind."""
    pairs = A.pairs_of_runs(base, variant, key, order)
    rows = [
        [f"{r['modelId']} ({r['decoding']})", r["pairs"], r["fixes"], r["regressions"], r["regressions_outside"], f"{r['insertions_delta']:+d}"]
        for r in bounded_rows(termstudy.word_deltas(pairs, samples).orderBy(*A.CONFIG))
    ]
    out = [markdown_table(["configuration", "pairs", "fixed words", "broken words (all)", "broken words outside key terms", "extra words"], rows)]
    last = None
    for c in bounded_rows(termstudy.first_examples(termstudy.word_changes(pairs, samples), examples).orderBy(*A.CONFIG, F.desc("fixed"), "nth")):
        label = f"{c['modelId']} ({c['decoding']})"
        if label != last:
            out.append(f"\n#### {label}\n")
            last = label
        term = " (key term)" if c["in_key_term"] else ""
        out.append(f"- {'Fixed' if c['fixed'] else 'Broken'}: `{c['sampleId']}` expected `{c['reference_word']}`, baseline `{c['baseline']}`, variant `{c['variant']}`{term}\n")
    return "".join(out)
