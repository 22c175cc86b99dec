"""Tokens, mixing and spans: brute force, exact round trips, edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from sonoframe.llm import bpe, mixing, spans, tokens

TOKENIZER = tokens.TOKENIZER
ODD = ["", " ", "a", "  a  ", "don't 's ''s  's\t's I'LL it'll've 're' re''ll\n\n a", "\x1c a\x1f b​  c  \n", "<|endoftext|>", "½²Ⅷ १२ a1b2", "🙂🙂 é é", "aaaa" * 50, "\n" * 300, "x" * 5000]


def _reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_own(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 700)
    reference, rng = _reference(), random.Random(5)
    texts = ODD + ["".join(rng.choice("abcé  '\n1.,sStTmdreélv🙂") for _ in range(rng.randrange(900))) for _ in range(60)]
    ids, counts = bpe.encoder_for(open(TOKENIZER, "rb").read()).texts(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_encode_table(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])] + [(0, "", "y"), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode(df).collect()
    assert len(got) == len(rows)
    assert all(r.ids == [] for r in got if r.doc_id in (0, len(ODD)))
    assert tokens.encode(df.limit(0)).collect() == []


def test_ids_give_the_texts_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate([*ODD, None])}
    assert tokens.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].text is None


def _pairs(docs, least=spans.MIN_SPAN):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            where[t[i : i + least]].add(d)
    return {(a, b) for v in where.values() for a in v for b in v if a < b}


def _shared(docs, least=spans.MIN_SPAN):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            where[t[i : i + least]].add(d)
    out = {}
    for d, t in docs:
        marks = bytearray(len(t or ""))
        for i in range(len(marks) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                marks[i : i + least] = b"\1" * least
        out[d] = sum(marks)
    return out


@pytest.fixture
def passages():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefé 🙂\n") for _ in range(n))
    common = [text(n) for n in (119, 120, 121, 300, 500)]
    docs = [(i, text(rng.randrange(200)) + common[i % 5][: rng.choice([119, 120, 400])] + text(rng.randrange(200))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "short"), (103, ""), (104, None), (105, "z" * 400), (106, "z" * 130)]
    return docs


@pytest.mark.parametrize("block, hot, tile, rows", [(1_000_000, 64, 512, 500_000), (150, 2, 3, 300)])
def test_pairs_and_parts_equal_brute_force(spark, monkeypatch, passages, block, hot, tile, rows):
    # workers are forked from this process's modules only in part, so that the limits go through the functions' module
    monkeypatch.setattr(spans, "BLOCK_CHARS", block)
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "TILE", tile)
    monkeypatch.setattr(spans, "BUCKET_ROWS", rows)
    df = spark.createDataFrame([(d, t, 1) for d, t in [*passages, passages[0]]], "doc_id long, text string, a long")
    assert {tuple(r) for r in spans.pairs(df).collect()} == _pairs(passages)
    got = {r.doc_id: r for r in spans.shared_parts(df).collect()}
    assert {d: r.shared_chars for d, r in got.items()} == _shared(passages)
    assert got[104].shared_part == got[103].shared_part == 0 and got[100].shared_part == 1


def test_stages_in_process(monkeypatch, passages):
    monkeypatch.setattr(spans, "HOT", 2)
    h = np.repeat(np.array([5, 9, 11], dtype=np.uint64) << np.uint64(40), [40, 2, 1])
    doc, pos = np.r_[np.arange(40), [1, 2, 3]], np.arange(43)
    import pyarrow as pa

    rows = list(spans._pack(4, True, h, doc, pos))
    table = pa.Table.from_pylist(rows, schema=spans._packed_schema())
    a, _, b, c, hot = spans._unpack(table)
    assert sorted(zip(a.tolist(), b.tolist(), c.tolist())) == sorted(zip(h.tolist(), doc.tolist(), pos.tolist()))
    assert hot.sum() == 38 and len({d for d, x, y in zip(b, a, hot) if x == h[0] and not y}) == 2


def test_a_passage_in_many_documents(spark):
    rng = random.Random(8)
    common = "".join(rng.choice("abcdef ") for _ in range(150))
    docs = [(i, f"{i * 7919} {common} {i * 104729}") for i in range(1500)] + [(9000 + i, "lone " * 40 + str(i)) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert spans.pairs(df).count() == 1500 * 1499 // 2 + 3
    shared = spans.shared_parts(df).filter("doc_id < 1500")
    assert shared.filter("shared_chars between 150 and 170").count() == 1500


def test_spans_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans.pairs(empty).collect() == [] and spans.shared_parts(empty).collect() == []


def test_difference_cover_is_perfect():
    assert {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER} == set(range(spans.PERIOD))


def test_mix_meets_shares(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 60)), s) for i, s in enumerate(["a"] * 3000 + ["b"] * 400 + ["c"] * 90 + [None, "other"])]
    docs += [(9001, None, "a"), (9002, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets)
    report = {r.source: r for r in mixing.report(mixed, targets).collect()}
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3)):
        assert abs(report[s].actual_share - share / 0.95) < 0.01 and report[s].most_copies <= cap
    assert report["absent"].tokens == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"a", "b", "c"}
    assert mixing.mix(df.limit(0), targets).collect() == [] and mixing.mix(df, targets.limit(0)).collect() == []


def test_totals_beyond_what_sources_have(spark):
    live = lambda tokens: spark.createDataFrame([(s, 0.5, 1, n) for s, n in tokens.items()], "source string, share double, cap long, tokens long")
    wanted = lambda tokens, total=None: {r.source: r.wanted for r in mixing.planned(live(tokens), total).collect()}
    assert wanted({"a": 100, "b": 1000}) == {"a": 100.0, "b": 100.0}
    assert wanted({"a": 100, "b": 1000}, 600) == {"a": 100, "b": 500.0}
    assert wanted({"a": 100, "b": 1000}, 5000) == {"a": 100, "b": 1000.0}
    assert wanted({}) == {}


def test_multipliers_meet_their_targets():
    rng = np.random.default_rng(3)
    for sizes in (np.arange(1.0, 400), np.array([7.0]), rng.integers(1, 100_000, 50).astype(float)):
        documents = rng.integers(1, 50, len(sizes)).astype(float)
        most = (sizes * documents).sum()
        for cap in (1.0, 2.0, 7.0):
            for part in (1e-4, 0.1, 0.5, 0.9, 0.999):
                found = mixing.multiplier_for(sizes, documents, cap, part * cap * most)
                rate = np.minimum(np.exp(np.minimum(found * sizes * documents.sum() / most, 30)), cap)
                assert (rate * sizes * documents).sum() == pytest.approx(part * cap * most, rel=1e-6)
            assert mixing.multiplier_for(sizes, documents, cap, cap * most) == float("inf")
