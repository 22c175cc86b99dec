"""The pure text functions: cases written for them, and slow versions that they are held against."""

import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sonoframe.plans import texts
from sonoframe.plans.goldens import CORRECTED, FOLDED, SENTENCES
from sonoframe.text import critical, numbers, postcorrect, scoring, sentences


@pytest.mark.parametrize("said, folded", FOLDED)
def test_numbers_fold(said, folded):
    assert " ".join(numbers.fold_numbers(said.split())) == folded


#: What the grammar makes of some numbers on purpose, so that records stay comparable.
KEPT_AS_THEY_ARE = [("six thousand", "61000"), ("six hundred", "6100"), ("mille cent", "1000100"), ("zéro cinq", "5"), ("zero five", "05"), ("1,000", "1.000")]


@pytest.mark.parametrize("said, folded", KEPT_AS_THEY_ARE)
def test_numbers_kept_as_they_are(said, folded):
    assert " ".join(numbers.fold_numbers(said.split())) == folded


def test_every_unit_has_one_spelling():
    for spelling, unit in numbers.UNIT_OF.items():
        assert numbers.unify_units(["7", spelling]) == ["7", unit] and numbers.canonical_unit(unit) == unit
    assert numbers.canonical_unit("chaise") is None


#: Two ways to write the same, as far as scoring goes.
SAME = [
    ("Tiens-toi", "tiens toi"), ("l’arbre , là !", "l'arbre là"), ("7,25 ml", "7.25 ml"), ("30 %", "30% "), ("trente pour cent", "30 %"), ("250mg", "deux cent cinquante milligrammes"),
    ("vers 18h20", "vers dix huit heures vingt"), ("8 heures", "8h"), ("Trois cents grammes", "300 g"),
]
#: Reference, text, and words substituted, deleted and inserted.
DIFFERENT = [
    ("un bon vin rouge", "un bon pain rouge", (1, 0, 0)), ("un bon vin rouge", "un vin", (0, 2, 0)), ("le vin", "le très bon vin", (0, 0, 2)), ("40 mg", "4 mg", (1, 0, 0)), ("7,4 ml", "74 ml", (1, 0, 0)),
    ("6 kg", "6 g", (1, 0, 0)), ("elle ne fume pas", "elle fume", (0, 2, 0)), ("", "tout est ajouté", (0, 0, 3)),
]


@pytest.mark.parametrize("a, b", SAME)
def test_the_same_for_scoring(a, b):
    compared = scoring.compare_texts(a, b)
    assert compared["wer"] == 0.0 and compared["normalized_reference"] == compared["normalized_hypothesis"]


@pytest.mark.parametrize("a, b, counts", DIFFERENT)
def test_counts_of_differences(a, b, counts):
    c = scoring.compare_texts(a, b)
    assert (c["substitutions"], c["deletions"], c["insertions"]) == counts
    assert (c["wer"] is None) == (c["cer"] is None) == (a == "")


def test_raised_digits_stay_apart_and_quotes_go():
    assert scoring.normalize_words("'sol' de 9 m³, l'air") == ["sol", "de", "9", "m", "³", "l'air"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_alignment_is_shortest_and_rebuilds_both(a, b):
    steps = scoring.align(a, b)
    assert sum(s.kind != "equal" for s in steps) == scoring.levenshtein(a, b) == _distance(a, b)
    assert [s.reference for s in steps if s.reference is not None] == a
    assert [s.hypothesis for s in steps if s.hypothesis is not None] == b


def test_both_tables_of_costs_agree():
    words = ["ab"[i % 2] + str(i * 7 % 11) for i in range(80)]
    other = [w for i, w in enumerate(words) if i % 5] + ["x"] * 9
    assert [list(map(int, row)) for row in scoring._costs(words, other)] == [[_distance(words[:i], other[:j]) for j in range(len(other) + 1)] for i in range(len(words) + 1)]


#: Reference, text, key terms, and the flags' kinds, severities and what was found.
FLAGS = [
    ('6 kg', '6 g', [], [('unit', 'critical', 'g')]),
    ('7,4 ml', '7.4 ml', [], []),
    ('Verser 250 mg deux fois par jour.', 'verser deux cent cinquante milligrammes 2 fois par jour', [], []),
    ('baisse de 30 %', 'baisse de trente pour cent', [], []),
    ('du potassium', 'du potassium', [('potassium', 'drug')], []),
    ('du potassium', 'du potasium', [('potassium', 'drug')], [('keyTerm', 'critical', 'potasium')]),
    ('elle ne fume jamais', 'elle fume', [], [('negation', 'critical', '0')]),
    ('il reçoit 40 mg', 'il reçoit 4 mg', [], [('number', 'critical', '4')]),
    ('la clause pénale', 'le bulletin météo', [('clause pénale', 'legal')], [('keyTerm', 'warning', '(absent)')]),
    ('lance Kubernetes', 'lance cube ernetes', [('Kubernetes', 'tech')], [('keyTerm', 'warning', 'cube ernetes')]),
    ('lundi à midi', 'jeudi à midi', [], [('date', 'critical', 'jeudi')]),
    ('the door is open', 'the door is not open', [], [('negation', 'critical', '1')]),
    ("we don't go", 'we do not go', [], []),
]


@pytest.mark.parametrize("reference, heard, terms, flags", FLAGS)
def test_critical_flags(reference, heard, terms, flags):
    got = critical.analyze(reference, heard, terms)
    assert [(f["kind"], f["severity"], f["found"]) for f in got] == flags
    assert critical.analyze(heard, heard, terms) == [] or terms
    for kind, text, found in critical.term_outcomes(terms, got):
        assert found == (text not in {f["expected"] for f in got if f["kind"] == "keyTerm"})


@pytest.mark.parametrize("text, vocabulary, corrected", CORRECTED)
def test_post_correction(text, vocabulary, corrected):
    got, changes = postcorrect.correct(text, vocabulary)
    assert got == corrected and (text != got) == bool(changes)
    assert postcorrect.correct(got, vocabulary)[0] == got


def test_presets_differ_in_what_they_allow():
    strict, medium, loose = (postcorrect.PRESETS[n] for n in ("strict", "medium", "loose"))
    for length, allowed in ((5, (0, 1, 1)), (11, (1, 2, 3)), (12, (2, 2, 3)), (30, (2, 2, 3))):
        assert (strict.allowed(length), medium.allowed(length), loose.allowed(length)) == allowed

    assert postcorrect.correct("la traction est bonne", ["fraction"], strict)[0] == "la traction est bonne"
    assert postcorrect.correct("la traction est bonne", ["fraction"], loose)[0] == "la fraction est bonne"


def test_vocabulary_text():
    assert postcorrect.parse_vocabulary("\ufeff# mots\n\n potassium \nPotassium\nlaser\n") == ["potassium", "laser"]


@pytest.mark.parametrize("pieces", SENTENCES)
def test_sentences(pieces):
    assert [s.text for s in sentences.split_sentences(" ".join(pieces))] == pieces


def test_sentences_of_pairs_are_both():
    """Two texts on lines of their own have the sentences of both, and paragraphs end where a line is empty."""
    for a, b in itertools.islice(itertools.permutations(SENTENCES, 2), 0, None, 7):
        got = sentences.split_sentences(" ".join(a) + "\n\n" + " ".join(b))
        assert [s.text for s in got] == a + b
        assert [i for i, s in enumerate(got) if s.paragraph_end] == [len(a) - 1, len(a) + len(b) - 1]


def test_places_count_utf16_units():
    text = " Âne gris. 🎈 Ah, non ?\n\nBout"
    units = text.encode("utf-16-le")
    got = sentences.split_sentences(text)
    assert [units[2 * s.start : 2 * s.end].decode("utf-16-le") for s in got] == [s.text for s in got] == ["Âne gris.", "🎈 Ah, non ?", "Bout"]
    assert sentences.split_sentences(" \n\n ") == sentences.split_sentences("") == []
    assert [s.text for s in sentences.split_sentences("1. Laver\n2. Sécher\n- \n Ranger.")] == ["1. Laver", "2. Sécher", "Ranger."]


def test_whole_texts_are_compared(spark, tmp_path):
    pairs = [("été à l'hôpital", "ete a l hopital"), ("3,5 mg à 20 %", "35 mg à 20"), ("straße ≥ 4", "strasse 4"), ("abc", "abd"), ("𝒳y", "xy"), ("", "é"), ("", ""), (None, "a"), ("a", None), ("", None)]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    spark.createDataFrame(rows + rows[:2], "comparison_id long, normalized_reference string, normalized_hypothesis string").write.parquet(str(tmp_path / "text_comparisons.parquet"))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    known = {i: None if a is None or b is None else plain(a, b) for i, a, b in rows}
    rates = texts.txt10_13_character_rate(spark, str(tmp_path)).collect()
    assert len(rates) == len(rows) and {r.comparison_id: r.distance for r in rates} == known
    assert {r.comparison_id: r.cer for r in rates} == {i: round(known[i] / len(a), 9) if a and b is not None else None for i, a, b in rows}
    alike = texts.txt24_similarity(spark, str(tmp_path)).collect()
    assert len(alike) == len(rows) and {r.comparison_id: r.similarity for r in alike} == {i: None if known[i] is None else round(1 - known[i] / max(len(a), len(b), 1), 9) for i, a, b in rows}


def test_whole_texts_are_split_into_words(spark, tmp_path, monkeypatch):
    said = ["L’été, 3,5mg à 20%.", "m² et 1.000 m2", "N'est-ce pas ? 12h30", "½ pour 4½", "", "…", "'a' 'b", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(said)], "result_id long, text string").write.parquet(str(tmp_path / "transcribe_results.parquet"))
    got = {r.result_id: (r.words, r.n) for r in texts.txt01_native_words(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(scoring, "unify_units", lambda words: words)
    monkeypatch.setattr(scoring, "fold_numbers", lambda words: words)
    words = {i: scoring.normalize_words(t) for i, t in enumerate(said) if t is not None}
    assert got == {i: (" ".join(w), len(w)) for i, w in words.items()}
