"""The rewriting of text in words: cases of plans.goldens, and what numbers must survive."""

import pytest

from sonoframe.plans.goldens import SPOKEN
from sonoframe.text import numbers, spoken


@pytest.mark.parametrize("language, written, said", SPOKEN)
def test_said(language, written, said):
    assert spoken.normalise(written, language) == said


@pytest.mark.parametrize("language", ["fr", "en"])
def test_numbers_in_words_are_read_again(language):
    """What one function says of a number, the other one reads."""
    for n in range(2, 100):
        assert numbers.fold_numbers(spoken.cardinal(n, language).replace("-", " ").split()) == [str(n)]


@pytest.mark.parametrize("year, said", [(1776, "seventeen seventy-six"), (1909, "nineteen oh nine"), (2007, "two thousand seven"), (2000, "two thousand"), (2014, "twenty fourteen"), (2042, "twenty forty-two")])
def test_years(year, said):
    assert spoken.year(year) == said


@pytest.mark.parametrize(
    "n, said",
    [(16, "seize"), (41, "quarante et un"), (72, "soixante-douze"), (93, "quatre-vingt-treize"), (380, "trois cent quatre-vingts"), (400, "quatre cents"), (500_000, "cinq cent mille"), (1_800_000, "un million huit cent mille")],
)
def test_french_numbers(n, said):
    assert spoken.cardinal(n, "fr") == said


def test_narrow_blanks_are_blanks():
    assert spoken.normalise("vers\u00a018\u202fh\u00a020", "fr") == "vers dix-huit heures vingt"
