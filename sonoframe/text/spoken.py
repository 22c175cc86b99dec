"""Written text as it is said: numbers, units, amounts, dates, times, telephone numbers and abbreviations in words.

French and English; other languages stay as they are. A text is walked once: a pattern finds the next place where
something may have to be said otherwise, and the rules for what begins there are tried in their order. Each rule is a
pattern and what its groups mean.
"""

from __future__ import annotations

import regex

# ------------------------------------------------------------------ fixed values

FR_SMALL = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
FR_TENS = {20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante", 80: "quatre-vingt"}
EN_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = dict(zip(range(20, 100, 10), "twenty thirty forty fifty sixty seventy eighty ninety".split()))
MONTHS = {
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "en": "January February March April May June July August September October November December".split(),
}
EN_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
#: Nouns that make a French one feminine.
FEMININE = frozenset(
    "fois heure heures minute minutes seconde secondes semaine semaines année années journée journées gélule gélules ampoule ampoules dose doses personne personnes "
    "facture factures page pages ligne lignes pièce pièces ordonnance ordonnances consultation consultations goutte gouttes injection injections cuillère cuillères "
    "prise prises boîte boîtes unité unités carte cartes tablette tablettes chambre chambres fois-ci nuit nuits dent dents pilule pilules capsule capsules".split()
)
#: Symbols; French name and plural; English name and plural.
UNITS = [
    (("mg",), ("milligramme", "milligrammes"), ("milligram", "milligrams")),
    (("g",), ("gramme", "grammes"), ("gram", "grams")),
    (("kg",), ("kilogramme", "kilogrammes"), ("kilogram", "kilograms")),
    (("µg", "μg", "mcg"), ("microgramme", "microgrammes"), ("microgram", "micrograms")),
    (("ml", "mL"), ("millilitre", "millilitres"), ("milliliter", "milliliters")),
    (("l", "L"), ("litre", "litres"), ("liter", "liters")),
    (("cl",), ("centilitre", "centilitres"), ("centiliter", "centiliters")),
    (("dl",), ("décilitre", "décilitres"), ("deciliter", "deciliters")),
    (("mm",), ("millimètre", "millimètres"), ("millimeter", "millimeters")),
    (("cm",), ("centimètre", "centimètres"), ("centimeter", "centimeters")),
    (("m",), ("mètre", "mètres"), ("meter", "meters")),
    (("km",), ("kilomètre", "kilomètres"), ("kilometer", "kilometers")),
    (("ms",), ("milliseconde", "millisecondes"), ("millisecond", "milliseconds")),
    (("s",), ("seconde", "secondes"), ("second", "seconds")),
    (("min",), ("minute", "minutes"), ("minute", "minutes")),
    (("h",), ("heure", "heures"), ("hour", "hours")),
    (("j",), ("jour", "jours"), ("day", "days")),
    (("UI", "IU"), ("unité internationale", "unités internationales"), ("international unit", "international units")),
    (("mmHg",), ("millimètre de mercure", "millimètres de mercure"), ("millimeter of mercury", "millimeters of mercury")),
    (("bpm",), ("battement par minute", "battements par minute"), ("beat per minute", "beats per minute")),
    (("kcal",), ("kilocalorie", "kilocalories"), ("kilocalorie", "kilocalories")),
    (("mmol",), ("millimole", "millimoles"), ("millimole", "millimoles")),
    (("mol",), ("mole", "moles"), ("mole", "moles")),
    (("Hz",), ("hertz", "hertz"), ("hertz", "hertz")),
    (("kHz",), ("kilohertz", "kilohertz"), ("kilohertz", "kilohertz")),
    (("MHz",), ("mégahertz", "mégahertz"), ("megahertz", "megahertz")),
    (("GHz",), ("gigahertz", "gigahertz"), ("gigahertz", "gigahertz")),
    (("Ko", "KB", "kB"), ("kilooctet", "kilooctets"), ("kilobyte", "kilobytes")),
    (("Mo", "MB"), ("mégaoctet", "mégaoctets"), ("megabyte", "megabytes")),
    (("Go", "GB"), ("gigaoctet", "gigaoctets"), ("gigabyte", "gigabytes")),
    (("To", "TB"), ("téraoctet", "téraoctets"), ("terabyte", "terabytes")),
    (("cp",), ("comprimé", "comprimés"), ("tablet", "tablets")),
    (("lb", "lbs"), ("livre", "livres"), ("pound", "pounds")),
    (("oz",), ("once", "onces"), ("ounce", "ounces")),
]
#: What may follow a stroke; French, English.
PER = {"jour": ("jour", "day"), "semaine": ("semaine", "week"), "mois": ("mois", "month"), "heure": ("heure", "hour")}
PER |= {"day": PER["jour"], "week": PER["semaine"], "month": PER["mois"], "hour": PER["heure"]}
#: Symbols; French name, plural, cent, cents; English name, plural, cent, cents.
CURRENCIES = [
    (("€", "EUR"), ("euro", "euros", "centime", "centimes"), ("euro", "euros", "cent", "cents")),
    (("$", "USD"), ("dollar", "dollars", "cent", "cents"), ("dollar", "dollars", "cent", "cents")),
    (("£", "GBP"), ("livre sterling", "livres sterling", "penny", "pennys"), ("pound", "pounds", "penny", "pence")),
    (("CHF",), ("franc", "francs", "centime", "centimes"), ("Swiss franc", "Swiss francs", "centime", "centimes")),
]
CURRENCY_WORDS = frozenset("euro euros franc francs dollar dollars livre livres".split())
#: Written form; French; English; what has to follow (a name, a digit).
ABBREVIATIONS = [
    ("av. J.-C.", "avant Jésus-Christ", None, None),
    ("c.-à-d.", "c'est-à-dire", None, None),
    ("e.g.", None, "for example", None),
    ("i.e.", None, "that is", None),
    ("M.", "monsieur", None, None),
    ("MM.", "messieurs", None, None),
    ("Mme", "madame", None, None),
    ("Mmes", "mesdames", None, None),
    ("Mlle", "mademoiselle", None, None),
    ("Mlles", "mesdemoiselles", None, None),
    ("Dr.", "docteur", "doctor", None),
    ("Dr", "docteur", "doctor", "name"),
    ("Pr.", "professeur", "professor", None),
    ("Pr", "professeur", None, "name"),
    ("Prof.", "professeur", "professor", None),
    ("Prof", "professeur", "professor", "name"),
    ("St.", "saint", "saint", None),
    ("St", "saint", "saint", "name"),
    ("Ste.", "sainte", None, None),
    ("Ste", "sainte", None, "name"),
    ("Mr.", None, "mister", None),
    ("Mr", None, "mister", "name"),
    ("Mrs.", None, "missus", None),
    ("Mrs", None, "missus", "name"),
    ("Ms.", None, "miss", None),
    ("Ms", None, "miss", "name"),
    ("Jr.", None, "junior", None),
    ("Sr.", None, "senior", None),
    ("etc.", "et cetera", "et cetera", None),
    ("env.", "environ", None, None),
    ("approx.", "environ", "approximately", None),
    ("vs.", "versus", "versus", None),
    ("vs", "versus", "versus", None),
    ("cf.", "voir", "see", None),
    ("p.", "page", "page", "digit"),
    ("pp.", "pages", "pages", "digit"),
    ("tél.", "téléphone", None, None),
    ("tel.", "téléphone", "telephone", None),
    ("av.", "avenue", "avenue", "name"),
    ("bd", "boulevard", None, "name"),
    ("rdv", "rendez-vous", "appointment", None),
    ("n°", "numéro", "number", None),
    ("nº", "numéro", "number", None),
    ("no.", None, "number", "digit"),
    ("a.m.", None, "a m", None),
    ("p.m.", None, "p m", None),
    ("janv.", "janvier", None, None),
    ("févr.", "février", None, None),
    ("avr.", "avril", None, None),
    ("juil.", "juillet", None, None),
    ("sept.", "septembre", "September", None),
    ("oct.", "octobre", "October", None),
    ("nov.", "novembre", "November", None),
    ("déc.", "décembre", None, None),
    ("Jan.", None, "January", None),
    ("Feb.", None, "February", None),
    ("Mar.", None, "March", None),
    ("Apr.", None, "April", None),
    ("Jun.", None, "June", None),
    ("Jul.", None, "July", None),
    ("Aug.", None, "August", None),
    ("Sep.", None, "September", None),
    ("Dec.", None, "December", None),
]
#: Words after which day/month is a date, and those after which hour.minutes is a time.
DATE_LEADS = frozenset("le du au dès depuis jusqu'au avant après ce".split())
TIME_LEADS = {
    "fr": frozenset("à vers dès de entre et jusqu'à jusqu’à avant après depuis".split()),
    "en": frozenset("at by from to until till before after around since between and".split()),
}
FRACTIONS = {
    "fr": {"1/2": "un demi", "1/3": "un tiers", "2/3": "deux tiers", "1/4": "un quart", "3/4": "trois quarts"},
    "en": {"1/2": "one half", "1/3": "one third", "2/3": "two thirds", "1/4": "one quarter", "3/4": "three quarters"},
}
#: French endings of ordinals: the numbers they fit, feminine, plural.
FR_ENDINGS = {
    "er": (1, None, False, False), "re": (1, 1, True, False), "ère": (1, 1, True, False), "e": (2, None, False, False), "ème": (2, None, False, False), "eme": (2, None, False, False),
    "nd": (2, 2, False, False), "nde": (2, 2, True, False), "es": (2, None, False, True), "èmes": (2, None, False, True),
}
WORDS = {
    "fr": {"%": "pour cent", "degree": ("degré", "degrés"), "times": "fois", "to": "à", "per": "par", "minus": "moins", "plus": "plus", "and": "et", "point": "virgule", "over": "sur"},
    "en": {"%": "percent", "degree": ("degree", "degrees"), "times": "times", "to": "to", "per": "per", "minus": "minus", "plus": "plus", "and": "and", "point": "point", "over": "over"},
}

# ------------------------------------------------------------------ numbers in words


def _french(n: int, final: bool) -> str:
    """Below a million million; ``final``: nothing follows, so that vingt and cent may have their s."""
    for size, name in ((10**9, "milliard"), (10**6, "million")):
        if n >= size:
            head = f"{_french(n // size, True)} {name}{'s' * (n >= 2 * size)}"
            return head if n % size == 0 else f"{head} {_french(n % size, final)}"
    if n >= 1000:
        head = "mille" if n < 2000 else f"{_french(n // 1000, False)} mille"
        return head if n % 1000 == 0 else f"{head} {_french(n % 1000, final)}"
    if n >= 100:
        head = "cent" if n < 200 else f"{FR_SMALL[n // 100]} cent"
        return head + "s" * (final and n >= 200) if n % 100 == 0 else f"{head} {_french(n % 100, final)}"
    if n < 20:
        return FR_SMALL[n]
    tens = n // 20 * 20 if n >= 60 else n // 10 * 10
    rest = n - tens
    if rest == 0:
        return FR_TENS[tens] + "s" * (final and tens == 80)
    return FR_TENS[tens] + (" et " if rest in (1, 11) and tens < 80 else "-") + FR_SMALL[rest]


def _english(n: int) -> str:
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{_english(n // size)} {name}" + (f" {_english(n % size)}" if n % size else "")
    return EN_SMALL[n] if n < 20 else EN_TENS[n // 10 * 10] + (f"-{EN_SMALL[n % 10]}" if n % 10 else "")


def cardinal(n: int, lang: str) -> str:
    return _french(n, True) if lang == "fr" else _english(n)


def ordinal(n: int, lang: str, feminine: bool = False) -> str:
    if lang == "fr" and n == 1:
        return "première" if feminine else "premier"
    name = _french(n, False) if lang == "fr" else _english(n)
    head, last = regex.fullmatch(r"(.*[ -])?([^ -]+)", name).groups(default="")
    if lang == "fr":
        return head + {"cinq": "cinqu", "neuf": "neuv"}.get(last, last.removesuffix("e")) + "ième"
    return head + (EN_ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def year(n: int) -> str:
    """An English year."""
    high, low = divmod(n, 100)
    if n % 1000 == 0 or 2001 <= n <= 2009:
        return _english(n)
    return f"{_english(high)} " + ("hundred" if low == 0 else f"oh {_english(low)}" if low < 10 else _english(low))


def digits(text: str, lang: str) -> str:
    names = FR_SMALL if lang == "fr" else EN_SMALL
    return " ".join(names[int(c)] for c in text)


# ------------------------------------------------------------------ patterns

_END = r"(?![\p{Alphabetic}\p{N}'’])"
_END_OF_DIGITS = r"(?![0-9\p{Alphabetic}]|[,.:][0-9])"
_rx = regex.compile
_DATE = _rx(r"([0-9]{4}|[0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]+)(?![0-9]|[/.-][0-9])")
_GROUPS = _rx(r"\+?[0-9]++(?:[ .-][0-9]++)*+(?!\p{Alphabetic})")
_FRACTION = _rx(rf"([0-9]{{1,3}})/([0-9]{{1,3}}){_END}(?!/)")
_ORDINAL = _rx(rf"([0-9]{{1,9}})(\p{{Alphabetic}}++){_END}")
_HOUR = _rx(rf"([0-9]{{1,2}}) ?[hH](?: ?([0-9]{{2}}){_END_OF_DIGITS})?")
_CLOCK = _rx(rf"([0-9]{{1,2}})([:.])([0-9]{{2}}){_END_OF_DIGITS}")
_HALF_DAY = _rx(rf" ?(?:([ap])\.m\.|([ap])m{_END})", regex.IGNORECASE)
_NUMBER = {
    "fr": _rx(r"((?:[1-9][0-9]{0,2}(?:[ .][0-9]{3}(?![0-9]))+)|[0-9]+)(?:[,.]([0-9]+))?"),
    "en": _rx(r"((?:[1-9][0-9]{0,2}(?:,[0-9]{3}(?![0-9]))+)|[0-9]+)(?:\.([0-9]+))?"),
}
_DEGREE = _rx(rf" ?[°º](?: ?([CF]){_END})?")
_MONEY = _rx(rf" ?([€$£]|(?:EUR|USD|GBP|CHF){_END})")
_UNIT = _rx(rf" ?(\p{{Alphabetic}}++)(?:/(\p{{Alphabetic}}++){_END})?")
_WORD_AFTER = _rx(r" ?(\p{Alphabetic}++)")
_WORD = _rx(r"\p{Alphabetic}(?:\p{Alphabetic}|['’-](?=\p{Alphabetic}))*")
_REST_BLANK = _rx(r"\s*+\Z")
_PLACE = _rx(r"[0-9]|[-−+](?=[0-9])|[€$£]|&|/|\p{Alphabetic}")


_UNIT_NAMES = {symbol: {"fr": fr, "en": en} for symbols, fr, en in UNITS for symbol in symbols}
_MONEY_NAMES = {symbol: {"fr": fr, "en": en} for symbols, fr, en in CURRENCIES for symbol in symbols}


def _abbreviations(lang: str) -> tuple[regex.Pattern, dict[str, str]]:
    follows = {None: "", "name": r"(?= \p{Lu})", "digit": "(?= ?[0-9])"}
    names, parts = {}, []
    for form, fr, en, need in sorted(ABBREVIATIONS, key=lambda row: -len(row[0])):
        if expansion := fr if lang == "fr" else en:
            for written in {form, form[0].upper() + form[1:]}:
                names.setdefault(written, expansion)
                parts.append(regex.escape(written, special_only=True, literal_spaces=True) + (_END if form[-1].isalnum() else "") + follows[need])
    return _rx("|".join(f"(?:{p})" for p in parts)), names


_SHORT = {lang: _abbreviations(lang) for lang in ("fr", "en")}

# ------------------------------------------------------------------ the walk


class _Walk:
    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.words = regex.sub("[\u00a0\u202f]", " ", text), lang, WORDS[lang]
        self.out: list[str] = []
        self.spoke = False
        self.last_word = ""
        #: English dates: 1 after a month, 2 after its day.
        self.month = 0
        self.rules = (self.date, self.telephone, self.time, self.fraction, self.ordinal)

    def say(self, words: str) -> None:
        if self.out and self.out[-1][-1:].isalnum():
            self.out.append(" ")
        self.out.append(words)
        self.spoke, self.last_word = True, ""

    def copy(self, piece: str) -> None:
        if piece:
            self.out += [" ", piece] if self.spoke and piece[0].isalnum() else [piece]
            self.spoke = False

    def run(self) -> str:
        text, at = self.text, 0
        while m := _PLACE.search(text, at):
            self.plain(text[at : m.start()])
            at = self.place(m.start())
        self.plain(text[at:])
        return regex.sub(" +", " ", "".join(self.out)).strip()

    def plain(self, piece: str) -> None:
        if piece.strip(", \t\n\r"):
            self.month = 0
        self.copy(piece)

    def place(self, at: int) -> int:
        """Says or copies what begins at a place; where it ends."""
        text, c = self.text, self.text[at]
        before = text[at - 1] if at else " "
        glued = before.isalnum()
        if "0" <= c <= "9":
            if not glued:
                return self.number(at, False)
            run = regex.compile("[0-9]+").match(text, at).group()
            self.say(digits(run, self.lang) if len(run) > 12 or len(run) > 1 and run[0] == "0" else cardinal(int(run), self.lang))
            return at + len(run)
        if c in "-−" and (before.isspace() or before == "("):
            return self.number(at + 1, True)
        if c == "+" and not glued:
            words, end = self.telephone(at) or (self.words["plus"], at + 1)
            self.say(words)
            return end
        if c in "€$£" and (m := regex.compile(" ?").match(text, at + 1)) and (n := _NUMBER[self.lang].match(text, m.end())) and (words := self.money(n, c)):
            self.say(words)
            return n.end()
        if c == "&" and before.isspace() and (at + 1 == len(text) or text[at + 1].isspace()):
            self.say(self.words["and"])
            return at + 1
        if c == "/" and (m := _rx(rf"/(\p{{Alphabetic}}++){_END}").match(text, at)) and m[1].lower() in PER:
            if self.out and not self.out[-1][-1:].isspace():
                self.out.append(" ")
            self.out.append(f"{self.words['per']} {PER[m[1].lower()][self.lang == 'en']}")
            self.spoke = True
            return m.end()
        if c.isalpha() and not glued:
            return self.word(at)
        self.plain(c)
        return at + 1

    def word(self, at: int) -> int:
        short, names = _SHORT[self.lang]
        if m := short.match(self.text, at):
            words = names[m.group()]
            self.say(words)
            if m.group().endswith(".") and _REST_BLANK.match(self.text, m.end()):
                self.out.append(".")
        else:
            m = _WORD.match(self.text, at)
            if not m:
                self.plain(self.text[at])
                return at + 1
            words = m.group()
            self.copy(words)
        self.last_word = words.lower()
        self.month = int(self.lang == "en" and words.capitalize() in MONTHS["en"])
        return m.end()

    def number(self, at: int, negative: bool) -> int:
        after_month, self_month = self.month, 0
        for rule in () if negative else self.rules:
            if found := rule(at):
                words, end = found
                self_month = 2 if rule == self.ordinal and after_month else 0
                break
        else:
            words, end, self_month = self.quantity(at)
            if negative:
                words = f"{self.words['minus']} {words}"
        self.say(words)
        self.month = self_month
        return end

    # rules: (words, end) or None

    def date(self, at: int):
        m = _DATE.match(self.text, at)
        if not m:
            return None
        a, b, c = m[1], int(m[3]), m[4]
        if len(a) == 4:
            if m[2] != "-" or len(c) > 2:
                return None
            day, month, of = int(c), b, int(a)
        elif len(c) == 4:
            day, month, of = (b, int(a), int(c)) if self.lang == "en" and int(a) <= 12 else (int(a), b, int(c))
        else:
            return None
        if not (1 <= day <= 31 and 1 <= month <= 12):
            return None
        name = MONTHS[self.lang][month - 1]
        if self.lang == "fr":
            return f"{self.day(day)} {name} {cardinal(of, 'fr')}", m.end()
        return f"{name} {ordinal(day, 'en')}, {year(of)}", m.end()

    @staticmethod
    def day(n: int) -> str:
        return "premier" if n == 1 else cardinal(n, "fr")

    def telephone(self, at: int):
        m = _GROUPS.match(self.text, at)
        if not m:
            return None
        groups = regex.findall("[0-9]+", m.group())
        sizes, plus = [len(g) for g in groups], m.group()[0] == "+"
        total, zero = sum(sizes), groups[0][0] == "0"
        threes = len(groups) > 1 and sizes[0] <= 3 and set(sizes[1:]) == {3} and not zero
        pairs = len(groups) > 2 and sizes[0] <= 3 and set(sizes[1:]) == {2}
        called = plus and total >= 7 or zero and total >= 9 or pairs and total >= 8 and not threes
        if not called and not (len(groups) > 2 and total >= 9 and not threes or len(groups) == 1 and total >= 8):
            return None
        if called and self.lang == "fr" and sizes == [10]:
            groups = regex.findall("..", groups[0])
        in_pairs = lambda g: called and len(g) == 2 and g[0] != "0"
        said = ", ".join(cardinal(int(g), self.lang) if in_pairs(g) else digits(g, self.lang) for g in groups)
        return f"{self.words['plus']} {said}" if plus else said, m.end()

    def clock(self, hour: int, minutes: int, half: str | None = None) -> str:
        if self.lang == "fr":
            name = {0: "zéro heure", 1: "une heure"}.get(hour) or f"{cardinal(hour, 'fr')} heures"
            return f"{name} {cardinal(minutes, 'fr')}" if minutes else name
        shown = [_english(hour)]
        if minutes:
            shown.append(("oh " if minutes < 10 else "") + _english(minutes))
        elif half is None:
            shown.append("o'clock")
        return " ".join([*shown, half] if half else shown)

    def half_day(self, at: int):
        m = _HALF_DAY.match(self.text, at)
        if not m:
            return None
        name = f"{(m[1] or m[2]).lower()} m"
        return name + "." * bool(m[1] and _REST_BLANK.match(self.text, m.end())), m.end()

    def time(self, at: int):
        text, whole = self.text, regex.compile("[0-9]{1,2}(?![0-9])").match(self.text, at)
        if not whole:
            return None
        hour = int(whole.group())
        if self.lang == "fr":
            if (m := _HOUR.match(text, at)) and hour <= 24:
                if m[2] and int(m[2]) <= 59:
                    return self.clock(hour, int(m[2])), m.end()
                end = text.index(next(x for x in text[whole.end() :] if x in "hH"), whole.end()) + 1
                return None if text[end : end + 1].isalnum() else (self.clock(hour, 0), end)
        elif (half := self.half_day(whole.end())) and 1 <= hour <= 12:
            return self.clock(hour, 0, half[0]), half[1]
        m = _CLOCK.match(text, at)
        if not m or hour > 23 or int(m[3]) > 59:
            return None
        if self.lang == "en" and (half := self.half_day(m.end())):
            return self.clock(hour, int(m[3]), half[0]), half[1]
        colon = m[2] == ":" and not (self.lang == "fr" and text[m.end() : m.end() + 1] == ":")
        if colon or m[2] == "." and self.last_word in TIME_LEADS[self.lang] and not self.measured(m.end()):
            return self.clock(hour, int(m[3])), m.end()
        return None

    def measured(self, at: int) -> bool:
        """Whether a unit or an amount of money follows."""
        if regex.compile(" ?[%€$£°]").match(self.text, at):
            return True
        m = _WORD_AFTER.match(self.text, at)
        return bool(m) and (m[1] in _UNIT_NAMES or m[1] in _MONEY_NAMES or m[1].lower() in CURRENCY_WORDS)

    def fraction(self, at: int):
        m = _FRACTION.match(self.text, at)
        if not m:
            return None
        x, y = int(m[1]), int(m[2])
        if self.lang == "fr" and 1 <= x <= 31 and 1 <= y <= 12 and self.last_word in DATE_LEADS:
            return f"{self.day(x)} {MONTHS['fr'][y - 1]}", m.end()
        if known := FRACTIONS[self.lang].get(f"{x}/{y}"):
            return known, m.end()
        below = _NUMBER[self.lang].fullmatch(str(y))
        with_unit = self.unit(below, m.end())
        if with_unit:
            return f"{cardinal(x, self.lang)} {self.words['over']} {with_unit[0]}", with_unit[1]
        return f"{cardinal(x, self.lang)} {self.words['over']} {cardinal(y, self.lang)}", m.end()

    def ordinal(self, at: int):
        m = _ORDINAL.match(self.text, at)
        if not m:
            return None
        n, ending = int(m[1]), m[2].lower()
        if self.lang == "en":
            return (ordinal(n, "en"), m.end()) if ending in ("st", "nd", "rd", "th") else None
        if ending not in FR_ENDINGS:
            return None
        least, most, feminine, plural = FR_ENDINGS[ending]
        if n < least or most is not None and n > most:
            return None
        word = ("seconde" if feminine else "second") if ending.startswith("nd") else ordinal(n, "fr", feminine)
        return word + "s" * plural, m.end()

    # quantities

    def value(self, m: regex.Match) -> int | None:
        whole = regex.sub("[^0-9]", "", m[1])
        return int(whole) if len(whole) <= 12 else None

    def several(self, m: regex.Match) -> bool:
        n = self.value(m)
        if self.lang == "fr":
            return n is None or n >= 2
        return n != 1 or bool((m[2] or "").strip("0"))

    def amount(self, m: regex.Match, feminine: bool = False) -> str:
        """The number itself in words."""
        whole, n = regex.sub("[^0-9]", "", m[1]), self.value(m)
        if n is None or len(whole) > 1 and whole[0] == "0":
            said = digits(whole, self.lang)
        else:
            said = cardinal(n, self.lang)
            if feminine and self.lang == "fr" and m[2] is None and regex.search("(^|[ -])un$", said):
                said += "e"
        if m[2] is None:
            return said
        part = m[2]
        if self.lang == "en" or len(part) > 3:
            after = digits(part, self.lang)
        else:
            rest = part.lstrip("0")
            after = " ".join([*["zéro"] * (len(part) - len(rest)), *([cardinal(int(rest), "fr")] if rest else [])])
        return f"{said} {self.words['point']} {after}"

    def quantity(self, at: int) -> tuple[str, int, int]:
        """(words, end, place in an English date)."""
        m = _NUMBER[self.lang].match(self.text, at)
        if self.text[m.end() : m.end() + 1] in ("-", "–") and (second := _NUMBER[self.lang].match(self.text, m.end() + 1)):
            words, end, month = self.tail(second)
            return f"{self.amount(m)} {self.words['to']} {words}", end, month
        return self.tail(m)

    def tail(self, m: regex.Match) -> tuple[str, int, int]:
        text, end, n = self.text, m.end(), self.value(m)
        if p := regex.compile(" ?%").match(text, end):
            return f"{self.amount(m)} {self.words['%']}", p.end(), 0
        if p := _DEGREE.match(text, end):
            scale = {"C": " Celsius", "F": " Fahrenheit", None: ""}[p[1]]
            return f"{self.amount(m)} {self.words['degree'][self.several(m)]}{scale}", p.end(), 0
        if (p := _MONEY.match(text, end)) and (words := self.money(m, p[1])):
            return words, p.end(), 0
        if p := regex.compile(r" ?[x×](?!\p{Alphabetic})").match(text, end):
            return f"{self.amount(m)} {self.words['times']}", p.end(), 0
        if found := self.unit(m, end):
            return *found, 0
        after = _WORD_AFTER.match(text, end)
        if n is not None and m[2] is None:
            if 1 <= n <= 31 and after and after.group()[0] == " " and after[1].lower() in (x.lower() for x in MONTHS[self.lang]):
                return self.day(n) if self.lang == "fr" else ordinal(n, "en"), end, 0
            if self.month == 1 and 1 <= n <= 31 and len(m[1]) <= 2:
                return ordinal(n, "en"), end, 2
            if self.month and len(m[1]) == 4 and 1100 <= n <= 2099:
                return year(n), end, 0
        return self.amount(m, bool(after) and after[1].lower() in FEMININE), end, 0

    def round_millions(self, m: regex.Match, name: str) -> str:
        """French names after round millions: "deux millions de grammes"."""
        n = self.value(m)
        if self.lang == "fr" and m[2] is None and n is not None and n >= 10**6 and n % 10**6 == 0:
            return f" d'{name}" if name[0] in "aeiouyéèh" else f" de {name}"
        return f" {name}"

    def unit(self, m: regex.Match, at: int):
        u = _UNIT.match(self.text, at)
        if not u or u[1] not in _UNIT_NAMES:
            return None
        close = u.end(1)
        if regex.compile(_END).match(self.text, close) is None:
            return None
        name, end = _UNIT_NAMES[u[1]][self.lang][self.several(m)], close
        if u[2]:
            per = _UNIT_NAMES[u[2]][self.lang][0] if u[2] in _UNIT_NAMES else PER.get(u[2].lower(), ("", ""))[self.lang == "en"]
            if per:
                name, end = f"{name} {self.words['per']} {per}", u.end()
        return self.amount(m) + self.round_millions(m, name), end

    def money(self, m: regex.Match, symbol: str) -> str | None:
        n, part = self.value(m), m[2] or ""
        if n is None or len(part) > 2:
            return None
        one, many, cent, cents_name = _MONEY_NAMES[symbol][self.lang]
        cents, french = int(part.ljust(2, "0") or 0), self.lang == "fr"
        said = []
        if n or not cents:
            name = many if (n >= 2 if french else n != 1) else one
            whole = n >= 10**6 and n % 10**6 == 0 and french
            said.append(cardinal(n, self.lang) + ((" d'" if name[0] in "aeiouyéèh" else " de ") if whole else " ") + name)
        if cents:
            name = "" if french and n else f" {cent if cents == 1 else cents_name}"
            said.append(("and " if said and not french else "") + cardinal(cents, self.lang) + name)
        return " ".join(said)


def normalise(text: str, language: str) -> str:
    """The text in words; unchanged for languages other than French and English."""
    return _Walk(text, language).run() if language in WORDS else text
