"""Queries whose input is a table of sentences written for them, held against what they should become.

For the grammars that no SQL says in reasonable length: numbers and texts in words, sentences, post-correction. Whole tables go
through the same functions in the queries of texts.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import text as T

#: Words as said, and with their numbers folded.
FOLDED = [
    ('0,3', '0.3'),
    ('08', '8'),
    ('13,000', '13000'),
    ('13.000', '13000'),
    ('250 mg', '250 mg'),
    ('4,000,000', '4000000'),
    ('7,4', '7.4'),
    ('7,400', '7.400'),
    ('7.4', '7.4'),
    ('9 15', '915'),
    ('cent', '100'),
    ('cent pour cent', '100 %'),
    ('eight point one', '8 point one'),
    ('eleven thousand rows', '11000 rows'),
    ('five thousand thirty one', '5031'),
    ('forty percent', '40 %'),
    ('forty two', '42'),
    ('four times an hour', '4 times an hour'),
    ('mille', '1000'),
    ('nine fifteen', '915'),
    ('one good idea', 'one good idea'),
    ('quatre une', '4 une'),
    ('quatre vingt dix huit', '98'),
    ('quatre vingt seize', '96'),
    ('quatre vingts pages', '80 pages'),
    ('seize', '16'),
    ('seize heures vingt', '16 heures 20'),
    ('six cent quarante', '640'),
    ('soixante dix neuf', '79'),
    ('soixante douze', '72'),
    ('soixante et onze mots', '71 mots'),
    ('three hundred and nine', '309'),
    ('trente et un lits', '31 lits'),
    ('trente pour cent', '30 %'),
    ('trois cents grammes', '300 grammes'),
    ('trois mille trente huit', '3038'),
    ('trois virgule deux litres', '3.2 litres'),
    ('un autre point de départ', 'un autre point de départ'),
    ('un dossier', 'un dossier'),
    ('une page', 'une page'),
    ('zéro virgule sept', '0.7'),
]
#: Language, text as written, and as said.
SPOKEN = [
    ('de', 'Er hat 3 Hunde', 'Er hat 3 Hunde'),
    ('en', '$20', 'twenty dollars'),
    ('en', '$7.25', 'seven dollars and twenty-five cents'),
    ('en', '1 kg', 'one kilogram'),
    ('en', '101.3 °F', 'one hundred one point three degrees Fahrenheit'),
    ('en', '2-3 weeks', 'two to three weeks'),
    ('en', '2.5 l', 'two point five liters'),
    ('en', '24 June 2031', 'twenty-fourth June twenty thirty-one'),
    ('en', '250 mg', 'two hundred fifty milligrams'),
    ('en', '2x weekly', 'two times weekly'),
    ('en', '3,400 rows', 'three thousand four hundred rows'),
    ('en', '3/4 cup', 'three quarters cup'),
    ('en', '8.75', 'eight point seven five'),
    ('en', '80%', 'eighty percent'),
    ('en', 'June 1987', 'June nineteen eighty-seven'),
    ('en', 'June 24, 2031', 'June twenty-fourth, twenty thirty-one'),
    ('en', 'June 24th, 2031', 'June twenty-fourth, twenty thirty-one'),
    ('en', 'Mrs. Hill met Prof. Lake, i.e. yesterday', 'missus Hill met professor Lake, that is yesterday'),
    ('en', 'Room 40 opens at 7:30 am on 3 May 2031 for $12', 'Room forty opens at seven thirty a m on third May twenty thirty-one for twelve dollars'),
    ('en', 'at 17:20', 'at seventeen twenty'),
    ('en', 'at 7:08', 'at seven oh eight'),
    ('en', 'before 11.45', 'before eleven forty-five'),
    ('en', 'by 6:45 pm', 'by six forty-five p m'),
    ('en', 'chapter 3.14', 'chapter three point one four'),
    ('en', 'from 8:00', "from eight o'clock"),
    ('en', 'her 4th, 22nd and 53rd entry', 'her fourth, twenty-second and fifty-third entry'),
    ('en', 'on 06/24/2031', 'on June twenty-fourth, twenty thirty-one'),
    ('en', 'on 24/06/2031', 'on June twenty-fourth, twenty thirty-one'),
    ('en', 'the 40th and the 300th', 'the fortieth and the three hundredth'),
    ('en', 'the chart vs. the text', 'the chart versus the text'),
    ('en', 'until 7 am', 'until seven a m'),
    ('en', '£9', 'nine pounds'),
    ('fr', '', ''),
    ('fr', '  vitamine B6  ', 'vitamine B six'),
    ('fr', '(8)', '(huit)'),
    ('fr', '-12', 'moins douze'),
    ('fr', '-18 °C', 'moins dix-huit degrés Celsius'),
    ('fr', '0,07', 'zéro virgule zéro sept'),
    ('fr', '0,4', 'zéro virgule quatre'),
    ('fr', '0,80 €', 'quatre-vingts centimes'),
    ('fr', '07 81 22 90 13', 'zéro sept, quatre-vingt-un, vingt-deux, quatre-vingt-dix, treize'),
    ('fr', '0781229013', 'zéro sept, quatre-vingt-un, vingt-deux, quatre-vingt-dix, treize'),
    ('fr', '1 dossier', 'un dossier'),
    ('fr', '1 kg', 'un kilogramme'),
    ('fr', '1 page', 'une page'),
    ('fr', '1,2 l', 'un virgule deux litre'),
    ('fr', '1/3 de verre', 'un tiers de verre'),
    ('fr', '15 mg/kg', 'quinze milligrammes par kilogramme'),
    ('fr', '2 x 250 mg', 'deux fois deux cent cinquante milligrammes'),
    ('fr', '2/3 du flacon', 'deux tiers du flacon'),
    ('fr', '250 mg deux fois', 'deux cent cinquante milligrammes deux fois'),
    ('fr', '3 000 000 g', 'trois millions de grammes'),
    ('fr', '3 000 000 €', "trois millions d'euros"),
    ('fr', '3,5 ml', 'trois virgule cinq millilitres'),
    ('fr', '3.600', 'trois mille six cents'),
    ('fr', '30 ml/heure', 'trente millilitres par heure'),
    ('fr', '31 pages', 'trente et une pages'),
    ('fr', '35 %', 'trente-cinq pour cent'),
    ('fr', '39,2 °C', 'trente-neuf virgule deux degrés Celsius'),
    ('fr', '4 000 lits', 'quatre mille lits'),
    ('fr', '4 x par semaine', 'quatre fois par semaine'),
    ('fr', '5 000 000', 'cinq millions'),
    ('fr', '5x/jour', 'cinq fois par jour'),
    ('fr', '6.2', 'six virgule deux'),
    ('fr', '60 CHF', 'soixante francs'),
    ('fr', '64 bpm', 'soixante-quatre battements par minute'),
    ('fr', '654 321', 'six cent cinquante-quatre mille trois cent vingt et un'),
    ('fr', '7, 8 et 9.', 'sept, huit et neuf.'),
    ('fr', '7,20 €', 'sept euros vingt'),
    ('fr', '7,5%', 'sept virgule cinq pour cent'),
    ('fr', '8 heures', 'huit heures'),
    ('fr', '8,75', 'huit virgule soixante-quinze'),
    ('fr', "9 d'entre eux", "neuf d'entre eux"),
    ('fr', '90 €', 'quatre-vingt-dix euros'),
    ('fr', '95 mmHg', 'quatre-vingt-quinze millimètres de mercure'),
    ('fr', 'Le 5e envoi pèse 2,5 kg et coûte 18,90 €.', 'Le cinquième envoi pèse deux virgule cinq kilogrammes et coûte dix-huit euros quatre-vingt-dix.'),
    ('fr', 'Mlle Brun et M. Noir saluent le Pr Blanc', 'mademoiselle Brun et monsieur Noir saluent le professeur Blanc'),
    ('fr', 'Rien à changer ici', 'Rien à changer ici'),
    ('fr', 'Tension mesurée : 135/85 mmHg ce soir', 'Tension mesurée : cent trente-cinq sur quatre-vingt-cinq millimètres de mercure ce soir'),
    ('fr', 'Verser 30 ml trois fois par jour.', 'Verser trente millilitres trois fois par jour.'),
    ('fr', 'après 1 h', 'après une heure'),
    ('fr', 'au 4e jour, la 6ème semaine', 'au quatrième jour, la sixième semaine'),
    ('fr', 'avant 19h', 'avant dix-neuf heures'),
    ('fr', 'c.-à-d. lundi', "c'est-à-dire lundi"),
    ('fr', 'cf. p. 7', 'voir page sept'),
    ('fr', 'chapitre 3.14', 'chapitre trois virgule quatorze'),
    ('fr', 'code 0042', 'code zéro zéro quatre deux'),
    ('fr', 'depuis 11.45', 'depuis onze heures quarante-cinq'),
    ('fr', 'dossier n° 318', 'dossier numéro trois cent dix-huit'),
    ('fr', 'du riz, etc.', 'du riz, et cetera.'),
    ('fr', 'du riz, etc. et du sel', 'du riz, et cetera et du sel'),
    ('fr', 'dès 7h08', 'dès sept heures huit'),
    ('fr', 'dès 8h00', 'dès huit heures'),
    ('fr', 'entre 15-20 minutes', 'entre quinze à vingt minutes'),
    ('fr', 'env. 9 mois', 'environ neuf mois'),
    ('fr', 'le 1 avril 1999', 'le premier avril mille neuf cent quatre-vingt-dix-neuf'),
    ('fr', 'le 1er juin', 'le premier juin'),
    ('fr', 'le 2031-06-24', 'le vingt-quatre juin deux mille trente et un'),
    ('fr', 'le 24.06.2031', 'le vingt-quatre juin deux mille trente et un'),
    ('fr', 'le 24/06', 'le vingt-quatre juin'),
    ('fr', 'le 24/06/2031', 'le vingt-quatre juin deux mille trente et un'),
    ('fr', 'le 3 févr. 2028', 'le trois février deux mille vingt-huit'),
    ('fr', 'le 31e, le 90e et le 200e', 'le trente et unième, le quatre-vingt-dixième et le deux centième'),
    ('fr', 'le 8 mai 2031', 'le huit mai deux mille trente et un'),
    ('fr', 'note 7/10', 'note sept sur dix'),
    ('fr', 'sa 1re visite', 'sa première visite'),
    ('fr', 'vers 16 h 45', 'vers seize heures quarante-cinq'),
    ('fr', 'vers 16h45', 'vers seize heures quarante-cinq'),
    ('fr', 'vers 17:20', 'vers dix-sept heures vingt'),
    ('fr', '€15', 'quinze euros'),
]
#: Sentences; a text is these with blanks between.
SENTENCES = [
    ['(Voir plus haut.)', 'La suite.'],
    ['Ask Mrs. Hill vs. Mr. Lake.', 'Done.'],
    ['Aucun point ici'],
    ['B. Noir signe.', 'Oui.'],
    ['Bien. ...', 'Bon.'],
    ['Du sel, du riz, etc.', 'Puis rien.'],
    ['Du sel, etc. et du riz.'],
    ['Elle crie : « Halte ! »', 'Puis elle court.'],
    ['Elle crie : « Halte ! », puis court.'],
    ['Enfin…', 'Il part.'],
    ['Il en reste 6.', 'Puis 2.'],
    ['Il neige.', 'On rentre ?'],
    ['Je doute... sans doute.', 'Bon.'],
    ['Le Pr. Brun part à St. Malo.', 'Il revient.'],
    ['Le dossier n° 31 est clos.', 'Suivant.'],
    ['Prendre un outil, e.g. une pince.', 'Serrer.'],
    ['Quoi?!', 'Non.'],
    ['Reçu le 3 févr. 2028 au bureau.', 'Classé.'],
    ['She said "Go home."', 'Then slept.'],
    ['Stop there!', 'Why?'],
    ['Verser 7,5 ml à 18:20.', 'Attendre 8h15.'],
    ['Voir Mme Blanc ou M. Noir.', 'Puis sortir.'],
    ['« Qui vient ? » demanda Paul.', 'Nous.'],
]
#: Text, vocabulary, corrected text.
CORRECTED = [
    ('', ['potassium'], ''),
    ('(potasium), puis « magnesiun » !', ['potassium', 'magnésium'], '(potassium), puis « magnésium » !'),
    ('Ibuprofenne, une fois par jour', ['ibuprofène'], 'Ibuprofène, une fois par jour'),
    ("On donne de l'ibuprofene au coucher.", ['ibuprofène'], "On donne de l'ibuprofène au coucher."),
    ('anti inflamatoire', ['anti-inflammatoire'], 'anti-inflammatoire'),
    ('des dossiers, deux serveurs', ['dossier', 'serveur'], 'des dossiers, deux serveurs'),
    ('du magnesium et du potasium', ['magnésium', 'potassium'], 'du magnésium et du potassium'),
    ('en novembre 250 mg aucun 8mg Novembres', ['novembre', 'gramme', 'aucun', '250mg'], 'en novembre 250 mg aucun 8mg Novembres'),
    ('ibuprofene2 ibuprofene', ['ibuprofène'], 'ibuprofene2 ibuprofène'),
    ('la traction est bonne', ['fraction'], 'la traction est bonne'),
    ('le doliprane', ['dolipranx', 'dolipraney'], 'le doliprane'),
    ('rien', [], 'rien'),
    ('sans le vin', ['vain'], 'sans le vin'),
    ('un antiinflamatoire puissant', ['anti-inflammatoire'], 'un anti-inflammatoire puissant'),
    ('un serveur kubernetes ici', ['Kubernetes'], 'un serveur kubernetes ici'),
    ('une farotte', ['carotte'], 'une farotte'),
    ('une insufisance renale', ['insuffisance rénale'], 'une insuffisance rénale'),
    ('une insufisance. renale', ['insuffisance rénale'], 'une insufisance. renale'),
]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query(_values(FOLDED, "said, folded"))
def txt02_06_numbers_of_sentences(spark, sf_dir) -> DataFrame:
    df = spark.createDataFrame([(said,) for said, _ in FOLDED], "said string")
    return df.select("said", F.array_join(T.fold_numbers(F.split("said", " ")), " ").alias("folded"))


@query(_values(SPOKEN, "language, written, spoken"))
def txt50_60_spoken_sentences(spark, sf_dir) -> DataFrame:
    df = spark.createDataFrame([c[:2] for c in SPOKEN], "language string, written string")
    return df.select("language", "written", T.spoken_text("written", "language").alias("spoken"))


@query(_values([(i, place, s) for i, pieces in enumerate(SENTENCES) for place, s in enumerate(pieces)], "text, place, sentence"))
def txt30_31_sentences_of_texts(spark, sf_dir) -> DataFrame:
    df = spark.createDataFrame([(i, " ".join(pieces)) for i, pieces in enumerate(SENTENCES)], "id int, whole string")
    return df.select(F.col("id").alias("text"), F.posexplode(T.split_sentences("whole")).alias("place", "s")).select("text", "place", F.col("s.text").alias("sentence"))


@query(_values([(text, corrected) for text, _, corrected in CORRECTED], "written, corrected"))
def txt40_45_corrected_sentences(spark, sf_dir) -> DataFrame:
    out = None
    for text, vocabulary, _ in CORRECTED:
        row = spark.createDataFrame([(text,)], "written string").select("written", T.post_correct("written", vocabulary)["text"].alias("corrected"))
        out = row if out is None else out.unionByName(row)
    return out


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
