"""SQL twins of the text machines, as common table expressions that the queries' SQL is put together from.

They say the same in another way and share no table with the functions they are held against: lexicons are spelled out here.
"""

from __future__ import annotations

#: Number words with their values, French and English.
_FRENCH = (
    "map {'zéro': 0, 'zero': 0, 'un': 1, 'une': 1, 'deux': 2, 'trois': 3, 'quatre': 4, 'cinq': 5, 'six': 6, 'sept': 7, 'huit': 8, 'neuf': 9, 'dix': 10, 'onze': 11, 'douze': 12, "
    "'treize': 13, 'quatorze': 14, 'quinze': 15, 'seize': 16, 'vingt': 20, 'vingts': 20, 'trente': 30, 'quarante': 40, 'cinquante': 50, 'soixante': 60}"
)
_ENGLISH = (
    "map {'zero': 0, 'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, 'eight': 8, 'nine': 9, 'ten': 10, 'eleven': 11, 'twelve': 12, 'thirteen': 13, "
    "'fourteen': 14, 'fifteen': 15, 'sixteen': 16, 'seventeen': 17, 'eighteen': 18, 'nineteen': 19, 'twenty': 20, 'thirty': 30, 'forty': 40, 'fifty': 50, 'sixty': 60, 'seventy': 70, "
    "'eighty': 80, 'ninety': 90}"
)
#: The unit of each spelling.
UNIT = (
    "map {'mg': 'mg', 'milligramme': 'mg', 'milligrammes': 'mg', 'milligram': 'mg', 'milligrams': 'mg', 'g': 'g', 'gramme': 'g', 'grammes': 'g', 'gram': 'g', 'grams': 'g', "
    "'kg': 'kg', 'kilo': 'kg', 'kilos': 'kg', 'kilogramme': 'kg', 'kilogrammes': 'kg', 'kilogram': 'kg', 'kilograms': 'kg', "
    "'µg': 'µg', 'ug': 'µg', 'mcg': 'µg', 'microgramme': 'µg', 'microgrammes': 'µg', 'microgram': 'µg', 'micrograms': 'µg', "
    "'ml': 'ml', 'millilitre': 'ml', 'millilitres': 'ml', 'milliliter': 'ml', 'milliliters': 'ml', 'cl': 'cl', 'centilitre': 'cl', 'centilitres': 'cl', "
    "'l': 'l', 'litre': 'l', 'litres': 'l', 'liter': 'l', 'liters': 'l', '%': '%', 'h': 'h', 'heure': 'h', 'heures': 'h', 'hour': 'h', 'hours': 'h', 'mmhg': 'mmhg', "
    "'cm': 'cm', 'centimètre': 'cm', 'centimètres': 'cm', 'centimeter': 'cm', 'centimeters': 'cm', 'mm': 'mm', 'millimètre': 'mm', 'millimètres': 'mm', 'millimeter': 'mm', "
    "'millimeters': 'mm', 'm': 'm', 'mètre': 'm', 'mètres': 'm', 'meter': 'm', 'meters': 'm'}"
)
#: Words that negate, and names of days and months.
NEGATIONS = (
    "('pas', 'jamais', 'aucun', 'aucune', 'aucuns', 'aucunes', 'sans', 'non', 'rien', 'ni', 'nul', 'nulle', 'not', 'no', 'never', 'without', 'none', 'nothing', 'nobody', 'cannot')"
)
DATE_WORDS = (
    "('lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi', 'samedi', 'dimanche', 'janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', "
    "'novembre', 'décembre', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday', 'january', 'february', 'march', 'april', 'june', 'july', 'august', "
    "'october', 'december')"
)
NUMERIC = "'[0-9]+([.,][0-9]+)*'"


def _step(word: str) -> str:
    """The number so far, as thousands * 1000 + what is below a thousand, after one more word; null if it can't go on."""
    below, value = "(s % 1000)", f"(case l when 1 then ({_FRENCH})[{word}] else ({_ENGLISH})[{word}] end)"
    follows = (
        f"case when l = 1 and {below} % 100 = 10 then {value} between 7 and 9 when l = 1 and {below} % 100 in (60, 80) then {value} between 1 and 19 "
        f"when {below} % 100 in (20, 30, 40, 50, 60, 70, 80, 90) then {value} between 1 and 9 else false end"
    )
    return (
        f"case when {word} = (case l when 1 then 'mille' else 'thousand' end) then case when s // 1000 = 0 and {below} > 0 then {below} * 1000000 end "
        f"when (l = 1 and {word} in ('cent', 'cents')) or (l = 2 and {word} = 'hundred') then case when {below} between 1 and 9 then (s // 1000) * 1000 + {below} * 100 end "
        f"when coalesce({value}, 0) = 0 then null when {below} % 100 = 0 then s + {value} when {below} = 4 and {value} = 20 and l = 1 then (s // 1000) * 1000 + 80 "
        f"when {follows} then s + {value} end"
    )


def words(texts: str, given: str = "") -> str:
    """Expressions up to nw (t, w): the words for scoring of each text t of the query ``texts``.

    n4 holds them before numbers and units are folded, na before units are. With ``given``, a query of (t, w), these words are
    folded instead.
    """
    knows = f"case when ({_FRENCH})[x] is not null or x in ('cent', 'cents', 'mille') then 1 when ({_ENGLISH})[x] is not null or x in ('hundred', 'thousand') then 2 else 0 end"
    said = "case when k = 1 and f in ('un', 'une', 'one') then f else cast(s // 1000 + s % 1000 as varchar) end"
    start = rf"""n0 as (select distinct t, lower(translate(t, '’‘`', '''''''')) as x from ({texts}) where t is not null),
n1 as (select t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])',
  '\1' || chr(57344) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(57345) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(57345) || '\2', 'g') as x from n0),
n2 as (select t, translate(regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{Co}}%'']', ' ', 'g'), chr(57344) || chr(57345), '.,') as x from n1),
n3 as (select t, regexp_replace(regexp_replace(regexp_replace(x, '([0-9])([^0-9.,'' ])', '\1 \2', 'g'), '(%)([^%'' ])', '\1 \2', 'g'), '(\p{{L}})([^\p{{L}}'' ])',
  '\1 \2', 'g') as x from n2),
n4 as (select t, list_filter(list_transform(string_split_regex(x, '\s+'), lambda y: trim(y, '''')), lambda y: y <> '') as w from n3)"""
    start = f"n4 as ({given})" if given else start
    return start + rf""",
n5 as (select t, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when w[i] = 'cent' and i > 1 and w[i - 1] in ('pour', 'per') then null
  when w[i] in ('pour', 'per') and i < len(w) and w[i + 1] = 'cent' then '%' when w[i] in ('pourcent', 'percent') then '%' else w[i] end), lambda y: y is not null) as w
  from n4),
-- spoken numbers: i the next word, o what is done, s the number so far, k its words, f the first, l its language
n6 as (select t, w, 1::bigint as i, []::varchar[] as o, null::bigint as s, 0 as k, ''::varchar as f, 0 as l from n5
  union all select t, w,
    case when s is null or go is not null then i + 1 when more is not null then i + 2 else i end,
    case when s is null and begins = 0 then list_append(o, x) when s is null or go is not null or more is not null then o else list_append(o, {said}) end,
    case when s is null then case when begins = 0 then null when x in ('mille', 'thousand') then 1000000 when x in ('cent', 'cents', 'hundred') then 100
  else coalesce(case begins when 1 then ({_FRENCH})[x] else ({_ENGLISH})[x] end, 0) end else coalesce(go, more) end,
    case when s is null then 1 else k + 1 end, case when s is null then x else f end, case when s is null then begins else l end
  from (select *, case when s is not null then {_step("x")} end as go, case when s is not null and {_step("x")} is null and y is not null and x = (case l when 1 then 'et'
  else 'and' end) then {_step("y")} end as more, {knows} as begins
    from (select *, w[i] as x, case when i < len(w) then w[i + 1] end as y from n6 where i <= len(w)))),
n7 as (select t, case when s is null then o else list_append(o, {said}) end as w from n6 where i > len(w)),
n8 as (select t, list_filter(string_split(regexp_replace('  ' || array_to_string(w, '  ') || '  ', ' ([0-9]+)  (?:virgule|point)  ([0-9]+) ', ' \1.\2 ', 'g'), ' '),
  lambda y: y <> '') as w from n7),
n9 as (select t, list_transform(w, lambda y: case when not regexp_full_match(y, {NUMERIC}) then y when regexp_full_match(y, '[0-9]+[.,][0-9]+')
  and not regexp_full_match(y, '[1-9][0-9]{{1,2}}[.,][0-9]{{3}}') then regexp_replace(replace(y, ',', '.'), '^0+([0-9])', '\1')
  when regexp_full_match(y, '[0-9]+[.,][0-9]+') or regexp_full_match(y, '[0-9]+([.,][0-9]+)*') then regexp_replace(regexp_replace(y, '[.,]', '', 'g'), '^0+([0-9])',
  '\1') end) as w from n8),
na as (select t, case when len(w) = 0 then []::varchar[] else list_reduce(list_transform(w, lambda y: [y]), lambda a, y: case when regexp_full_match(a[-1], '[0-9]+')
  and regexp_full_match(y[1], '[0-9]+') then list_append(a[:-2], a[-1] || y[1]) else list_concat(a, y) end) end as w from n9),
nw as (select t, list_transform(w, lambda y: coalesce(({UNIT})[y], y)) as w from na)"""


def aligned(pairs: str) -> str:
    """Expressions up to al (a, b, h): of each distinct pair of word lists a, b the hypothesis word of each reference word, 0 for
    none. The table of costs is gone through by diagonals; of equal costs a substitution goes before a deletion before an
    insertion, as seen from the end."""
    cell = (
        "list_min(list_filter([case when i > 0 and j > 0 then {'c': p[i].c + (a[i] <> b[j])::int, 'r': 0, 'h': list_append(p[i].h, j)} end, "
        "case when i > 0 then {'c': q[i].c + 1, 'r': 1, 'h': list_append(q[i].h, 0)} end, case when j > 0 then {'c': q[i + 1].c + 1, 'r': 2, 'h': q[i + 1].h} end], lambda z: z is not null))"
    ).replace("j", "(d + 1 - i)")
    return f"""pq as (select row_number() over () as id, a, b from (select distinct a, b from ({pairs}))),
dg as (select id, a, b, 0::bigint as d, [{{'c': 0, 'r': 0, 'h': []::bigint[]}}] as p, [{{'c': 0, 'r': 0, 'h': []::bigint[]}}] as q from pq
  union all select id, a, b, d + 1, q, list_transform(range(0, least(len(a), d + 1) + 1), lambda i: case when d + 1 - i <= len(b) then {cell} end) from dg
  where d < len(a) + len(b)),
al as (select a, b, q[len(a) + 1].h as h from dg where d = len(a) + len(b))"""


#: Counts of an alignment's steps.
COUNTS = (
    "cast(len(list_filter(range(1, len(a) + 1), lambda i: h[i] > 0 and a[i] <> b[h[i]])) as bigint) as substitutions, cast(len(list_filter(h, lambda j: j = 0)) as bigint) as deletions, "
    "cast(len(b) - len(list_filter(h, lambda j: j > 0)) as bigint) as insertions"
)


def distances(pairs: str) -> str:
    """Expressions up to nb (a, b, distance): the edit distance of each pair of texts, in characters.

    A pair's characters are brought to one byte each, so that the distance of bytes is that of characters; a pair may have 127.
    """
    return f"""np as (select distinct a, b from ({pairs}) where a is not null and b is not null), nf as (select a, b, list_distinct(string_split(a || b, '')) as f from np),
ng as (select a, b, array_to_string(f, '') as f, array_to_string(list_transform(range(1, least(len(f), 127) + 1), lambda i: chr(i::int)), '') as g, case
  when len(f) > 127 then error('too many characters') end as e from nf),
nb as (select a, b, cast(levenshtein(translate(a, f, g), translate(b, f, g)) as bigint) as distance from ng where e is null)"""


def flags(runs: str, samples: str = "samples") -> str:
    """Expressions up to fl (r, kind, severity), a row for each flag of each row r of the query ``runs`` (r, reference, text,
    "sampleId"), after the words of their texts and of the samples' key terms."""
    parts = "list_filter(flatten(list_transform(w, lambda y: string_split(y, ''''))), lambda y: y <> '')"
    return rf"""fa as (select * from ({runs})), fp as (select distinct reference, text from fa),
ft as (select reference, text, unnest(w) as x, 1 as d from fp join nw on t = reference union all select reference, text, unnest(w), -1 from fp join nw on t = text),
fk as (select reference, text, 'number' as kind, x, d from ft where regexp_full_match(x, {NUMERIC}) union all select reference, text, 'unit', ({UNIT})[x], d from ft
  where ({UNIT})[x] is not null union all select reference, text, 'date', x, d from ft where x in {DATE_WORDS}),
fd as (select reference, text, kind, x, sum(d) as d from fk group by all),
fc as (select reference, text, kind, greatest(sum(greatest(d, 0)), sum(greatest(-d, 0))) as n from fd group by all),
fn as (select reference, text, count(case when d = 1 and (x in {NEGATIONS} or x like '%n''t') then 1 end) as rs, count(case when d = -1 and (x in {NEGATIONS}
  or x like '%n''t') then 1 end) as hs,
  count(case when d = 1 and (x = 'ne' or x like 'n''%') then 1 end) as rw, count(case when d = -1 and (x = 'ne' or x like 'n''%') then 1 end) as hw from ft group by all),
fx as (select reference, text, kind, n from fc where n > 0 union all select reference, text, 'negation', 1 from fn where (case when rs > 0 then rs else least(rw,
  1) end) <> (case when hs > 0 then hs else least(hw, 1) end)),
fs as (select id, unnest("keyTerms") as k, generate_subscripts("keyTerms", 1) as place from (select distinct id, "keyTerms" from {samples})),
fw as (select id, place, k.text as term, coalesce(nullif(k.kind, ''), 'term') as kind, {parts} as w from fs join nw on t = k.text),
fh as (select t, {parts} as w from nw),
fo as (select r, fw.place, fw.term, fw.kind, len(fw.w) = 0 or len(list_filter(range(1, len(fh.w) - len(fw.w) + 2), lambda i: fh.w[i:i + len(fw.w) - 1] = fw.w)) > 0
  as found from fa join fw on fw.id = fa."sampleId" join fh on fh.t = fa.text),
fl as (select r, kind, 'critical' as severity from (select r, kind, unnest(range(n::bigint)) from fa join fx using (reference, text)) union all select r, 'keyTerm', case
  when kind in ('drug', 'name') then 'critical' else 'warning' end from fo where not found)"""


def loops(texts: str, name: str = "lp") -> str:
    """Expressions up to ``name`` (t, repeats, size): of each text the most often repeated group of words, (1, 0) without one."""
    return rf"""{name}w as (select t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+') as w from (select distinct t from ({texts}) where t is not null)),
{name}s as (select t, k, list_max(list_transform(string_split(array_to_string(list_transform(range(1, len(w) - k + 1), lambda i: case when w[i] = w[i + k] then '1'
  else '0' end), ''), '0'), lambda y: len(y))) as longest from (select *, unnest(range(1, least(8, len(w) // 2) + 1)) as k from {name}w)),
{name}r as (select t, k, 1 + longest // k as n from {name}s where 1 + longest // k >= case when k = 1 then 4 else 3 end),
{name} as (select t, coalesce(n, 1) as repeats, coalesce(k, 0) as size from {name}w left join (select t, max(n) as n, arg_max(k, n * 100 - k) as k from {name}r
  group by t) using (t))"""


def endings(pairs: str) -> str:
    """Expressions up to en (reference, text, lost): whether fewer than half of the last eight words stand among the text's last
    sixteen."""
    last = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')[-{n}:]"
    return f"""ew as (select distinct reference, text from ({pairs})), et as (select reference, text, unnest({last.format(c="reference", n=8)}) as x, 1 as side from ew
  union all select reference, text, unnest({last.format(c="text", n=16)}), 2 from ew),
ec as (select reference, text, x, count(case when side = 1 then 1 end) as a, count(case when side = 2 then 1 end) as b from et group by all),
en as (select reference, text, coalesce(2 * sum(least(a, b)) < sum(a), false) as lost from ew left join ec using (reference, text) group by all)"""


_FOLDED = "replace(replace(translate(lower({x}), 'àâäáãéèêëîïíôöóõùûüúçÿ', 'aaaaaeeeeiiioooouuuucy'), 'œ', 'oe'), 'æ', 'ae')"
_PROTECTED = f"(regexp_matches({{x}}, '[0-9]') or lower({{x}}) in {NEGATIONS} or lower({{x}}) in {DATE_WORDS} or ({UNIT})[lower({{x}})] is not null)"


def corrections(texts: str, terms: str) -> str:
    """Expressions up to ch (t, i, k, "from", "to", distance): the strict preset's changes of each text t of the query ``texts`` by
    the terms (term) of the query ``terms``: which stretch of k words from the word i on becomes what."""
    return rf"""ct as (select t, regexp_extract_all(t, '([\p{{L}}\p{{N}}]+)[^\p{{L}}\p{{N}}]*', 1) as w, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+([^\p{{L}}\p{{N}}]*)', 1) as g
  from (select distinct t from ({texts}) where t is not null)),
cf as (select *, list_transform(w, lambda y: {_FOLDED.format(x="y")}) as f, list_transform(w, lambda y: {_PROTECTED.replace("{x}", "y")}) as p, list_transform(g,
  lambda y: regexp_full_match(y, '[ \-''’ ]+')) as j from ct),
tt as (select distinct term, regexp_extract_all(term, '[\p{{L}}\p{{N}}]+') as w from ({terms}) where term is not null), tu as (select term,
  array_to_string(list_transform(w, lambda y: {_FOLDED.format(x="y")}), '') as f, len(w) as n from tt where len(w) > 0 and len(list_filter(w,
  lambda y: {_PROTECTED.replace("{x}", "y")})) = 0),
tk as (select term, f, unnest(range(greatest(n - 1, 1), n + 2)) as k from tu where length(f) >= 6),
ck as (select *, unnest(range(1, (select coalesce(max(k), 0) from tk) + 1)) as k from cf), ci as (select *, unnest(range(1, len(w) - k + 2)) as i from ck),
cw as (select t, i, k, array_to_string(f[i:i + k - 1], '') as x, array_to_string(list_transform(range(i, i + k), lambda q: case when q < i + k - 1 then w[q] || g[q]
  else w[q] end), '') as slice from ci where not list_contains(p[i:i + k - 1], true) and (k = 1 or not list_contains(j[i:i + k - 2], false))),
cv as (select * from cw where length(x) >= 6),
ce as (select distinct t, i from cv join (select distinct k, lower(term) as l from tk) e on e.k = cv.k and e.l = lower(slice)),
cp as (select distinct x, tk.f, tk.term, tk.k from (select distinct x, k from cv) c join tk on tk.k = c.k and substr(c.x, 1, 1) = substr(tk.f, 1, 1)
  and abs(length(c.x) - length(tk.f)) <= 2), {distances("select x as a, f as b from cp")},
co as (select f, min(term) as low, max(term) as high from tu where length(f) >= 6 group by f),
cn as (select x, cp.k, term, distance from cp join nb on a = x and b = cp.f left join co on co.f = x where distance <= least(floor(length(cp.f) * 0.17::double), 2)
  and not (x = cp.f || 's' or x = cp.f || 'x' or cp.f = x || 's' or cp.f = x || 'x') and (co.f is null or (low = term and high = term))),
ca as (select t, i, cv.k, slice, term, distance, min(distance) over (partition by t, i) as least from cv join cn using (x, k) where (t, i) not in (select (t, i)
  from ce)),
cb as (select t, i, min(k) as k, arg_min(slice, k) as slice, min(term) as term, min(distance) as distance from ca where distance = least group by t, i
  having count(distinct term) = 1),
cr as (select t, 1::bigint as at, null::struct(i bigint, k bigint, slice varchar, term varchar, distance bigint) as b from (select distinct t from cb)
  union all select cr.t, min(struct_pack(i := cb.i, k := cb.k, slice := cb.slice, term := cb.term, distance := cb.distance)).i + min(struct_pack(i := cb.i, k := cb.k,
  slice := cb.slice, term := cb.term, distance := cb.distance)).k, min(struct_pack(i := cb.i, k := cb.k, slice := cb.slice, term := cb.term, distance := cb.distance))
  from cr join cb on cb.t = cr.t and cb.i >= cr.at group by cr.t, cr.at),
ch as (select t, b.i as i, b.k as k, b.slice as "from", case when upper(b.slice[1]) = b.slice[1] and lower(b.slice[1]) <> b.slice[1] and lower(b.term[1]) = b.term[1]
  and upper(b.term[1]) <> b.term[1] then upper(b.term[1]) || b.term[2:] else b.term end as "to", b.distance as distance from cr where b is not null)"""
