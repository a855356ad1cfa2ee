"""PII: format-preserving Feistel pseudonyms (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.rows import named

_DOTTED = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\p{N})|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?!\p{N})"
_DASHED = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\p{N}-])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?!\p{N})|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"
#: The forms looked for.  A card doesn't run into an address, date or number of another form.  Each match is validated by its kind before it is replaced.
FORMS = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"(?<![\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\p{N})",
    r"(?<![\p{L}\p{N}])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\p{N}-])",
    r"(?<![\p{L}\p{N}.])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?!\p{N})",
    r"(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\p{N})",
    r"(?<![\p{L}\p{N}])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?!\p{N})",
    r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    rf"(?<![\p{{L}}\p{{N}}-])[0-9](?:(?:-(?!{_DOTTED})| (?!{_DOTTED}|{_DASHED}))?[0-9]){{12,18}}(?![\p{{L}}\p{{N}}])",
)
ANY = "|".join(FORMS)
#: Where a form may begin if what stands before doesn't matter; runs of the characters that forms are made of, and of all others.
ANYWHERE = f"(?={re.sub(r'[(][?]<!\[[^\]]*\][)]', '', ANY)})"
RUNS = r"[\p{L}\p{N}._%+@()/ -]+|[^\p{L}\p{N}._%+@()/ -]+"
#: Characters of an account number, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31: 73049 = 17 * 4297, the two halves of a date's permutation.
DAY_PARTS = (17, 4297)
#: Areas (001 to 899 without 666), groups (01 to 99) and serials (0001 to 9999) of social security numbers.
SSN_PARTS = (898, 99, 9999)
#: First code point and count of each class of characters that is permuted within itself.
CLASSES = ((48, 10), (65, 26), (97, 26), (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _codes(s: str) -> str:
    return f"transform(filter(sequence(0, char_length({s})), i -> i > 0), i -> cast(ascii(substring({s}, i, 1)) as bigint))"


def _class(code: str, kind: str, radix: bool) -> str:
    """Radix, or else first code point, of a character's class; characters of no class have radix 1."""
    cases = []
    for first, n in CLASSES:
        if n == 26:
            n = f"if({kind} = 'hex', 6, 26)"
        cases.append(f"when {code} between {first} and {first} + {n} - 1 then {n if radix else first}")
    return f"cast(case {' '.join(cases)} else {1 if radix else code} end as bigint)"


def _luhn(digits: str) -> str:
    """Sum of the digits, every second from the right doubled, modulo 10; the last digit counts once."""
    d = "cast(substring(turned, i, 1) as int)"
    part = f"if(i % 2 = 1, {d}, {d} * 2 - if({d} > 4, 9, 0))"
    return _let("turned", f"reverse({digits})", f"aggregate(sequence(1, char_length(turned)), 0, (x, i) -> (x + {part}) % 10)")


def _mod97(account: str) -> str:
    """An account number with its first four characters moved to the end, modulo 97, letters as 10 to 35."""
    moved = f"concat(substring({account}, 5), substring({account}, 1, 4))"
    return f"aggregate({_codes(moved)}, 0L, (x, c) -> if(c < 58, (x * 10 + c - 48) % 97, (x * 100 + c - 55) % 97))"


def permuted(values: str, radices: str, label: str, key: str) -> str:
    """Keyed permutation of a mixed-radix number: rounds add a keyed function of one half to the other.

    Each round can be undone, so unequal values stay unequal; a position of radix 1 stays as it is.
    Halves hold at most 32 positions, of radix below 2^16.
    """
    half = f"if(i % 2 = 0, slice(st, 1, size({values}) div 2), slice(st, size({values}) div 2 + 1, size({values})))"
    noise = f"sha2(concat('{key}|', {label}, '|', i, '|', array_join(cast({half} as array<string>), ',')), 512)"
    place = f"if(i % 2 = 0, j - size({values}) div 2, j)"
    step = f"pmod(x + cast(conv(substring(h, {place} * 4 + 1, 4), 16, 10) as bigint), get({radices}, j))"
    turn = _let("h", noise, f"transform(st, (x, j) -> if((j >= size({values}) div 2) = (i % 2 = 0), {step}, x))")
    return f"aggregate(sequence(0, {ROUNDS - 1}), {values}, (st, i) -> {turn})"


def _date(form: str) -> str:
    return f"datediff(cast(try_to_timestamp(m, '{form}') as date), date'1900-01-01')"


def pseudonym(key: str) -> str:
    """SQL for the pseudonym of the match ``m``, or null if it doesn't validate as its kind.

    The rounds are keyed by a digest, so the key itself may hold any character and stands in no plan."""
    key = hashlib.sha256(key.encode()).hexdigest()
    bare = "regexp_replace(m, '[^0-9A-Z]', '')"
    last = DAY_PARTS[0] * DAY_PARTS[1] - 1
    kind = f"""case
      when contains(m, '@') then 'mail'
      when m rlike '^([0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})$' then if(m rlike '[0-9]' and m rlike '[A-Fa-f]', 'hex', null)
      when m rlike '^[A-Z]' then if({_mod97(bare)} = 1, 'iban', null)
      when m rlike '^[0-9]+([.][0-9]+){{3}}$' then if(forall(split(m, '[.]'), x -> cast(x as int) < 256), 'ip', null)
      when m rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then if({_date('yyyy-MM-dd')} between 0 and {last}, 'yyyy-MM-dd', null)
      when m rlike '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$' then if({_date('dd.MM.yyyy')} between 0 and {last}, 'dd.MM.yyyy', null)
      when m rlike '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$' then case
        when {_date('dd/MM/yyyy')} between 0 and {last} then 'dd/MM/yyyy'
        when {_date('MM/dd/yyyy')} between 0 and {last} then 'MM/dd/yyyy' end
      when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if(m rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', 'ssn', null)
      when m rlike '^[+(]' or m rlike '^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$' then 'phone'
      else if({_luhn(bare)} = 0, 'card', null) end"""
    # Of a phone number the country code stays; what is permuted is free of the layout, so that a value is linked across layouts.
    country = "regexp_extract(m, '^[+](1(?=[ .(-])|[0-9]{1,3}(?=[ .(-])|[0-9])', 0)"
    core = f"""case k when 'mail' then substring(m, 1, instr(m, '@') - 1) when 'hex' then m when 'iban' then substring({bare}, 5)
      when 'card' then substring({bare}, 1, char_length({bare}) - 1) when 'phone' then regexp_replace(substring(m, char_length({country}) + 1), '[^0-9]', '')
      when 'ssn' then {bare} else '' end"""
    day = "datediff(cast(try_to_timestamp(m, k) as date), date'1900-01-01')"
    values = f"""case when k = 'ip' then cast(split(m, '[.]') as array<bigint>)
      when k like '%yyyy%' then array(cast({day} div {DAY_PARTS[1]} as bigint), cast({day} % {DAY_PARTS[1]} as bigint))
      when k = 'ssn' then array(cast(substring(s, 1, 3) as bigint) - if(substring(s, 1, 3) > '666', 2, 1), cast(substring(s, 4, 2) as bigint) - 1, cast(substring(s, 6, 4) as bigint) - 1)
      else transform(c, x -> x - {_class('x', 'k', False)}) end"""
    radices = f"""case when k = 'ip' then array(256L, 256L, 256L, 256L) when k like '%yyyy%' then array({DAY_PARTS[0]}L, {DAY_PARTS[1]}L)
      when k = 'ssn' then array({', '.join(f'{n}L' for n in SSN_PARTS)})
      else transform(c, x -> {_class('x', 'k', True)}) end"""
    label = "concat(if(k like '%yyyy%', 'date', k), '|', array_join(cast(p.r as array<string>), '.'))"
    text = f"array_join(zip_with(c, q, (x, y) -> if({_class('x', 'k', True)} = 1, decode(unhex(lpad(hex(x), 8, '0')), 'UTF-32'), chr({_class('x', 'k', False)} + y))), '')"
    check = f"case k when 'card' then concat(t, (10 - {_luhn('concat(t, 0)')}) % 10)"
    full = f"""{check} when 'iban' then concat(substring(m, 1, 2), lpad(98 - {_mod97("concat(substring(m, 1, 2), '00', t)")}, 2, '0'), t) else t end"""
    tail = f"if(k = 'phone', substring(m, char_length({country}) + 1), m)"
    filled = "array_join(transform(sequence(1, char_length(w)), i -> if(substring(w, i, 1) rlike '[0-9A-Z]', substring(u, char_length(regexp_replace(substring(w, 1, i), '[^0-9A-Z]', '')), 1), substring(w, i, 1))), '')"
    shown = f"""case when k = 'ip' then array_join(cast(q as array<string>), '.')
      when k like '%yyyy%' then date_format(date_add(date'1900-01-01', cast(q[0] * {DAY_PARTS[1]} + q[1] as int)), k)
      when k = 'ssn' then concat_ws('-', lpad(cast(q[0] + if(q[0] < 665, 1, 2) as string), 3, '0'), lpad(cast(q[1] + 1 as string), 2, '0'), lpad(cast(q[2] + 1 as string), 4, '0'))
      else {_let('t', text, f"case k when 'mail' then concat(t, substring(m, instr(m, '@'))) when 'hex' then t else "
                 f"concat(if(k = 'phone', {country}, ''), {_let('u', full, _let('w', tail, filled))}) end")} end"""
    inner = _let("p", f"named_struct('v', {values}, 'r', {radices})", _let("q", permuted("p.v", "p.r", label, key), shown))
    return _let("k", kind, f"if(k is null, null, {_let('s', core, _let('c', _codes('s'), inner))})")


def cut(m: str) -> str:
    """SQL for the part of a match that holds: of cards and account numbers with gaps the part up to a gap that validates, or ''.

    An account number of its country's length comes first, then the longest; other kinds stay whole.
    """
    bare = "regexp_replace(v, '[ -]', '')"
    size = " ".join(f"when substring({m}, 1, 2) in ({', '.join(repr(c) for c in names.split())}) then {n}" for n, names in IBAN_LENGTHS.items())
    parts = f"transform(filter(sequence(char_length({m}), 12, -1), n -> substring({m}, n + 1, 1) in ('', ' ', '-') and substring({m}, n, 1) not in (' ', '-')), n -> substring({m}, 1, n))"
    cards = f"filter({parts}, v -> char_length({bare}) between 13 and 19 and {_luhn(bare)} = 0)"
    accounts = f"filter({parts}, v -> {_mod97(bare)} = 1)"
    fits = f"filter(good, v -> char_length({bare}) = (case {size} end))"
    rest = f"filter(good, v -> v = {m} or (case {size} end) is null)"
    return f"""case when {m} rlike '^[0-9]+[ -]' and {m} rlike '^[0-9]([ -]?[0-9]){{12,18}}$' then coalesce(get({cards}, 0), '')
      when {m} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]* ' then {_let('good', accounts, f"coalesce(get({fits}, 0), get({rest}, 0), '')")}
      else {m} end"""


def _again(text: str) -> str:
    """SQL for (text before, match) pairs where a match that is cut short or given up lets the search go on behind it or its first number.

    Runs are searched one by one, as no form goes beyond one; a run's steps are at most the places where a form may begin.
    """
    form, where, runs = (f"r'{x}'" for x in (ANY, ANYWHERE, RUNS))
    none = "cast(array() as array<struct<s: string, m: string>>)"
    # What is skipped without a match: the first number of the match, up to its first gap.
    skip = "char_length(regexp_extract(f, '^[^ -]+', 0))"
    taken = "named_struct('out', concat(z.out, array(named_struct('s', concat(z.tail, substring(z.rest, 1, at - 1)), 'm', g))), 'tail', '', 'rest', substring(z.rest, at + char_length(g)))"
    left = f"named_struct('out', z.out, 'tail', concat(z.tail, substring(z.rest, 1, at - 1 + {skip})), 'rest', substring(z.rest, at + {skip}))"
    end = "named_struct('out', z.out, 'tail', concat(z.tail, z.rest), 'rest', '')"
    found = _let("at", f"regexp_instr(z.rest, {form})", _let("g", cut("f"), f"if(g = '', {left}, {taken})"))
    chosen = f"if(f = '', {end}, {found})"
    step = f"if(z.rest = '', z, {_let('f', f'regexp_extract(z.rest, {form}, 0)', chosen)})"
    start = f"named_struct('out', {none}, 'tail', '', 'rest', run)"
    close = "concat(z.out, array(named_struct('s', concat(z.tail, z.rest), 'm', cast(null as string))))"
    return f"flatten(transform(regexp_extract_all({text}, {runs}, 0), run -> aggregate(sequence(0, regexp_count(run, {where})), {start}, (z, o) -> {step}, z -> {close})))"


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """Replace validated personal numbers, dates, addresses and secrets in ``text`` by keyed pseudonyms of the same form.

    Kinds: e-mail (local part), keys of 32 to 64 hex digits, IBAN (modulo 97), IPv4
    (octets), dates of 1900 to 2099 (calendar), phone numbers, social security numbers,
    card numbers (Luhn).  A pseudonym is a keyed permutation within the value's form, so
    equal values stay equal across documents, unequal ones unequal, and checksums and ranges hold.  Whoever has ``key`` can undo it.
    Of a card or account number that doesn't validate, the parts up to its gaps are tried,
    and the search goes on behind the part that does, or else behind its first number.
    What doesn't validate stays as it is, and so does all other text.

    Nulls: a null text stays null with count 0.  Empty texts stay empty.  Rows are worked
    on one by one, so repeated rows and ties need no rule.  All other columns stay; a
    column that has the count's name is replaced.

    Returns the columns of ``docs`` with ``text`` replaced, and the number of replacements.
    """
    columns, body = [c for c in docs.columns if c != count], named(text)
    docs = docs.select(*map(named, columns))
    if not {c.lower() for c in columns}.isdisjoint({"found_", "pairs_", "new_"}):
        # What is worked out on the way must not hide a column.
        own = {c: f"c{i}" for i, c in enumerate(columns)}
        out = pseudonymised(docs.select(*[named(c).alias(n) for c, n in own.items()]), key, own[text], "replaced")
        return out.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("replaced").alias(count))
    found = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    out = docs.withColumn("found_", F.when(body.isNotNull(), found).otherwise(F.array().cast("array<string>")))
    once = F.zip_with(F.split(body, ANY), "found_", lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    out = out.withColumn("pairs_", F.when(F.size("found_") > 0, F.when(F.expr(f"exists(found_, m -> m <> {cut('m')})"), F.expr(_again(f"`{text}`"))).otherwise(once)))
    out = out.withColumn("new_", F.expr(f"transform(pairs_.m, m -> if(m is null, null, {pseudonym(key)}))"))
    pieces = F.zip_with("pairs_", "new_", lambda p, q: F.concat(p["s"], F.coalesce(q, p["m"], F.lit(""))))
    n = F.coalesce(F.size(F.filter("new_", lambda q: q.isNotNull())), F.lit(0)).cast("long")
    kept = [F.when(n > 0, F.array_join(pieces, "")).otherwise(body).alias(text) if c == text else named(c) for c in columns]
    return out.select(*kept, n.alias(count))
