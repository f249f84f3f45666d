"""Format-preserving Feistel pseudonyms for validated numbers and dates.

Card numbers (Luhn), IBANs (mod 97), US social security and phone numbers,
IPv4 addresses, calendar dates and the local part of e-mail addresses are found
by pattern and validated. The value becomes a list of components, each with a
modulus (a digit, an octet, a letter, a part of a day number), and a keyed
Feistel network adds to one half of the components a keystream of the other
half, eight times. The result has the same format and stays valid: check
digits are made anew, a date stays a real date within its hundred years. Equal
values get equal pseudonyms in every document under one key, however they are
written; only a date that must be read day first, as 25/12/2024, is permuted
among dates of that kind (day 13 and later), for its text would otherwise meet
that of a date written month first. So each written form is permuted one to
one, and :func:`restore` undoes it with the key.

Everything is DataFrame expressions in the JVM. Without a match a text passes
as it is. The key is a column of a one-row table beside the documents, so that
no plan, page or event log shows it.

Defined results: a null or empty text stays null or empty with 0 findings. A
match that fails validation stays as it is; in a run of groups with blanks or
hyphens between, every card number or IBAN that begins and ends at a separator
is found, whatever stands beside it. Texts are read whole. Rows are
handled one by one, repeated ones included; all columns are kept, and added
ones take a free name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.shared import free_name
from driftkeep.llm.tables import table

ROUNDS = 8
#: The key of the registered query alone; others are given.
DEMO_KEY = "driftkeep-demonstration-key"
#: Kinds in the order in which a match is tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}

#: A date, an address or a number with dots that begins where a run of digit groups would go on.
_OTHER = rf"{PATTERNS['email']}|{PATTERNS['ipv4']}|(?:\d{{4}}/\d{{2}}/\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}\.\d{{2}}\.\d{{4}})(?![\d/-])|(?:\d{{3}}\.\d{{3}}[ .-]|\d{{3}}[ -]\d{{3}}\.)\d{{4}}(?![\w-])"
#: Whole runs of groups, in which numbers are then looked for; possessive, so that long runs need no stack.
RUNS = {
    "iban": rf"(?<!\w)(?=[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2}})[A-Z0-9]++(?!\w)(?: (?!{_OTHER}|{PATTERNS['date']}|{PATTERNS['ssn']}|{PATTERNS['phone']})[A-Z0-9]++(?!\w|[./-]\d))*+",
    "card": rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}})\d++(?!\w|-(?!\d))(?:[ -](?!{_OTHER})\d++(?!\w|-(?!\d)))*+",
}


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: The column that holds the key.
KEY = "__feistel_key"


def _feistel(kind: str, v: str, mods: str, back: bool) -> str:
    """SQL for the permuted components of ``v``, an array of longs, under ``mods``, an array of as many moduli; with ``back`` the inverse."""
    half = f"cast(size({v}) div 2 as int)"
    # Longs of a keyed hash: eight to a digest, further digests for longer halves.
    stream = lambda other, i: f"cast(conv(substr(sha2(concat_ws('|', {KEY}, '{kind}', cast(r as string), array_join(transform({other}, o -> cast(o as string)), '.'), cast(({i}) div 8 as string)), 256), 1 + 8 * cast(({i}) % 8 as int), 8), 16, 10) as bigint)"
    sign, rounds = ("-", f"{ROUNDS}, 1, -1") if back else ("+", f"1, {ROUNDS}")
    left = f"transform(s.a, (x, i) -> pmod(x {sign} {stream('s.b', 'i')}, element_at({mods}, i + 1)))"
    right = f"transform(s.b, (x, i) -> pmod(x {sign} {stream('s.a', 'i')}, element_at({mods}, i + 1 + size(s.a))))"
    return (
        f"aggregate(sequence({rounds}), named_struct('a', slice({v}, 1, {half}), 'b', slice({v}, {half} + 1, size({v}))), "
        f"(s, r) -> if(r % 2 = 1, named_struct('a', {left}, 'b', s.b), named_struct('a', s.a, 'b', {right})), s -> concat(s.a, s.b))"
    )


def _chars(m: str) -> str:
    return f"transform(sequence(1, length({m})), j -> substr({m}, j, 1))"


def _digits(m: str) -> str:
    return f"transform(regexp_extract_all({m}, '[0-9]', 0), d -> cast(d as bigint))"


def _fill(m: str, values: str, like: str = "[0-9]", after: int = 0) -> str:
    """The text ``m`` with its characters of a class, past the first ``after``, replaced in turn by ``values``."""
    put = f"concat(t.s, element_at({values}, t.i - {after}))"
    return f"aggregate({_chars(m)}, named_struct('s', '', 'i', 1), (t, c) -> if(c rlike '^{like}$', named_struct('s', if(t.i <= {after}, concat(t.s, c), {put}), 'i', t.i + 1), named_struct('s', concat(t.s, c), 'i', t.i)), t -> t.s)"


def _strings(v: str) -> str:
    return f"transform({v}, z -> cast(z as string))"


def _luhn(d: str) -> str:
    """The Luhn sum of digits, the last one not doubled."""
    return f"aggregate(sequence(1, size({d})), 0L, (q, n) -> q + if((size({d}) - n) % 2 = 1, if(element_at({d}, n) > 4, 2 * element_at({d}, n) - 9, 2 * element_at({d}, n)), element_at({d}, n)))"


def _is_card(d: str) -> str:
    return f"{_luhn(d)} % 10 = 0 and array_max(slice({d}, 1, 6)) > 0"


def _card(m: str, back: bool) -> str:
    """The issuer's six digits stay, the account is permuted, the check digit follows."""
    body = _let("acc", "slice(d, 7, size(d) - 7)", _feistel("card", "acc", "transform(acc, k -> 10L)", back))
    new = _let("w", f"concat(slice(d, 1, 6), {body}, array(0L))", f"concat(slice(w, 1, size(w) - 1), array(pmod(-({_luhn('w')}), 10L)))")
    return _let("d", _digits(m), f"if({_is_card('d')}, {_let('u', _strings(new), _fill(m, 'u'))}, {m})")


def _phone(m: str, back: bool) -> str:
    """Ten national digits; area and exchange begin with 2 to 9, and so do their pseudonyms."""
    mods = "array(8L,10L,10L,8L,10L,10L,10L,10L,10L,10L)"
    shift = lambda v, by: f"transform({v}, (k, n) -> k + if(n in (0, 3), {by}L, 0L))"
    new = _let("v", shift("d", -2), _let("w", _feistel("phone", "v", mods, back), shift("w", 2)))
    national = "slice(e, size(e) - 9, 10)"
    done = _let("u", _strings(new), f"if(size(e) = 11, {_fill(m, 'u', after=1)}, {_fill(m, 'u')})")
    return _let("e", _digits(m), _let("d", national, f"if(element_at(d, 1) >= 2 and element_at(d, 4) >= 2, {done}, {m})"))


def _ssn(m: str, back: bool) -> str:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    v = "array(p[0] - if(p[0] > 666, 2, 1), p[1] - 1, p[2] - 1)"
    new = _let("v", v, _let("w", _feistel("ssn", "v", "array(898L, 99L, 9999L)", back), "concat_ws('-', lpad(cast(w[0] + if(w[0] >= 665, 2, 1) as string), 3, '0'), lpad(cast(w[1] + 1 as string), 2, '0'), lpad(cast(w[2] + 1 as string), 4, '0'))"))
    return _let("p", f"transform(split({m}, '-'), k -> cast(k as bigint))", f"if(p[0] between 1 and 899 and p[0] <> 666 and p[1] > 0 and p[2] > 0, {new}, {m})")


def _ipv4(m: str, back: bool) -> str:
    new = _let("w", _feistel("ipv4", "p", "array(256L, 256L, 256L, 256L)", back), f"array_join({_strings('w')}, '.')")
    return _let("p", f"transform(split({m}, r'\\.'), k -> cast(k as bigint))", f"if(array_max(p) < 256, {new}, {m})")


def _mod97(s: str) -> str:
    return f"aggregate({_chars(s)}, 0L, (q, c) -> pmod(q * if(c rlike '[0-9]', 10, 100) + if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 55), 97L))"


def _is_iban(ib: str) -> str:
    # Check digits are 02 to 98: the others that fit could not be made anew.
    return f"{_mod97(f'concat(substr({ib}, 5), substr({ib}, 1, 4))')} = 1 and substr({ib}, 3, 2) between '02' and '98'"


def _iban(m: str, back: bool) -> str:
    """Country stays, the account's letters and digits are permuted in kind, check digits follow."""
    parts = _let("bc", _chars("substr(ib, 5)"), _let("w", _feistel("iban", "transform(bc, c -> cast(if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 65) as bigint))", "transform(bc, c -> if(c rlike '[0-9]', 10L, 26L))", back), "array_join(zip_with(bc, w, (c, k) -> if(c rlike '[0-9]', cast(k as string), chr(k + 65))), '')"))
    new = _let("bb", parts, f"concat(substr(ib, 1, 2), lpad(cast(98 - {_mod97('concat(bb, substr(ib, 1, 2), chr(48), chr(48))')} as string), 2, '0'), bb)")
    done = _let("nw", _chars(new), _fill(m, "nw", "[A-Z0-9]"))
    return _let("ib", f"replace({m}, ' ', '')", f"if({_is_iban('ib')}, {done}, {m})")


def _date(m: str, back: bool) -> str:
    """A day number within its hundred years from 1950 on: 36525 = 75 * 487 or 36524 = 92 * 397 days.

    A date that must be read day first is a number among the days from the 13th
    on, 12 less a month: 22125 = 125 * 177 or 22124 = 4 * 5531 of them.
    """
    iso = lambda y, a, b: f"try_cast(concat_ws('-', substr({m}, {y}, 4), substr({m}, {a}, 2), substr({m}, {b}, 2)) as date)"
    # Which way the match is written: year first, day first with dots, month first, or day first with slashes.
    way = f"case when {m} rlike '^[0-9]{{4}}' then named_struct('f', 1, 'd', {iso(1, 6, 9)}) when {m} like '%.%' then named_struct('f', 2, 'd', {iso(7, 4, 1)}) when {iso(7, 1, 4)} is not null then named_struct('f', 3, 'd', {iso(7, 1, 4)}) else named_struct('f', 4, 'd', {iso(7, 4, 1)}) end"
    start = "make_date(1950 + 100 * cast(floor((year(g.d) - 1950) / 100) as int), 1, 1)"
    count = "datediff(make_date(year(b0) + 100, 1, 1), b0)"
    # Days from the 13th on before month k, and the place of the date among them.
    late = lambda k: f"(datediff(add_months(b0, {k}), b0) - 12 * {k})"
    months = "cast(12 * (year(g.d) - year(b0)) + month(g.d) as int)"
    n0 = f"cast(datediff(g.d, b0) - if(g.f = 4, 12 * {months}, 0) as bigint)"
    mods = f"if({count} = 36525, if(g.f = 4, array(125L, 177L), array(75L, 487L)), if(g.f = 4, array(4L, 5531L), array(92L, 397L)))"
    # A month has 18.4 such days on average and never is three months off that.
    month = f"element_at(filter(sequence(greatest(0, cast(n1 / 18.4375 as int) - 3), least(1199, cast(n1 / 18.4375 as int) + 3)), k -> {late('k')} <= n1 and n1 < {late('(k + 1)')}), 1)"
    day = f"if(g.f = 4, {_let('k0', month, f'date_add(add_months(b0, k0), cast(12 + n1 - {late("k0")} as int))')}, date_add(b0, cast(n1 as int)))"
    new = _let("b0", start, _let("md", mods, _let("n0", n0, _let("v", "array(n0 div md[1], n0 % md[1])", _let("w", _feistel("date", "v", "md", back), _let("n1", "w[0] * md[1] + w[1]", day))))))
    text = f"case g.f when 1 then date_format(nd, if({m} like '%/%', 'yyyy/MM/dd', 'yyyy-MM-dd')) when 2 then date_format(nd, 'dd.MM.yyyy') when 3 then date_format(nd, 'MM/dd/yyyy') else date_format(nd, 'dd/MM/yyyy') end"
    return _let("g", way, f"if(g.d is null or year(g.d) not between 1050 and 8949, {m}, {_let('nd', new, text)})")


def _email(m: str, back: bool) -> str:
    """Letters and digits of the local part move within their kind; the domain stays."""
    kind = lambda c, d, lo, up: f"if({c} rlike '[0-9]', {d}, if({c} rlike '[a-z]', {lo}, {up}))"
    v = f"transform(ch, c -> cast(ascii(c) - {kind('c', 48, 97, 65)} as bigint))"
    new = _let("w", _feistel("email", v, f"transform(ch, c -> {kind('c', '10L', '26L', '26L')})", back), f"zip_with(ch, w, (c, k) -> chr(k + {kind('c', 48, 97, 65)}))")
    local = f"substring_index({m}, '@', 1)"
    done = _let("nw", new, f"concat({_fill(local, 'nw', '[A-Za-z0-9]')}, '@', substring_index({m}, '@', -1))")
    return _let("ch", f"regexp_extract_all({local}, '[A-Za-z0-9]', 0)", f"if(size(ch) = 0, {m}, {done})")


_MAKERS = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}


def pseudonym_sql(m: str, back: bool = False) -> str:
    """SQL that maps one match to its pseudonym, or back, under the key in the column KEY."""
    cases = " ".join(f"when {m} rlike r'^(?:{PATTERNS[k]})$' then {f(m, back)}" for k, f in _MAKERS.items())
    return f"case {cases} else {m} end"


_PIECE = "array<struct<s:string,hit:boolean>>"


def _piece(s: str, hit: bool) -> str:
    return f"array(named_struct('s', {s}, 'hit', {str(hit).lower()}))"


def _scan(text: str, pattern: str, v: str, hit) -> str:
    """Pieces of ``text``: what lies between matches of the pattern, and ``hit`` of each match; ``v`` names variables."""
    return f"flatten(zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (a{v}, b{v}) -> concat({_piece(f'a{v}', False)}, if(b{v} is null, cast(array() as {_PIECE}), {hit(f'b{v}')}))))"


def _windows(m: str, valid: str, v: str, rest) -> str:
    """Pieces of a run of groups: the valid numbers that begin and end at separators, leftmost and longest first, and ``rest`` of what lies between.

    ``valid`` is SQL for the text w. Groups are at odd places, separators at even ones; a number has 19 groups at most.
    """
    g, e, t, x = f"g{v}", f"e{v}", f"t{v}", f"x{v}"
    join = lambda a, n: f"array_join(slice({g}, {a}, {n}), '')"
    good = _let("w", join("i", "j - i + 1"), valid)
    ends = f"transform(sequence(1, size({g})), i -> if(i % 2 = 0, 0, coalesce(array_max(filter(sequence(i, least(i + 36, size({g})), 2), j -> {good})), 0)))"
    start = "named_struct('p', 1, 'c', cast(array() as array<struct<p:int,a:int,b:int>>))"
    step = f"if(i >= {t}.p and {e}[i - 1] > 0, named_struct('p', {e}[i - 1] + 1, 'c', concat({t}.c, array(named_struct('p', {t}.p, 'a', i, 'b', {e}[i - 1])))), {t})"
    found = f"flatten(transform({t}.c, {x} -> concat({rest(join(f'{x}.p', f'{x}.a - {x}.p'))}, {_piece(join(f'{x}.a', f'{x}.b - {x}.a + 1'), True)})))"
    done = f"{t} -> concat({found}, {rest(join(f'{t}.p', f'size({g})'))})"
    return _let(g, f"regexp_extract_all({m}, '[A-Z0-9]+|[ -]', 0)", _let(e, ends, f"aggregate(sequence(1, size({g})), {start}, ({t}, i) -> {step}, {done})"))


def pieces_sql(text: str) -> str:
    """SQL for the pieces of a text, an array of s and hit: joined they are the text, and each hit is one number to be tried."""
    card = f"w rlike r'^(?:{PATTERNS['card']})$' and {_let('dw', _digits('w'), _is_card('dw'))}"
    iban = f"w rlike r'^(?:{PATTERNS['iban']})$' and {_let('iw', "replace(w, ' ', '')", _is_iban('iw'))}"
    short = "|".join(f"(?:{PATTERNS[k]})" for k in ("date", "ssn", "phone"))
    cards = lambda m, v: _windows(m, card, f"c{v}", lambda s: _scan(s, short, f"s{v}", lambda b: _piece(b, True)))
    ibans = lambda m: _windows(m, iban, "i", lambda s: _scan(s, RUNS["card"], "r", lambda b: cards(b, 1)))
    kind = lambda b: f"case when {b} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]*$' then {ibans(b)} when {b} rlike '^[0-9][0-9 -]*$' and length(regexp_replace({b}, '[ -]', '')) > 12 then {cards(b, 2)} else {_piece(b, True)} end"
    return _scan(text, "|".join(f"(?:{(PATTERNS | RUNS)[k]})" for k in PATTERNS), "0", kind)


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All columns, the text with pseudonyms, and ``n_pseudonyms``."""
    return _replaced(docs, key, column, "n_pseudonyms", back=False)


def restore(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All columns, the text with the values that its pseudonyms stand for, and ``n_restored``."""
    return _replaced(docs, key, column, "n_restored", back=True)


def _replaced(docs: DataFrame, key: str, column: str, counted: str, back: bool) -> DataFrame:
    if not key:
        raise ValueError("a key is needed")
    found, made, count = free_name("__found", docs), free_name("__made", docs), free_name(counted, docs)
    if KEY in docs.columns:
        raise ValueError(f"{KEY} is the key's column")
    secret = docs.sparkSession.createDataFrame([(key,)], f"{KEY} string")
    # Most texts lack both a digit and an @: one cheap look spares them the patterns.
    df = docs.withColumn(found, F.when(F.col(column).rlike("[0-9@]"), F.expr(pieces_sql(f"`{column}`"))).otherwise(F.array().cast(_PIECE)))
    df = df.join(F.broadcast(secret)).withColumn(made, F.expr(f"transform({found}, m -> if(m.hit, {_let('ms', 'm.s', pseudonym_sql('ms', back))}, m.s))"))
    changed = F.coalesce(F.size(F.filter(F.zip_with(found, made, lambda a, b: a["s"] != b), lambda x: x)), F.lit(0))
    return df.withColumn(column, F.when(F.size(found) > 0, F.array_join(made, "")).otherwise(F.col(column))).withColumn(count, F.when(F.size(found) > 0, changed).otherwise(0)).drop(found, made, KEY)


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
