"""Format-preserving Feistel pseudonyms of personal data, in Spark SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: IBAN lengths by country; a match of another country or length is tried as it stands.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "BI FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
_IBAN = rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"
_OTHER_NUMBER = r"\d{3}-\d{2}-\d{4}(?![\d-])|[2-9]\d{2}-[2-9]\d{2}-\d{4}(?![\d-])|\d{4}-\d{2}-\d{2}(?![\d-])|\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
#: How cards are written, longest first: these are looked for wherever in a run of digit groups they stand; then any 13 to 19 digits.
CARD_LAYOUTS = (r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{3}", r"\d{13,19}()", r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}", r"\d{4}([ -])\d{6}\2\d{5}", r"\d{4}([ -])\d{6}\2\d{4}")
ANY_CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"

#: What may be personal, in order of precedence; each is validated before it is replaced.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", _IBAN),
    ("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"),
    ("national", r"(?<![\d(.-])(?:[2-9]\d{2}-[2-9]\d{2}-\d{4}|[2-9]\d{2}\.[2-9]\d{2}\.\d{4}|\(0\d{2,4}\) ?\d{3,4} \d{4}|\([2-9]\d{2}\) ?\d{3}[ .-]\d{4})(?![\d-]|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("date", r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"),
    ("slashed", r"(?<![\d./])\d{2}(?:/\d{2}/|\.\d{2}\.)(?:19|20)\d{2}(?![\d/]|\.\d)"),
    ("card", rf"(?<![\d.-])\d(?:(?:[ -](?!{_OTHER_NUMBER}))?\d){{12,}}+"),  # a whole run of digit groups; possessive, so of any length
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What every match holds: a text without any of it has none.
MAYBE = "[0-9@]|AKIA|[a-f]{40}"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(key: str, kind: str, of: str, n_round: str) -> str:
    """A 56-bit number from the key (an SQL expression), the round and the other half."""
    return f"cast(conv(substring(sha2(concat({key}, '|{kind}|', {n_round}, '|', {of}), 256), 1, 14), 16, 10) as bigint)"


def permuted_number(value: str, a: int, b: int, key: str, kind: str) -> str:
    """A keyed permutation of the numbers below a * b: alternating rounds add to either part of a mixed-radix pair."""
    step = f"""if(i % 2 = 0, named_struct('l', (st.l + {_number(key, kind, "st.r", "i")}) % {a}L, 'r', st.r),
        named_struct('l', st.l, 'r', (st.r + {_number(key, kind, "st.l", "i")}) % {b}L))"""
    return f"element_at(transform(array({value}), v -> aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', v div {b}L, 'r', v % {b}L), (st, i) -> {step}, st -> st.l * {b}L + st.r)), 1)"


def permuted_text(value: str, key: str, kind: str, letters: int = 26) -> str:
    """A keyed permutation of the strings of the same shape: digits stay digits, small and capital letters stay such, others stay themselves."""
    shifted = f"""case when c rlike '[0-9]' then char(48 + (ascii(c) - 48 + k) % 10) when c rlike '[a-z]' then char(97 + (ascii(c) - 97 + k) % {letters})
        when c rlike '[A-Z]' then char(65 + (ascii(c) - 65 + k) % 26) else c end"""
    stream = f"sha2(concat({key}, '|{kind}|', i, '|', st.r), 512)"
    half = f"array_join(transform(array({stream}), h -> array_join(transform(split(st.l, ''), (c, j) -> element_at(transform(array(cast(conv(substring(h, 1 + 2 * (j % 64), 2), 16, 10) as int)), k -> {shifted}), 1)), '')), '')"
    return f"""element_at(transform(array({value}), v -> aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substring(v, 1, length(v) div 2), 'r', substring(v, length(v) div 2 + 1, length(v))),
        (st, i) -> named_struct('l', st.r, 'r', {half}), st -> concat(st.l, st.r))), 1)"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refilled(m: str, digits: str) -> str:
    """The digits of ``m`` replaced in order, its separators kept. Names of its own, as ``m`` may be a variable of an outer lambda."""
    so_far = f"length(regexp_replace(substring({m}, 1, nth + 1), '[^0-9]', ''))"
    return f"element_at(transform(array({digits}), fill -> array_join(transform(split({m}, ''), (sign, nth) -> if(sign rlike '[0-9]', substring(fill, {so_far}, 1), sign)), '')), 1)"


def _luhn_sum(digits: str, from_right: int) -> str:
    """Sum of digits where every second one counts double, the last one standing at place ``from_right`` from the right."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, j) -> if((j + {from_right}) % 2 = 1, int(c) * 2 - if(int(c) > 4, 9, 0), int(c))), 0, (s, x) -> s + x)"


def _mod97(s: str) -> str:
    return f"aggregate(split({s}, ''), 0, (r, c) -> if(c rlike '[0-9]', (r * 10 + int(c)) % 97, (r * 100 + ascii(c) - 55) % 97))"


def _cards(m: str, card: str) -> str:
    """SQL for a run of digit groups with its cards replaced by ``card`` of c, and their number."""
    luhn = f"c -> {_luhn_sum(_digits('c'), 0)} % 10 = 0 and c rlike '[1-9]'"
    laid_out = ", ".join(f"regexp_extract_all({m}, {_quoted(rf'(?<!\d)(?=({p})(?!\d))\d')}, 1)" for p in CARD_LAYOUTS)
    # Candidates may overlap, so each is tried by itself; those that pass are then replaced from left to right.
    valid = f"filter(array_distinct(concat({laid_out})), {luhn})"
    valid = f"element_at(transform(array({valid}), v -> if(size(v) > 0, v, filter(array_distinct(regexp_extract_all({m}, {_quoted(ANY_CARD)}, 0)), {luhn}))), 1)"
    pattern = "concat('(?<![0-9])(?:', array_join(v, '|'), ')(?![0-9])')"
    new = f"transform(regexp_extract_all({m}, p, 0), c -> {card})"
    joined = f"transform(array({new}), w -> named_struct('s', array_join(transform(split({m}, p, -1), (s, i) -> concat(s, coalesce(get(w, i), ''))), ''), 'n', size(w)))"
    changed = f"element_at(flatten(transform(array({pattern}), p -> {joined})), 1)"
    return f"element_at(transform(array({valid}), v -> if(size(v) > 0, {changed}, named_struct('s', {m}, 'n', 0))), 1)"


def _replacement(m: str, key: str) -> str:
    """SQL for a match's pseudonym and how many values it replaces; a match that fails validation stays."""
    local, host = f"substring_index({m}, '@', 1)", f"substring({m}, instr({m}, '@'), length({m}))"
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    ip = permuted_number(f"aggregate({octets}, 0L, (s, o) -> s * 256 + o)", 65536, 65536, key, "ip")
    dotted = f"element_at(transform(array({ip}), p -> concat_ws('.', p div 16777216, p div 65536 % 256, p div 256 % 256, p % 256)), 1)"
    head = f"regexp_extract({m}, '^[+][0-9]{{1,3}}', 0)"
    phone = f"concat({head}, {_refilled(f'substring({m}, length({head}) + 1, length({m}))', permuted_text(f'substring({_digits(m)}, length({head}), length({m}))', key, 'phone'))})"
    area, group, serial = (f"cast(split({m}, '-')[{i}] as bigint)" for i in range(3))
    # 898 areas (001-899 without 666), 99 groups and 9999 serial numbers.
    ssn = permuted_number(f"((({area}) - if({area} > 666, 2, 1)) * 989901L + ({group} - 1) * 9999L + {serial} - 1)", 898, 989901, key, "ssn")
    ssn = f"element_at(transform(array({ssn}), p -> concat(lpad(p div 989901 + if(p div 989901 >= 665, 2, 1), 3, '0'), '-', lpad(p % 989901 div 9999 + 1, 2, '0'), '-', lpad(p % 9999 + 1, 4, '0'))), 1)"
    # The days of 1900-2099 are 17 * 4297.
    since = lambda d: f"cast(datediff({d}, date'1900-01-01') as bigint)"
    moved = lambda n: permuted_number(n, 17, 4297, key, "date")
    shown = lambda n, form: f"date_format(date_add(date'1900-01-01', cast({n} as int)), '{form}')"
    day = shown(moved(since(f"try_cast({m} as date)")), "yyyy-MM-dd")
    # Day before month wherever that is a date; else month before day, moved on until the day is over 12 again, so that the two never meet.
    parts = [f"substring({m}, {at}, {n})" for at, n in ((1, 2), (4, 2), (7, 4))]
    dmy, mdy = (f"try_cast(concat({parts[2]}, '-', {b}, '-', {a}) as date)" for a, b in ((parts[0], parts[1]), (parts[1], parts[0])))
    over_12 = f"element_at(transform(array({moved('w.d')}), n -> named_struct('d', n, 'ok', day(date_add(date'1900-01-01', cast(n as int))) > 12)), 1)"
    walked = f"aggregate(sequence(1, 64), named_struct('d', {since(mdy)}, 'ok', false), (w, step) -> if(w.ok, w, {over_12}), w -> w.d)"
    slashed = f"case when {dmy} is not null then {shown(moved(since(dmy)), 'dd/MM/yyyy')} when {mdy} is not null then {shown(walked, 'MM/dd/yyyy')} else {m} end"
    slashed = f"replace({slashed}, '/', substring({m}, 3, 1))"
    # The area stays; 800 exchanges from 200 on, and 10,000 lines.
    sign = f"substring({m}, 4, 1)"
    line = permuted_number(f"(cast(substring({m}, 5, 3) as bigint) - 200) * 10000L + cast(substring({m}, 9, 4) as bigint)", 800, 10000, key, "national")
    dashed = f"element_at(transform(array({line}), p -> concat(substring({m}, 1, 4), p div 10000 + 200, {sign}, lpad(p % 10000, 4, '0'))), 1)"
    rest = f"substring({m}, instr({m}, ')') + 1, length({m}))"
    bracketed = f"concat(substring_index({m}, ')', 1), ')', {_refilled(rest, permuted_text(_digits(rest), key, 'bracketed'))})"
    payload = permuted_text(f"substring({_digits('c')}, 1, length({_digits('c')}) - 1)", key, "card")
    card = _refilled("c", f"element_at(transform(array({payload}), p -> concat(p, (10 - {_luhn_sum('p', 1)} % 10) % 10)), 1)")
    plain = f"replace({m}, ' ', '')"
    body = permuted_text(f"substring({plain}, 5, length({plain}))", key, "iban")
    iban = f"element_at(transform(array({body}), b -> concat(substring({plain}, 1, 2), lpad(98 - {_mod97(f'concat(b, substring({plain}, 1, 2), {chr(39)}00{chr(39)})')}, 2, '0'), b)), 1)"
    spaced = f"element_at(transform(array({iban}), d -> array_join(transform(split({m}, ''), (c, j) -> if(c = ' ', c, substring(d, length(replace(substring({m}, 1, j + 1), ' ', '')), 1))), '')), 1)"
    is_ = lambda kind: f"{m} rlike {_quoted('^(?:' + dict(PATTERNS)[kind] + ')$')}"
    one = f"""case when {m} like '%@%' then concat({permuted_text(local, key, 'email')}, {host})
        when {is_('key')} then concat('AKIA', {permuted_text(f'substring({m}, 5, 16)', key, 'key')})
        when {is_('hex')} then {permuted_text(m, key, 'hex', 6)}
        when {is_('ip')} then if(forall({octets}, o -> o <= 255), {dotted}, {m})
        when {is_('phone')} then {phone}
        when {is_('national')} then if({m} like '(%', {bracketed}, {dashed})
        when {is_('slashed')} then {slashed}
        when {is_('ssn')} then if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {ssn}, {m})
        when {is_('date')} then if(try_cast({m} as date) between date'1900-01-01' and date'2099-12-31', {day}, {m})
        when {is_('iban')} then if({_mod97(f'concat(substring({plain}, 5, length({plain})), substring({plain}, 1, 4))')} = 1, {spaced}, {m})
        else {m} end"""
    one = f"element_at(transform(array({one}), o -> named_struct('s', o, 'n', if(o = {m}, 0, 1))), 1)"
    others = " or ".join(is_(k) for k in ("ip", "ssn", "date", "national"))
    return f"if({is_('card')} and not ({others}), {_cards(m, card)}, {one})"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by pseudonyms of the same format, and n_pseudonyms.

    Email names, phone numbers (country or area code kept), payment cards (Luhn), IBANs (mod 97), IPv4 addresses, social security numbers,
    dates of 1900-2099 (ISO; 31/12/1980 and 31.12.1980, month first only where that alone is a date), access keys and 40-digit hex tokens
    that pass their validation are permuted under ``key`` by eight Feistel rounds within their format, so equal values give equal pseudonyms
    in all documents and different values different ones; numbers that fail validation stay. The key is a one-row relation and so in no
    plan's text. Null text stays null with 0 pseudonyms, other columns stay, and n_pseudonyms replaces an input column of that name.
    Rows are independent of each other.
    """
    docs = docs.drop("n_pseudonyms")
    found, new, own_key = (_unused(name, docs.columns) for name in ("found", "new", "key"))
    pattern = _quoted(ANY)
    secret = docs.sparkSession.sql("SELECT k FROM VALUES (:k) AS t(k)", args={"k": key}).scalar()
    rows = docs.withColumn(found, F.expr(f"if(text rlike {_quoted(MAYBE)}, regexp_extract_all(text, {pattern}, 0), array())")).withColumn(own_key, secret)
    rows = rows.withColumn(new, F.expr(f"transform({found}, m -> {_replacement('m', own_key)})"))
    joined = f"if(size({found}) > 0, array_join(transform(split(text, {pattern}, -1), (s, i) -> concat(s, coalesce(get({new}, i).s, ''))), ''), text)"
    changed = f"coalesce(aggregate({new}, 0L, (s, x) -> s + x.n), 0L)"
    return rows.withColumn("n_pseudonyms", F.expr(changed)).withColumn("text", F.expr(joined)).select(*docs.columns, "n_pseudonyms")


def _unused(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
