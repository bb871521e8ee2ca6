"""Format-preserving pseudonyms for personal data (operator 10), DataFrame functions only.

Numbers and dates are found by pattern, validated, and permuted by a keyed Feistel network within
their own format, so that equal values get equal pseudonyms in every document and different values
never share one:

* card numbers (13 to 19 digits, known first digit, Luhn): digits between the first and the check
  digit are permuted, the check digit is computed anew;
* telephone numbers: the last ten digits (all but the first after ``+``), punctuation kept;
* social security numbers: permuted among the valid ones;
* IPv4 addresses with octets up to 255: permuted among all addresses;
* calendar dates of 1800 to 2199 (``2024-05-31``, ``2024/05/31``, ``31.05.2024``, ``05/31/2024``):
  permuted among the days of these 400 years;
* mail addresses (part before ``@``) and quoted or assigned secrets: permuted character by character
  within lower-case letters, capitals, digits, or hexadecimal digits if there is nothing else.

Whatever fails its validation stays as it is. Each row is rewritten on its own: no shuffle, no join.
Defined results: a null text stays null with nothing found; repeated rows give repeated results; an empty table gives
an empty result; texts and secrets may be of any length; other columns, of whatever name, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import spare, table

#: What ``key_of`` falls back to: links values, but hides them from nobody who has this file. A deployment sets its own.
DEMO_KEY = "2f8e1c57a90b4d63"
#: Rounds of each Feistel network.
ROUNDS = 10
#: 400 years from here: 146,097 days, which is 189 * 773.
FIRST_DAY, DAYS, DAYS_A, DAYS_B = "1800-01-01", 146097, 189, 773

CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{5})(?![\p{L}\p{N}])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{3,4}){1,2}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
IPV4 = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
DATE = r"(?<![\p{L}\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{L}\p{N}/-]|\.\d)"
# A domain has at most 127 labels of at most 63 characters: bounded repeats, so no text can exhaust the regex stack.
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
SECRET = r"""(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9+/_.-]{8,}"""
ANY = "|".join([SECRET, MAIL, DATE, SSN, IPV4, PHONE, CARD])
#: A text without any of these holds nothing of the above: each number but an address of single digits has two digits side by side.
GATE = r"[0-9]\.?[0-9]|@|(?i:token|secret|passw(?:or)?d|key)[\"']?\s{0,3}[=:]"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, *parts: str) -> str:
    return f"sha2(concat_ws('|', {_lit(key)}, {', '.join(parts)}), 256)"


def _by_char(x: str, key: str, kind: str) -> str:
    """SQL for a Feistel network over the halves of string ``x``: each character moves within its class.

    Halves are arrays of characters. A round takes one digest of the other half and one of that for each
    twelve characters, so the work grows with the length of ``x``, whatever it is.
    """
    hexa = f"({x} rlike '^[0-9a-f]+$' AND {x} rlike '[a-f]')"

    def within(alphabet: str) -> str:
        n = len(alphabet)
        return f"substr('{alphabet}', 1 + (instr('{alphabet}', c) - 1 + y) % {n}, 1)"

    one = (
        f"CASE WHEN s.h AND c rlike '[0-9a-f]' THEN {within('0123456789abcdef')} WHEN c rlike '[0-9]' THEN {within('0123456789')} "
        f"WHEN c rlike '[a-z]' THEN {within('abcdefghijklmnopqrstuvwxyz')} WHEN c rlike '[A-Z]' THEN {within('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} ELSE c END"
    )

    def moved(half: str, other: str) -> str:
        twelve = f"transform(slice({half}, 12 * j + 1, 12), (c, q) -> {_let('y', 'cast(conv(substr(e, 1 + 5 * q, 5), 16, 10) AS int)', one)})"
        parts = f"flatten(transform(sequence(0, (size({half}) - 1) div 12), j -> {_let('e', 'sha2(concat(o, j), 256)', twelve)}))"
        whole = f"array_join({other}, '')"
        return f"CASE WHEN size({half}) = 0 THEN {half} ELSE {_let('o', _hash(key, repr(kind), 's.i', whole), parts)} END"

    def chars(part: str) -> str:
        return f"filter(split({part}, ''), c -> c <> '')"

    start = f"named_struct('l', {chars(f'substr({x}, 1, length({x}) div 2)')}, 'r', {chars(f'substr({x}, 1 + length({x}) div 2)')}, 'i', 1, 'h', {hexa})"
    step = f"CASE WHEN s.i % 2 = 1 THEN named_struct('l', {moved('s.l', 's.r')}, 'r', s.r, 'i', s.i + 1, 'h', s.h) ELSE named_struct('l', s.l, 'r', {moved('s.r', 's.l')}, 'i', s.i + 1, 'h', s.h) END"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, k) -> {step}, s -> concat(array_join(s.l, ''), array_join(s.r, '')))"


def _by_number(v: str, a: int, b: int, key: str, kind: str) -> str:
    """SQL for a Feistel network over 0 .. a * b - 1."""

    def f(x: str) -> str:
        return f"cast(conv(substr({_hash(key, repr(kind), 's.i', x)}, 1, 14), 16, 10) AS bigint)"

    start = f"named_struct('l', cast(({v}) div {b} AS bigint), 'r', cast(({v}) % {b} AS bigint), 'i', 1)"
    step = f"CASE WHEN s.i % 2 = 1 THEN named_struct('l', (s.l + {f('s.r')}) % {a}L, 'r', s.r, 'i', s.i + 1) ELSE named_struct('l', s.l, 'r', (s.r + {f('s.l')}) % {b}L, 'i', s.i + 1) END"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, k) -> {step}, s -> s.l * {b}L + s.r)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _let(name: str, value: str, body: str) -> str:
    """Bind a value once: the only element of a one-element array."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _luhn(ds: str) -> str:
    """Sum by Luhn, the last digit counting once."""
    d = f"cast(substr({ds}, length({ds}) + 1 - q, 1) AS int)"
    return f"aggregate(sequence(1, length({ds})), 0, (t, q) -> t + CASE WHEN q % 2 = 1 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"


def _refill(m: str, ds: str) -> str:
    """Put digits ``ds`` in the places of the digits of ``m``."""
    return (
        f"aggregate(sequence(1, length({m})), named_struct('o', '', 'k', 1), (u, p) -> CASE WHEN substr({m}, p, 1) rlike '[0-9]' "
        f"THEN named_struct('o', concat(u.o, substr({ds}, u.k, 1)), 'k', u.k + 1) ELSE named_struct('o', concat(u.o, substr({m}, p, 1)), 'k', u.k) END, u -> u.o)"
    )


def _pseudonym(key: str) -> str:
    """SQL for the pseudonym of match ``m``: itself where validation fails."""
    card_new = _let("w", f"concat(substr(d, 1, 1), {_by_char('substr(d, 2, length(d) - 2)', key, 'card')})", f"concat(w, cast((10 - {_luhn('concat(w, ' + _lit('0') + ')')} % 10) % 10 AS string))")
    card = _let("d", _digits("m"), f"CASE WHEN d rlike '^(?:[3-6]|2[2-7])' AND {_luhn('d')} % 10 = 0 THEN {_let('n', card_new, _refill('m', 'n'))} ELSE m END")
    phone_keep = "CASE WHEN m LIKE '+%' THEN greatest(1, length(d) - 10) ELSE 0 END"
    phone = _let("d", _digits("m"), _let("g", phone_keep, _let("n", f"concat(substr(d, 1, g), {_by_char('substr(d, g + 1)', key, 'phone')})", _refill("m", "n"))))
    ssn_new = _let(
        "v", _by_number("((a - 1 - CASE WHEN a > 666 THEN 1 ELSE 0 END) * 99 + b - 1) * 9999 + c - 1", 88902, 9999, key, "ssn"),
        "concat_ws('-', lpad(cast(v div 989901 + 1 + CASE WHEN v div 989901 + 1 >= 666 THEN 1 ELSE 0 END AS string), 3, '0'), lpad(cast(v div 9999 % 99 + 1 AS string), 2, '0'), lpad(cast(v % 9999 + 1 AS string), 4, '0'))",
    )
    ssn = _let("a", "cast(substr(m, 1, 3) AS bigint)", _let("b", "cast(substr(m, 5, 2) AS bigint)", _let("c", "cast(substr(m, 8, 4) AS bigint)", f"CASE WHEN a BETWEEN 1 AND 899 AND a <> 666 AND b > 0 AND c > 0 THEN {ssn_new} ELSE m END")))
    ip_new = _let("v", _by_number("((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]", 65536, 65536, key, "ip"), "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)")
    ip = _let("o", "transform(split(m, '[.]'), z -> cast(z AS bigint))", f"CASE WHEN array_max(o) <= 255 THEN {ip_new} ELSE m END")
    day = "try_to_date(m, {0})"
    dates = []
    for like, pattern in (("____-%", "yyyy-MM-dd"), ("____/%", "yyyy/MM/dd"), ("__.%", "dd.MM.yyyy"), ("__/%", "MM/dd/yyyy")):
        new = _let("v", _by_number(f"datediff(y, date'{FIRST_DAY}')", DAYS_A, DAYS_B, key, "date"), f"date_format(date_add(date'{FIRST_DAY}', cast(v AS int)), '{pattern}')")
        dates.append(f"WHEN m LIKE '{like}' THEN {_let('y', day.format(repr(pattern)), f'CASE WHEN datediff(y, date{FIRST_DAY!r}) BETWEEN 0 AND {DAYS - 1} THEN {new} ELSE m END')}")
    date = f"CASE {' '.join(dates)} ELSE m END"
    mail = _let("x", "substring_index(m, '@', 1)", f"concat({_by_char('x', key, 'mail')}, substr(m, length(x) + 1))")
    value = _lit(r"[A-Za-z0-9+/_.-]{8,}$")
    secret = _let("x", f"regexp_substr(m, {value})", f"concat(substr(m, 1, length(m) - length(x)), {_by_char('x', key, 'secret')})")
    return (
        f"CASE WHEN m rlike '[=:]' THEN {secret} WHEN m LIKE '%@%' THEN {mail} "
        rf"WHEN m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' AND length(replace(m, '.', '')) = length(m) - 3 THEN {ip} "
        rf"WHEN m rlike '^([0-9]{{4}}([-/])[0-9]{{2}}[-/][0-9]{{2}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})$' THEN {date} "
        rf"WHEN m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {ssn} "
        rf"WHEN m rlike '^[+(]|^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$' THEN {phone} ELSE {card} END"
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``into``: the (value as found, pseudonym) pairs that differ.

    A column that has the name ``into`` already is replaced by it.
    """
    found_, new_ = spare([*docs.columns, into], "_found", "_new")
    t, quoted = F.col(text).cast("string"), f"`{new_}`"
    may = F.coalesce(t.rlike(GATE), F.lit(False))
    found = F.when(may, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn(found_, found)
    rows = rows.withColumn(new_, F.expr(f"transform(`{found_}`, m -> {_pseudonym(key)})"))
    between = F.split(t, ANY, -1)
    spliced = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found_)), F.col(quoted), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    rows = rows.withColumn(text, F.when(F.size(found_) > 0, spliced).otherwise(t))
    pairs = F.arrays_zip(F.col(found_).alias("value"), F.col(new_).alias("pseudonym"))
    return rows.withColumn(into, F.filter(pairs, lambda p: p["value"] != p["pseudonym"])).drop(found_, new_)


def without_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms, the same columns; ``n_chars``, where there is one, follows the text."""
    own = list(docs.columns)
    out = pseudonymised(docs, key, into=spare(own, "_pii")[0])
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in own])


def key_of(spark: SparkSession) -> str:
    """The secret of this deployment: the session's ``spark.pointloom.pii.key``; without it, the public demonstration key."""
    return spark.conf.get("spark.pointloom.pii.key", DEMO_KEY)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"))

