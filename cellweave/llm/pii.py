"""Format-preserving pseudonyms for personal data, with built-in functions only.

One regular expression finds candidates; a validator for each kind decides. Payment numbers (Luhn, and first digits and length of a
card network), phone numbers, social security numbers, IPv4 addresses and dates are permuted by a keyed alternating Feistel network
inside their own format: the result is again a valid value of the same kind (a card keeps its first four digits), and since the permutation is keyed but not salted, equal values stay linked
across documents. E-mail addresses and secrets (hex or base-62 strings after a key-like name, and access keys) get a keyed digest in their form.
Candidates that fail validation (numbers with a wrong check digit or of no card network, impossible dates) are left as they are.

The key is a parameter or the session's setting ``spark.cellweave.pii.key``; without either the operator refuses to work, since
whoever has the key can undo the pseudonyms. Spark shows literals in plans: cover the key with ``spark.redaction.string.regex``.

Defined results: a null text stays null with no findings; the empty text stays empty; texts without a digit or an at-sign are
passed through after one cheap scan. Dates from 1900 to 2099-11-12 are permuted among themselves, all earlier and later ones among
themselves; from June of the year 9996 on (such as 9999-12-31, which stands for no date) they are left as they are. Repeated rows are
treated alike, other columns are carried through untouched. Every pattern starts at a border and reads on without going back, so
a text of one long run of letters or digits takes time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_SETTING = "spark.cellweave.pii.key"
#: Of the registered queries and tests where the setting is missing; public, so no protection.
PUBLIC_KEY = "cellweave-development-key"
ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+(?<=[A-Za-z0-9])@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?<=(?i:token|secret|passwd|password|api_key|apikey|access_key)\x20?[=:]\x20?[\"']?)[A-Za-z0-9_\-]{16,}"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<!\w)\+\d{1,3} ?\(\d{2,4}\) ?\d{3,4}[ -]?\d{3,4}(?![\w-]|\.\d)|(?<!\w)\+\d{1,3}(?:[ -]\d{1,4}){2,5}(?![\w-]|\.\d)|(?<!\w)\+\d{8,15}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])"
#: One run of digits, groups of four, or 4-6-5; a number beside a card number is none of its groups.
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?![\w-])"
#: First four digits and lengths of the numbers that card networks issue (ISO/IEC 7812). One random number in ten has a
#: right Luhn digit, so that digit alone proves little.
NETWORKS = (
    (r"1\d\d\d", (15,)),  # UATP
    (r"220[0-4]", (16, 17, 18, 19)),  # Mir
    (r"222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720|5[1-5]\d\d", (16,)),  # Mastercard
    (r"3[47]\d\d", (15,)),  # American Express
    (r"30[0-5]\d|3095|36\d\d|3[89]\d\d", (14, 15, 16, 17, 18, 19)),  # Diners Club
    (r"352[89]|35[3-8]\d", (16, 17, 18, 19)),  # JCB
    (r"4\d\d\d", (13, 16, 19)),  # Visa
    (r"50\d\d|5[6-8]\d\d|6\d\d\d", (13, 14, 15, 16, 17, 18, 19)),  # Maestro, Discover, UnionPay, RuPay
    (r"8[12]\d\d|8600|9792|9860", (16, 17, 18, 19)),  # UnionPay, RuPay, Uzcard, Troy, Humo
)
HEAD = 4
ISSUED = "^(?:" + "|".join(rf"(?:{head})\d{{{n - HEAD}}}" for head, lengths in NETWORKS for n in lengths) + ")$"
ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
ANY = "|".join((EMAIL, SECRET, ACCESS_KEY, IP, DATE, SSN, PHONE, CARD))

#: Days in two ranges, each of a product of two factors, as the network needs: from 1900-01-01 on, and all others from 0001-01-01 on.
FIRST_DAY, RECENT_DAY = "0001-01-01", "1900-01-01"
RECENT, OTHERS = (250, 292), (1891, 1892)
#: Numbers of areas (001 to 899 without 666) with groups (01 to 99), and of serials (0001 to 9999).
AREAS_GROUPS, SERIALS = 898 * 99, 9999


def key_of(spark, default: str | None = None) -> str:
    """The session's key; ``default`` is for queries that must run without one."""
    key = spark.conf.get(KEY_SETTING, None) or default
    if not key:
        raise ValueError(f"set {KEY_SETTING}, or give a key")
    return key


def _prf(key: str, label: Column, i: Column, x: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), label, i.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(u: Column, v: Column, a: Column, b: Column, key: str, label: Column, inverse: bool = False) -> Column:
    """Permutes (u, v) of Z_a x Z_b: rounds add a keyed function of one half to the other, modulo its size; struct(u, v)."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    sign = -1 if inverse else 1

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["u"] + sign * F.pmod(_prf(key, label, i, s["v"]), a), a)
        right = F.pmod(s["v"] + sign * F.pmod(_prf(key, label, i, s["u"]), b), b)
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(s["u"]).alias("u"), F.when(odd, s["v"]).otherwise(right).alias("v"))

    return F.aggregate(rounds, F.struct(u.cast("long").alias("u"), v.cast("long").alias("v")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """Permutes decimal strings of 2 to 36 digits among those of their length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    u, v = F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n).cast("long")
    out = F.transform(F.array(feistel(u, v, _power(left), _power(n - left), key, F.concat(F.lit(kind), n.cast("string")), inverse)), lambda s: F.concat(F.lpad(s["u"].cast("string"), left, "0"), F.lpad(s["v"].cast("string"), n - left, "0")))
    return out[0]


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number without its check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def luhn_valid(x: Column) -> Column:
    d = _only_digits(x)
    return F.right(d, F.lit(1)) == _check_digit(F.substring(d, F.lit(1), F.length(d) - 1))


def card_valid(x: Column) -> Column:
    """Issued by a card network, and with a right check digit."""
    return _only_digits(x).rlike(ISSUED) & luhn_valid(x)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits put into the places that digits have in ``shape``."""
    zero = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), zero, step, lambda a: a["s"])


def mask_card(x: Column, key: str, inverse: bool = False) -> Column:
    """Keeps the first four digits, which with the length name the network, permutes the others and sets the check digit anew."""
    d = _only_digits(x)
    body = F.concat(F.substring(d, 1, HEAD), permute_digits(F.substring(d, F.lit(HEAD + 1), F.length(d) - HEAD - 1), key, "card", inverse))
    return F.transform(F.array(body), lambda b: _refill(x, F.concat(b, _check_digit(b))))[0]


def mask_phone(x: Column, key: str, inverse: bool = False) -> Column:
    """Keeps a country code and permutes the other digits."""
    code = F.regexp_extract(x, r"^\+\d{1,3}(?=[ (-])", 0)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    return F.concat(code, _refill(rest, permute_digits(_only_digits(rest), key, "phone", inverse)))


def mask_ssn(x: Column, key: str, inverse: bool = False) -> Column:
    """Permutes the valid numbers alone: area and group make one half of the network, the serial the other."""
    d = _only_digits(x)
    area, group, serial = (F.substring(d, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    s = feistel(place * 99 + group - 1, serial - 1, F.lit(AREAS_GROUPS).cast("long"), F.lit(SERIALS).cast("long"), key, F.lit("ssn"), inverse)

    def written(s: Column) -> Column:
        place = F.floor(s["u"] / 99)
        parts = ((place + F.when(place >= 665, 2).otherwise(1), 3), (s["u"] % 99 + 1, 2), (s["v"] + 1, 4))
        return F.concat(*(F.lpad(n.cast("string"), k, "0") for n, k in parts))

    return F.transform(F.array(s), lambda s: _refill(x, written(s)))[0]


def mask_ip(x: Column, key: str, inverse: bool = False) -> Column:
    o = F.split(x, r"\.")
    half = lambda i: o[i].cast("long") * 256 + o[i + 1].cast("long")
    s = feistel(half(0), half(2), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"), inverse)
    octets = lambda h: F.concat_ws(".", F.floor(h / 256).cast("string"), (h % 256).cast("string"))
    return F.transform(F.array(s), lambda s: F.concat_ws(".", octets(s["u"]), octets(s["v"])))[0]


def _date(x: Column) -> Column:
    iso = F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(x.rlike(r"^\d{4}-"), iso).otherwise(F.try_to_timestamp(F.regexp_replace(x, "/", "."), F.lit("dd.MM.yyyy")).cast("date"))


def _days(x: Column) -> tuple[Column, Column]:
    """(days from 1900-01-01, place among all days that are not in the recent range)."""
    recent = F.datediff(_date(x), F.lit(RECENT_DAY).cast("date")).cast("long")
    day = F.datediff(_date(x), F.lit(FIRST_DAY).cast("date")).cast("long")
    return recent, F.when(recent < 0, day).otherwise(day - RECENT[0] * RECENT[1])


def _in_recent(recent: Column) -> Column:
    return (recent >= 0) & (recent < RECENT[0] * RECENT[1])


def mask_date(x: Column, key: str, inverse: bool = False) -> Column:
    recent, place = _days(x)
    before = F.datediff(F.lit(RECENT_DAY).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")

    def permuted(n: Column, factors: tuple[int, int], label: str) -> Column:
        a, b = factors
        s = feistel(F.floor(n / b), n % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, F.lit(label), inverse)
        return F.transform(F.array(s), lambda s: s["u"] * b + s["v"])[0]

    other = F.transform(F.array(permuted(place, OTHERS, "other date")), lambda n: n + F.when(n >= before, RECENT[0] * RECENT[1]).otherwise(0))[0]
    day = F.when(_in_recent(recent), before + permuted(recent, RECENT, "date")).otherwise(other)
    style = lambda d: F.when(x.rlike(r"^\d{4}-"), F.date_format(d, "yyyy-MM-dd")).when(x.contains("/"), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return F.transform(F.array(day), lambda n: style(F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))))[0]


def _date_valid(x: Column) -> Column:
    recent, place = _days(x)
    return F.coalesce(_in_recent(recent) | ((place >= 0) & (place < OTHERS[0] * OTHERS[1])), F.lit(False))


def mask_email(x: Column, key: str) -> Column:
    """Marks before the address are no part of it and stay."""
    marks = F.regexp_extract(x, r"^[._%+-]*", 0)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(F.substring(x, F.length(marks) + 1, F.length(x)))), 256)
    return F.concat(marks, F.lit("u"), F.substring(digest, 1, 16), F.lit("@masked.invalid"))


def mask_secret(x: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(x)), 256)
    long = F.substring(F.repeat(digest, F.ceil(F.length(x) / 64).cast("int")), F.lit(1), F.length(x))
    return F.when(x == F.upper(x), F.upper(long)).otherwise(long)


def kind_of(x: Column) -> Column:
    """The kind of a candidate, null if it does not validate."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    n = F.length(_only_digits(x))
    return (
        F.when(x.contains("@"), "email")
        .when(whole(IP), "ip")
        .when(whole(DATE), F.when(_date_valid(x), "date"))
        .when(whole(SSN), F.when(~x.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole(PHONE) & (n >= 8) & (n <= 15), "phone")
        .when(whole(CARD), F.when(card_valid(x), "card"))
        .when(x.rlike("[A-Za-z_]") & (F.length(x) >= 16), "secret")
    )


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", mask_email(x, key))
        .when(kind == "secret", mask_secret(x, key))
        .when(kind == "ip", mask_ip(x, key))
        .when(kind == "date", mask_date(x, key))
        .when(kind == "ssn", mask_ssn(x, key))
        .when(kind == "phone", mask_phone(x, key))
        .when(kind == "card", mask_card(x, key))
        .otherwise(x)
    )


def pseudonymize(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Replaces the text and adds ``n_masked`` and ``kinds`` (the kinds found, sorted). Without a key the session's is taken."""
    key = key or key_of(docs.sparkSession)
    carried = [c for c in docs.columns if c not in ("n_masked", "kinds")]
    some = F.coalesce(F.col(text).rlike("[0-9@]|(?i:token|secret|passw|key)|A[KS]IA"), F.lit(False))
    none = F.array().cast("array<string>")
    found = docs.select(*carried, F.when(some, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(none).alias("__m"))
    found = found.withColumn("__k", F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))
    found = found.withColumn("__k", F.transform("__k", lambda x: F.struct(x["k"].alias("k"), pseudonym(x["m"], x["k"], key).alias("p"))))
    pieces = F.split(F.col(text), ANY, -1)
    whole = F.array_join(F.zip_with(pieces, F.transform("__k", lambda x: x["p"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.filter(F.transform("__k", lambda x: x["k"]), lambda k: k.isNotNull())
    out = [F.when(F.size("__m") > 0, whole).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in carried]
    return found.select(*out, F.size(kinds).cast("long").alias("n_masked"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))
