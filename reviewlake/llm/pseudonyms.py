"""Personal data replaced by format-preserving Feistel pseudonyms, in SQL expressions only.

Values are found by one pattern, validated (Luhn, IBAN remainder, number ranges, calendar), and permuted under a key
within their own format, so equal values get equal pseudonyms in all documents, and different values different ones:

* e-mail: letters and digits of the local part, and of the domain without its last label, keep their kind and place;
* card (13 to 19 digits, plain or in usual groups): all digits but the last are permuted, the check digit follows;
* IBAN: the account part is permuted, country and separators stay, the check digits follow;
* phone (+country (area) number, or (area) number): all digits after the country code;
* social security number: over all valid areas, groups and serials;
* IPv4 address: over all 2 ** 32 addresses;
* date (yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy, else mm/dd/yyyy), 1900 to 2099: over all days of that range.

A value that fails its validation is no personal data and stays.  A Feistel network swaps two halves over ROUNDS rounds
and adds a keyed hash of one half to the other, modulo the size of its range; that is a permutation for any hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY_SETTING = "spark.reviewlake.pseudonyms.key"
DEFAULT_KEY = "reviewlake"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
             r"|(?<![0-9])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])",
}
PATTERN = "|".join(PATTERNS.values())
_WHOLE = {kind: f"^(?:{p})$".replace(r"\2", r"\1").replace(r"\3", r"\2") for kind, p in PATTERNS.items()}
_DAYS = (17, 4297)  # days of 1900 to 2099
_SSN = (898 * 99, 9999)


def _hash(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _shifted(s: Column, tag: Column) -> Column:
    """Each letter and digit moved on within its kind by a keyed amount; other characters stay."""
    def moved(c: Column, i: Column) -> Column:
        amount = F.conv(F.substr(_hash(tag, F.floor(i / 15).cast("string")), (i % 15) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        within = lambda first, n: F.char((F.ascii(c) - first + amount) % n + first)
        return (F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26))
                .when(c.between("A", "Z"), within(65, 26)).otherwise(c))
    return F.array_join(F.transform(_chars(s), moved), "")


def _rounds() -> Column:
    return F.sequence(F.lit(1), F.lit(ROUNDS))


def permuted_text(s: Column, key: Column) -> Column:
    """Feistel over the two halves of a string; kinds and places of the characters stay."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    step = lambda h, n: F.struct(
        h["r"].alias("l"), _shifted(h["l"], F.concat_ws("|", key, n.cast("string"), h["r"])).alias("r"))
    return F.aggregate(_rounds(), start, step, lambda h: F.concat(h["l"], h["r"]))


def permuted_number(n: Column, key: Column, sizes: tuple[int, int]) -> Column:
    """Feistel over 0 .. sizes[0] * sizes[1] - 1: quotient and remainder take turns."""
    a, b = sizes
    number = lambda h, r, tag: F.conv(F.substr(_hash(key, r.cast("string"), h.cast("string"), F.lit(tag)),
                                               F.lit(1), F.lit(12)), 16, 10).cast("long")
    start = F.struct(F.floor(n / b).cast("long").alias("l"), F.pmod(n, F.lit(b)).cast("long").alias("r"))
    step = lambda h, r: F.struct(
        F.when(r % 2 == 1, (h["l"] + number(h["r"], r, "l")) % a).otherwise(h["l"]).alias("l"),
        F.when(r % 2 == 0, (h["r"] + number(h["l"], r, "r")) % b).otherwise(h["r"]).alias("r"))
    return F.aggregate(_rounds(), start, step, lambda h: h["l"] * b + h["r"])


def _laid_out(form: Column, digits: Column) -> Column:
    """The digits put in the places of the digits of ``form``."""
    place = lambda c, i: F.when(
        c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(_chars(form), place), "")


def _luhn_sum(payload: Column) -> Column:
    """Luhn sum of the digits in front of a check digit."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(
        c.cast("int"))
    return F.aggregate(F.transform(F.reverse(_chars(payload)), value), F.lit(0), lambda a, x: a + x)


def _luhn_digit(payload: Column) -> Column:
    return ((10 - _luhn_sum(payload) % 10) % 10).cast("string")


def _mod97(compact: Column) -> Column:
    """Remainder of an IBAN whose first four characters go last, letters counting from A = 10."""
    turned = F.concat(F.substr(compact, F.lit(5), F.length(compact)), F.substr(compact, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise(
        (a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(turned), F.lit(0), step)


def _day(x: Column) -> Column:
    """Days since 1900-01-01 of a date in one of the formats, else null."""
    iso = F.try_to_date(x, "yyyy-MM-dd")
    plain = F.regexp_replace(x, "[.]", "/")
    day = F.coalesce(F.when(x.rlike("^[0-9]{4}"), iso), F.when(x.rlike("[0-9]{4}$"), F.try_to_date(plain, "dd/MM/yyyy")),
                     F.when(x.rlike("/[0-9]{4}$"), F.try_to_date(plain, "MM/dd/yyyy")))
    return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")),
                  F.datediff(day, F.lit("1900-01-01").cast("date")))


def kind_of(x: Column) -> Column:
    """Kind of a found value, null if it fails its validation."""
    is_ = lambda kind: x.rlike(_WHOLE[kind])
    compact, digits = F.regexp_replace(x, " ", ""), _digits(x)
    ssn_ok = ~x.rlike("^(?:000|666|9)|-00-|-0000$")
    return (
        F.when(is_("email"), F.lit("email"))
        .when(is_("iban") & F.length(compact).between(15, 34) & (_mod97(compact) == 1), F.lit("iban"))
        .when(is_("date") & _day(x).isNotNull(), F.lit("date"))
        .when(is_("ip"), F.lit("ip"))
        .when(is_("ssn") & ssn_ok, F.lit("ssn"))
        .when(is_("card") & (_luhn_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1)))
              & ~digits.rlike("^0+$"), F.lit("card"))
        .when(is_("phone") & F.length(digits).between(7, 15), F.lit("phone")))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind."""
    tagged = lambda name: F.lit(f"{key}|{name}")
    at = F.instr(x, "@")
    domain = F.substr(x, at + 1, F.length(x))
    name, last = F.regexp_replace(domain, r"\.[A-Za-z]+$", ""), F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    email = F.concat(permuted_text(F.substr(x, F.lit(1), at - 1), F.concat(tagged("email|"), domain)), F.lit("@"),
                     permuted_text(name, tagged("domain")), last)
    digits = _digits(x)
    payload = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), tagged("card"))
    card = _laid_out(x, F.concat(payload, _luhn_digit(payload)))
    compact = F.regexp_replace(x, " ", "")
    country = F.substr(compact, F.lit(1), F.lit(2))
    account = permuted_text(F.substr(compact, F.lit(5), F.length(compact)), F.concat(tagged("iban|"), country))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    made = F.concat(country, check, account)
    iban = F.array_join(F.transform(_chars(x), lambda c, i: F.when(c == " ", c).otherwise(
        F.substr(made, F.length(F.regexp_replace(F.substr(x, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    code = F.regexp_extract(x, r"^\+[0-9]{1,3}", 0)
    rest = F.substr(x, F.length(code) + 1, F.length(x))
    phone = F.concat(code, _laid_out(rest, permuted_text(_digits(rest), F.concat(tagged("phone|"), code))))
    area, group, serial = (F.substr(x, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    spot = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * _SSN[1] + serial - 1
    ssn = F.transform(F.array(permuted_number(spot, tagged("ssn"), _SSN)), lambda n: F.concat(
        F.lpad(F.transform(F.array(F.floor(n / (99 * _SSN[1]))), lambda a: F.when(a >= 665, a + 2).otherwise(a + 1))[0].cast("string"), 3, "0"),
        F.lit("-"), F.lpad((F.floor(n / _SSN[1]) % 99 + 1).cast("string"), 2, "0"),
        F.lit("-"), F.lpad((n % _SSN[1] + 1).cast("string"), 4, "0")))[0]
    octets = F.split(x, "[.]")
    address = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    ip = F.transform(F.array(permuted_number(address, tagged("ip"), (65536, 65536))), lambda n: F.concat_ws(
        ".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)]))[0]
    day = F.date_add(F.lit("1900-01-01").cast("date"), permuted_number(_day(x).cast("long"), tagged("date"), _DAYS).cast("int"))
    plain = F.regexp_replace(x, "[.]", "/")
    form = lambda f: F.date_format(day, f)
    date = (F.when(x.rlike("^[0-9]{4}"), form("yyyy-MM-dd")).when(x.contains("."), form("dd.MM.yyyy"))
            .when(F.try_to_date(plain, "dd/MM/yyyy").isNotNull(), form("dd/MM/yyyy")).otherwise(form("MM/dd/yyyy")))
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip)
            .when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "iban", iban).otherwise(x))


def pseudonymized(docs: DataFrame, text: str = "text", private: str = "private", key: str | None = None) -> DataFrame:
    """The documents with their personal data replaced in ``text``, and the column ``private`` (array of the kinds found).

    Texts are read whole and in one pass; a text without digit and @ costs one scan.  A null text stays null with an
    empty array, an empty text stays empty.  Repeated rows stay repeated.  All other columns are kept as they are; a
    column named like ``private`` is replaced.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, DEFAULT_KEY)
    pattern, t = F.lit(PATTERN), F.col(text)
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform("_found", lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind")))
    swapped = F.transform("_found", lambda v, i: F.concat(
        F.when(v["kind"].isNull(), v["x"]).otherwise(pseudonym(v["x"], v["kind"], key)), F.get("_pieces", i + 1)))
    changed = F.exists("_found", lambda v: v["kind"].isNotNull())
    return (
        docs.drop(private).withColumn("_found", found)
        .withColumn("_found", F.when(F.size("_found") > 0, kinds))
        .withColumn("_pieces", F.when(changed, F.split(t, PATTERN, -1)))
        .withColumn(text, F.when(F.col("_pieces").isNull(), t).otherwise(
            F.concat(F.get("_pieces", F.lit(0)), F.array_join(swapped, ""))))
        .withColumn(private, F.coalesce(F.filter(F.transform("_found", lambda v: v["kind"]), lambda k: k.isNotNull()),
                                        F.array().cast("array<string>")))
        .drop("_found", "_pieces"))
