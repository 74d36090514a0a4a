"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Addresses, numbers and dates are found by pattern and validated (Luhn sum, IBAN remainder, octets, calendar, number
ranges). What passes is permuted within its own format by a keyed Feistel network, so that equal values get equal
pseudonyms in every document, different values different ones, and a pseudonym passes the same validation.
"""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import fresh_name, query, table

ROUNDS = 8
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    "card": r"[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}",
}
ANY = f"{_EDGE}(?:{'|'.join(PATTERNS.values())}){_END}"
#: A cheap look first: an address needs an @, the rest a digit in a place where a number may start.
HINT = r"@|(?<![\p{L}\p{N}])[A-Z(+]{0,2}[0-9]{2}|(?<![\p{L}\p{N}])[0-9]\."

num = lambda c: c.cast("long")


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def draw(key: Column, *parts: Column) -> Column:
    """A whole number below 2^60 from the key and the parts."""
    return num(F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10))


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: Column, tweak: str) -> Column:
    """Permutation of the pairs (left < left_size, right < right_size): a struct of both."""
    start = F.struct(num(left).alias("l"), num(right).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (acc["l"] + draw(key, F.lit(tweak), i, acc["r"]) % left_size) % left_size).otherwise(acc["l"]).alias("l"),
            F.when(odd, acc["r"]).otherwise((acc["r"] + draw(key, F.lit(tweak), i, acc["l"]) % right_size) % right_size).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted_digits(digits: Column, key: Column, tweak: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length (a single digit by its own rotation)."""

    def run(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        rest = F.length(d) - half
        low = F.when(half > 0, num(F.substr(d, F.lit(1), half))).otherwise(F.lit(0).cast("long"))
        size = lambda n: num(F.rpad(F.lit("1"), n + 1, F.lit("0")))
        # the length is part of the round function, so numbers of different lengths have unrelated permutations
        done = feistel(low, num(F.substr(d, half + 1, rest)), size(half), size(rest), F.concat_ws("|", key, F.length(d).cast("string")), tweak)
        return bind(done, lambda p: F.concat(F.when(half > 0, F.lpad(p["l"].cast("string"), half, F.lit("0"))).otherwise(""), F.lpad(p["r"].cast("string"), rest, F.lit("0"))))

    return bind(digits, run)


def permuted_characters(text: Column, key: Column, tweak: str) -> Column:
    """Letters and digits permuted among strings with the same kind of character in each place; other characters stay."""

    def run(s: Column) -> Column:
        codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
        base = lambda c: F.when(c.between(48, 57), 48).when(c.between(97, 122), 97).when(c.between(65, 90), 65).otherwise(c)
        radix = lambda c: F.when(c.between(48, 57), 10).when(c.between(97, 122) | c.between(65, 90), 26).otherwise(1)

        def halves(a: Column) -> Column:
            h = F.floor(F.size(a) / 2).cast("int")
            cut = lambda v: (F.slice(v, F.lit(1), h), F.slice(v, h + 1, F.size(a) - h))
            (cl, cr) = cut(a)
            start = F.struct(F.transform(cl, lambda c: c - base(c)).alias("l"), F.transform(cr, lambda c: c - base(c)).alias("r"))

            def turned(side: Column, other: Column, kinds: Column, i: Column) -> Column:
                hexes = F.sha2(F.concat_ws("|", key, F.lit(tweak), F.length(s).cast("string"), i.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)
                shift = lambda hx, k: F.conv(F.substr(hx, F.lit(1) + 2 * (k % 32), F.lit(2)), 16, 10).cast("int")
                return bind(hexes, lambda hx: F.transform(side, lambda v, k: (v + shift(hx, k)) % radix(F.get(kinds, k))))

            step = lambda acc, i: F.struct(
                F.when(i % 2 == 1, turned(acc["l"], acc["r"], cl, i)).otherwise(acc["l"]).alias("l"),
                F.when(i % 2 == 1, acc["r"]).otherwise(turned(acc["r"], acc["l"], cr, i)).alias("r"),
            )
            done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
            return bind(F.concat(done["l"], done["r"]), lambda v: F.array_join(F.transform(v, lambda x, k: F.char(x + base(F.get(a, k)))), ""))

        return bind(codes, halves)

    return bind(text, run)


def luhn_sum(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, num(c) * 2 - F.when(num(c) > 4, 9).otherwise(0)).otherwise(num(c)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x) % 10


def remainder_97(text: Column) -> Column:
    """Remainder by 97 of letters and digits read as one number, A as 10 to Z as 35."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def laid_out(shape: Column, digits: Column) -> Column:
    """The digits in the places of the digits of `shape`."""
    place = lambda i: F.length(only_digits(F.substr(shape, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), lambda c, i: F.when(c.between("0", "9"), F.substr(digits, place(i), F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: Column) -> Column:
    def run(d: Column) -> Column:
        payload = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = bind(payload, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn_sum(d) == 0, laid_out(m, whole))

    return bind(only_digits(m), run)


def _iban(m: Column, key: Column) -> Column:
    def run(s: Column) -> Column:
        country, account = F.substring(s, 1, 2), F.substr(s, F.lit(5), F.length(s) - 4)
        valid = F.length(s).between(15, 34) & (remainder_97(F.concat(account, country, F.substring(s, 3, 2))) == 1)
        new = bind(permuted_characters(account, key, "iban"), lambda a: F.concat(country, F.lpad((98 - remainder_97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(valid, bind(new, lambda n: F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(n, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")))

    return bind(F.regexp_replace(m, " ", ""), run)


def _ipv4(m: Column, key: Column) -> Column:
    def run(o: Column) -> Column:
        part = lambda i: num(F.get(o, F.lit(i)))
        done = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, "ipv4")
        text = bind(done, lambda p: F.concat_ws(".", *[x.cast("string") for v in (p["l"], p["r"]) for x in (F.floor(v / 256), v % 256)]))
        return F.when(~F.exists(o, lambda x: num(x) > 255), text)

    return bind(F.split(m, r"\."), run)


def _late_days() -> list[int]:
    """Days from the 13th on before each month of a run of 28 years."""
    out, total = [], 0
    for year in range(1901, 1929):
        for month in range(1, 13):
            out.append(total)
            total += monthrange(year, month)[1] - 12
    return out


LATE_DAYS = _late_days()


def _date(m: Column, key: Column) -> Column:
    """Days move inside their run of 28 years, 1901 to 2096 (10,227 = 21 x 487 days each); other years do not count as dates.

    A date with slashes is read month first where it can be. One that can only be read day first moves among those (the
    6,195 = 105 x 59 days of a run from the 13th of a month on), so that two written dates never get one pseudonym.
    """
    d = only_digits(m)
    part = lambda at, n: F.substring(d, at, n)
    year_first = F.rlike(m, F.lit("^[0-9]{4}"))
    iso = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)).try_cast("date")
    day_first = F.concat_ws("-", part(5, 4), part(3, 2), part(1, 2)).try_cast("date")
    month_first = F.concat_ws("-", part(5, 4), part(1, 2), part(3, 2)).try_cast("date")
    dotted = F.contains(m, F.lit("."))
    order = F.when(year_first, F.when(iso.isNotNull(), "yyyyMMdd")).when(~dotted & month_first.isNotNull(), "MMddyyyy").when(day_first.isNotNull(), "ddMMyyyy")
    day = F.when(year_first, iso).when(~dotted & month_first.isNotNull(), month_first).otherwise(day_first)

    def move(t: Column) -> Column:
        n = F.datediff(t, F.lit("1901-01-01").cast("date"))
        size, left, right = F.lit(10_227), F.lit(21), F.lit(487)
        index, block = F.pmod(n, size), F.floor(n / size)
        moved = feistel(F.floor(index / right), F.pmod(index, right), left, right, key, "date")
        return bind(moved, lambda p: F.date_add(F.lit("1901-01-01").cast("date"), (block * size + p["l"] * right + p["r"]).cast("int")))

    only_day_first = ~year_first & ~dotted & month_first.isNull() & day_first.isNotNull()

    def move_late(t: Column) -> Column:
        starts = F.array(*[F.lit(v) for v in LATE_DAYS])
        years = F.year(t) - 1901
        month = (years % 28) * 12 + F.month(t) - 1
        index = F.element_at(starts, month + 1) + F.dayofmonth(t) - 13
        moved = bind(feistel(F.floor(index / 59), index % 59, F.lit(105), F.lit(59), key, "late"), lambda p: (p["l"] * 59 + p["r"]).cast("int"))

        def written(v: Column) -> Column:
            at = F.size(F.filter(starts, lambda x: x <= v)).cast("int")  # months from 1
            pad = lambda c, n: F.lpad(c.cast("string"), n, F.lit("0"))
            year = 1901 + 28 * F.floor(years / 28) + F.floor((at - 1) / 12)
            return F.concat(pad(v - F.element_at(starts, at) + 13, 2), pad((at - 1) % 12 + 1, 2), pad(year, 4))

        return bind(moved, written)

    text = lambda t: F.when(order == "yyyyMMdd", F.date_format(t, "yyyyMMdd")).when(order == "MMddyyyy", F.date_format(t, "MMddyyyy")).otherwise(F.date_format(t, "ddMMyyyy"))
    known = order.isNotNull() & F.year(day).between(1901, 2096)
    return F.when(known & only_day_first, laid_out(m, move_late(day))).when(known, bind(move(day), lambda t: laid_out(m, text(t))))


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = num(F.substring(m, 1, 3)), num(F.substring(m, 5, 2)), num(F.substring(m, 8, 4))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    done = feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    pad = lambda v, n: F.lpad(v.cast("string"), n, F.lit("0"))
    new = bind(done, lambda p: F.concat_ws("-", pad(p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0), 3), pad(F.floor(p["r"] / 9999) + 1, 2), pad(p["r"] % 9999 + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new)


#: Fixed values of the international numbering plan: codes of one and two digits; all others have three.
COUNTRY_CODE = r"^\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(m: Column, key: Column) -> Column:
    """The country code stays, the rest of the number is permuted; 7 to 15 digits in all. Where nothing separates the code
    from the rest, it has as many digits as the numbering plan gives it."""
    apart, plan = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1), F.regexp_extract(m, COUNTRY_CODE, 1)
    code = F.when(apart != "", apart).otherwise(plan)

    def run(d: Column) -> Column:
        rest = F.substr(d, F.length(code) + 1, F.length(d))
        return F.when(F.length(d).between(7, 15) & (F.length(rest) >= 4), laid_out(m, F.concat(code, permuted_digits(rest, key, "phone"))))

    return bind(only_digits(m), run)


def _email(m: Column, key: Column) -> Column:
    """The part before the @ is permuted, the domain stays."""
    at = F.instr(m, "@")
    return F.concat(permuted_characters(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at, F.length(m)))


MAKERS = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: Column) -> Column:
    """(kind, value) of a matched text: the first kind whose pattern fits whole and whose validation passes, else nulls."""
    made = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.when(F.rlike(match, F.lit(f"^(?:{PATTERNS[kind]})$")), make(match, key)).alias("value")) for kind, make in MAKERS.items()
    ])
    return F.get(F.filter(made, lambda x: x["value"].isNotNull()), F.lit(0))


def pseudonymize(df: DataFrame, key: str, text: str = "text", counts: str = "pii_counts") -> DataFrame:
    """`df` with personal data in `text` replaced and `counts`: map of kind to number of replacements.

    The whole text is searched; a null text stays null with an empty map, an empty one stays empty. What does not pass
    validation stays as it is. Rows are independent: repeated rows give repeated results, and a value gets the same
    pseudonym everywhere under one key. A column named `counts` is replaced; other columns pass through.
    """
    t, k = F.col(text), F.lit(key)
    hit, made = fresh_name(df, "hit"), fresh_name(df, "made")
    given = df.withColumn(hit, F.coalesce(F.rlike(t, F.lit(HINT)) & F.rlike(t, F.lit(ANY)), F.lit(False)))
    found = given.withColumn(made, F.when(F.col(hit), F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("was"), pseudonym(m, k).alias("now")))))
    pieces = F.zip_with(F.split(t, ANY, -1), F.col(made), lambda gap, m: F.concat(gap, F.coalesce(m["now"]["value"], m["was"], F.lit(""))))
    equals = lambda kind: lambda x: x == kind
    kinds = F.filter(F.transform(made, lambda m: m["now"]["kind"]), lambda x: x.isNotNull())
    number = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, MAKERS)), F.array(*[F.size(F.filter(kinds, equals(v))) for v in MAKERS])), lambda _, n: n > 0)
    return found.withColumns({
        text: F.when(F.col(hit), F.array_join(pieces, "")).otherwise(t),
        counts: F.when(F.col(hit), number).otherwise(F.create_map().cast("map<string,int>")),
    }).drop(hit, made)


@query()
def op4_pii_pseudonyms(spark, sf_dir):
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), "corpus-key", "text", "found")
    count = lambda kind: F.coalesce(F.try_element_at("found", F.lit(kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", "text", *[count(kind) for kind in MAKERS])
