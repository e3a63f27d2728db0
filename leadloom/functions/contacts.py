"""Email and phone normalization as column expressions.

Both follow stated rules rather than a full library, so they stay in the JVM: see each docstring
for what is accepted.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from leadloom import fixed_values as V
from leadloom.functions.binding import let
from leadloom.functions.html import strip

_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\p{L}\p{M}\p{N}-]+"
_LABEL = r"[A-Za-z0-9\p{L}\p{N}](?:[A-Za-z0-9\p{L}\p{M}\p{N}-]{0,61}[A-Za-z0-9\p{L}\p{M}\p{N}])?"
_TOP = r"(?:xn--[A-Za-z0-9-]{0,58}[A-Za-z0-9]|[A-Za-z\p{L}][A-Za-z\p{L}\p{M}]{1,62})"
EMAIL_SYNTAX = rf"^{_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+{_TOP}$"
# Top-level names that are reserved for special use.
_RESERVED = r"\.(?:alt|arpa|invalid|local|localhost|onion|test)$"

ASSIGNED_AREA_CODES = tuple(code for codes in V.AREA_CODES.values() for code in codes.split())


def _national_numbers() -> str:
    """Numbers with a plus that a country can have given out, as one pattern.

    The codes are a prefix tree: those that begin alike share a branch, so a number is looked up digit by digit.
    """
    tree: dict[str, dict[str, list[str]]] = {}
    for line in V.NATIONAL_NUMBERS.split("\n")[1:-1]:
        code, lengths, first = line.split(" ")
        # After the first digit come the others; ranges of lengths are written with a hyphen.
        others = "|".join(
            "[0-9]{%d,%d}" % (int(n.partition("-")[0]) - 1, int(n.rpartition("-")[2]) - 1) for n in lengths.split(","))
        tree.setdefault(code[0], {}).setdefault(code[1:2], []).append(f"{code[2:]}[{first}](?:{others})")
    branches = [
        one + "(?:" + "|".join(two + "(?:" + "|".join(own) + ")" for two, own in sorted(below.items())) + ")"
        for one, below in sorted(tree.items())
    ]
    return "^[+](?:" + "|".join(branches) + ")$"


NATIONAL_NUMBERS = _national_numbers()
_KEYPAD = ("abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999")


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a code point was placed, as bootstring encoding has it for host names."""
    scaled = F.when(first, F.call_function("div", delta, F.lit(700))).otherwise(F.call_function("div", delta, F.lit(2)))
    begin = F.struct((scaled + F.call_function("div", scaled, points)).alias("d"), F.lit(0).cast("long").alias("k"))

    def smaller(s, _):
        large = s["d"] > 455
        return F.struct(F.when(large, F.call_function("div", s["d"], F.lit(35))).otherwise(s["d"]).alias("d"),
                        F.when(large, s["k"] + 36).otherwise(s["k"]).alias("k"))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(6)), begin, smaller), lambda s: s["k"] + F.call_function("div", 36 * s["d"], s["d"] + 38))


def _decoded_label(label: Column) -> Column:
    """A host label as it is meant: one that begins with ``xn--`` decoded, by a fold over its digits.

    The fold holds the code points placed so far. A label that is no whole encoding stays as it is.
    """
    rest = F.substring(label, 5, 59)
    plain = F.regexp_extract(rest, "^(.*)-[^-]*$", 1)
    points = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    number = lambda n: F.lit(n).cast("long")
    begin = F.struct(points.alias("out"), number(0).alias("i"), number(1).alias("w"), number(36).alias("k"), number(72).alias("bias"),
                     number(128).alias("n"), number(0).alias("old"))

    def placed(s, i):
        size = F.size(s["out"]).cast("long") + 1
        at = F.pmod(i, size)
        point = s["n"] + F.call_function("div", i, size)
        out = F.concat(F.slice(s["out"], F.lit(1), at.cast("int")), F.array(point), F.slice(s["out"], at.cast("int") + 1, size.cast("int")))
        return F.struct(out.alias("out"), (at + 1).alias("i"), number(1).alias("w"), number(36).alias("k"),
                        _adapted(i - s["old"], size, s["old"] == 0).alias("bias"), point.alias("n"), (at + 1).alias("old"))

    def step(s, c):
        digit = F.when(c >= "a", F.ascii(c) - 97).otherwise(F.ascii(c) - 22).cast("long")
        least = F.greatest(number(1), F.least(number(26), s["k"] - s["bias"]))
        onward = lambda i: F.struct(
            s["out"].alias("out"), i.alias("i"), (s["w"] * (36 - least)).alias("w"), (s["k"] + 36).alias("k"), s["bias"].alias("bias"),
            s["n"].alias("n"), s["old"].alias("old"))
        return let(s["i"] + digit * s["w"], lambda i: F.when(digit < least, placed(s, i)).otherwise(onward(i)))

    digits = F.filter(F.split(F.regexp_extract(rest, "([^-]*)$", 1), ""), lambda c: c != "")
    done = F.aggregate(digits, begin, step)
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")

    def written(s):
        whole = (s["w"] == 1) & (F.size(s["out"]) > 0) & F.forall(
            s["out"], lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF))
        return F.when(whole, F.array_join(F.transform(s["out"], char), "")).otherwise(label)

    # Longer labels than a host name may have, or ones that encode nothing, are not decoded.
    return F.when(label.rlike("^xn--(?:[a-z0-9-]+-)?[a-z0-9]+$") & (F.length(label) <= 63), let(done, written)).otherwise(label)


def _composed() -> str:
    """By combining mark, the letters that it makes another letter of, as JSON; from the character tables."""
    table: dict[str, dict[str, str]] = {}
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(code)) == chr(code):
            table.setdefault(chr(int(parts[1], 16)), {})[chr(int(parts[0], 16))] = chr(code)
    return json.dumps(table)


def compose(text: Column) -> Column:
    """Letters with combining marks as single characters, where there are such; marks in the order they are written."""
    table = F.from_json(F.lit(_composed()), "map<string,map<string,string>>")

    def join(done, char):
        last = F.substring(done, -1, 1)
        joined = F.try_element_at(F.try_element_at(table, char), last)
        return F.when(joined.isNull(), F.concat(done, char)).otherwise(F.concat(F.substring(done, F.lit(1), F.length(done) - 1), joined))

    folded = F.aggregate(F.split(text, ""), F.lit(""), join)
    return F.when(text.rlike(r"\p{M}"), folded).otherwise(text)


def canonical_address(lowered: Column) -> Column:
    """One spelling of an address: marks composed, the labels of its host decoded."""
    def spelled(text):
        host = F.array_join(F.transform(F.split(F.substring_index(text, "@", -1), "[.]"), _decoded_label), ".")
        encoded = text.rlike("[@.]xn--")
        return F.when(encoded, F.concat(F.substring_index(text, "@", 1), F.lit("@"), host)).otherwise(text)

    return let(compose(lowered), spelled)


def normalize_email(value: Column) -> Column:
    """Lowercased address, NULL when its syntax is not acceptable.

    Accepted: a dot-atom local part of at most 64 bytes, host labels of 1-63 characters without edge
    hyphens, a top-level domain of two letters or more, or an ``xn--`` one, that is not reserved for
    special use, 254 bytes in all. Letters of any script count. Internationalized domains come out in
    letters, however they are written, and letters with marks as single characters.
    """
    lowered = F.lower(value)
    bounded = (F.octet_length(value) <= 254) & (F.octet_length(F.substring_index(value, "@", 1)) <= 64)
    ok = bounded & lowered.rlike(EMAIL_SYNTAX) & ~lowered.rlike(_RESERVED)
    return F.when(ok, canonical_address(lowered))


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def _significant(value: Column) -> Column:
    """Digits with an optional leading plus: extension cut, keypad letters mapped, punctuation gone."""
    from_start = F.regexp_extract(strip(F.lower(value)), r"(?s)[+(0-9].*$", 0)
    without_extension = F.regexp_replace(
        from_start, r"(?:;ext=|,?\s*ext\.?|\s*x|\s*#)\s*[0-9]{1,7}\s*$", ""
    )

    def dialled(bare):
        vanity = bare.rlike(r"[a-z][^a-z]*[a-z][^a-z]*[a-z]")
        keys = F.when(vanity, F.translate(bare, *_KEYPAD)).otherwise(bare)
        digits = F.regexp_replace(keys, "[^0-9]", "")
        plus = bare.startswith("+") | bare.startswith("(+")
        return F.when(plus, F.concat(F.lit("+"), digits)).otherwise(F.regexp_replace(digits, "^011", "+"))

    return let(without_extension, dialled)


def normalize_phone(value: Column, area_codes: Sequence[str] | None = None) -> Column:
    """E.164 form with the US as home region, NULL when the number is not acceptable.

    A North American number needs ten digits after an optional 1, an area code that is assigned and an exchange
    that starts with 2-9. ``area_codes`` takes the place of the codes assigned when this was written. Other
    numbers need a plus (or 011), a calling code in use, and a national number of a length and first digit that
    its country gives out, 15 digits in all at most.
    """
    codes = ASSIGNED_AREA_CODES if area_codes is None else area_codes

    def american(ten):
        return F.when((ten != "") & F.substring(ten, 1, 3).isin(*codes), F.concat(F.lit("+1"), ten))

    def checked(number):
        ten = F.regexp_extract(number, r"^(?:\+?1)?([2-9][0-9]{2}[2-9][0-9]{6})$", 1)
        home = ~number.startswith("+") | number.startswith("+1")
        return F.when(home, let(ten, american)).when(number.rlike(NATIONAL_NUMBERS) & (F.length(number) <= 16), number)

    return let(_significant(value), checked)


def normalize_contact(kind: Column, value: Column, area_codes: Sequence[str] | None = None) -> Column:
    """Normalized value by contact type; other types pass through."""
    return (
        F.when(kind == "email", normalize_email(value))
        .when(kind == "phone", normalize_phone(value, area_codes))
        .otherwise(value)
    )
