"""String functions and pattern matching, as Column expressions."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar_to(text: Column, pattern: str, escape: str = "\\") -> Column:
    """SIMILAR TO: ``%`` and ``_`` as in LIKE, ``| * + ? {} () []`` as in
    regular expressions, matched against the whole text."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif inside:
            inside = c != "]"
            out.append("\\\\" if c == "\\" else c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return text.rlike("(?s)^(?:" + "".join(out) + ")$")


def regexp_replace(text: Column, pattern: str, new: str, flags: str = "") -> Column:
    """Replaces the first match, or all with flag ``g``; ``\\1`` and ``\\&`` in
    ``new`` are a group and the whole match; flag ``i`` ignores case."""
    made = re.sub(r"\\(\d|&|.)", lambda m: "$" + m[1] if m[1].isdigit() else "$0" if m[1] == "&" else "\\\\" + m[1], new.replace("$", "\\$"))
    lead = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(text, lead + pattern, made)
    # the text before is one more group, so the pattern's own back references move up
    moved = re.sub(r"\\(\\|[1-8])", lambda m: "\\" + (m[1] if m[1] == "\\" else str(int(m[1]) + 1)), pattern)
    whole = f"{lead}(?s:^(.*?))(?:{moved})"
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}" if m[1] != "0" else "$0", made)
    return F.regexp_replace(text, whole, "$1" + shifted)


def regexp_matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern without groups, as an array to explode."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def substring_regex(text: Column, pattern: str) -> Column:
    """The first group, or the whole match without groups; null without match."""
    group = 1 if re.search(r"(?<!\\)\((?!\?)", pattern) else 0
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def quote_literal(text: Column) -> Column:
    body = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(F.contains(text, F.lit("\\")), F.lit("E")).otherwise(""), F.lit("'"), body, F.lit("'"))


def quote_ident(text: Column) -> Column:
    safe = text.rlike("^[a-z_][a-z0-9_]*$")
    return F.when(safe, text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def char_n(text: Column, n: int) -> Column:
    """char(n): padded with blanks, cut by an explicit cast."""
    return F.rpad(F.substring(text, 1, n), n, " ")


def bpchar_eq(a: Column, b: Column) -> Column:
    """Comparison of char(n) values: trailing blanks don't count."""
    return F.rtrim(a) == F.rtrim(b)


def chr_(code: Column) -> Column:
    """The character of a code point (Spark's chr stops at 255)."""
    bits = F.lpad(F.hex(code), 8, "0")
    return F.decode(F.unhex(bits), "UTF-32")


def to_hex(number: Column) -> Column:
    return F.lower(F.hex(number))


def encode(text: Column, how: str) -> Column:
    data = text.cast("binary")
    return {"hex": F.lower(F.hex(data)), "base64": F.base64(data)}[how]


def overlay(text: Column, new: Column, start: int, length: int) -> Column:
    return F.overlay(text, new, F.lit(start), F.lit(length))


def cash_words(cents: Column) -> Column:
    """An amount in words; for whole dollars below a quadrillion and cents."""
    small = F.lit("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())
    tens = F.lit("- - twenty thirty forty fifty sixty seventy eighty ninety".split())

    def below_hundred(n: Column) -> Column:
        unit = F.when(n % 10 > 0, F.concat(F.lit(" "), F.element_at(small, (n % 10 + 1).cast("int")))).otherwise("")
        return F.when(n < 20, F.element_at(small, (n % 20 + 1).cast("int"))).otherwise(F.concat(F.element_at(tens, (F.floor(n / 10) + 1).cast("int")), unit))

    def below_thousand(n: Column) -> Column:
        rest = F.when(n % 100 > 0, below_hundred(n % 100))
        return F.when(n < 100, below_hundred(n)).otherwise(F.concat_ws(" ", F.element_at(small, (F.floor(n / 100) + 1).cast("int")), F.lit("hundred"), rest))

    whole = F.floor(F.abs(cents) / 100)
    words = []
    for power, name in ((12, "trillion"), (9, "billion"), (6, "million"), (3, "thousand"), (0, "")):
        part = F.floor(whole / F.lit(10**power)) % 1000
        words.append(F.when(part > 0, F.concat_ws(" ", below_thousand(part), F.when(F.lit(bool(name)), F.lit(name)))))
    dollars = F.when(whole == 0, "zero").otherwise(F.concat_ws(" ", *words))
    change = F.abs(cents) % 100
    text = F.concat_ws(" ", F.when(cents < 0, "minus"), dollars, F.when(whole == 1, "dollar").otherwise("dollars"), F.lit("and"), below_hundred(change), F.when(change == 1, "cent").otherwise("cents"))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def initcap(text: Column) -> Column:
    """Each run of letters and digits starts with a capital, the rest is small."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def regexp_match_groups(text: Column, pattern: str) -> Column:
    """For every match the array of its groups."""
    n = re.compile(pattern).groups
    if not n:
        return F.transform(regexp_matches(text, pattern), lambda m: F.array(m))
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, n + 1)]
    return F.transform(each[0], lambda _, i: F.array(*(F.get(e, i) for e in each)))


def encode_escape(data: Column) -> Column:
    """Bytes as text: zero and high bytes in octal, a backslash doubled."""
    code = F.hex(data)

    def one(i: Column) -> Column:
        byte = F.conv(F.substr(code, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(byte.cast("string"), 10, 8), 3, "0"))
        return F.when(byte == 92, "\\\\").when((byte == 0) | (byte > 127), octal).otherwise(F.char(byte))

    n = F.octet_length(data)
    return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), ""))


def decode(text: Column, how: str) -> Column:
    return {"hex": F.unhex(text), "base64": F.unbase64(text)}[how]


def quote_nullable(text: Column) -> Column:
    return F.coalesce(quote_literal(text), F.lit("NULL"))


#: Latin letters with marks, and the letters without.
MARKED, UNMARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def to_ascii(text: Column) -> Column:
    return F.translate(text, MARKED, UNMARKED)


def same_ignoring_case(a: Column, b: Column) -> Column:
    """Equality of case-insensitive text."""
    return F.lower(a) == F.lower(b)


def digest(text: Column, how: str) -> Column:
    data = text.cast("binary")
    return {"md5": F.md5(data), "sha1": F.sha1(data), "sha256": F.sha2(data, 256), "sha512": F.sha2(data, 512)}[how]


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Keyed hash: the key's two pads are constants, the rest is the digest."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based identifier (SHA-1) of a name in a namespace."""
    h = F.sha1(F.concat(F.lit(bytearray(uuid.UUID(namespace).bytes)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)
