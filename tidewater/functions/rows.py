"""Enums, domains, XML and network addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_order(value: Column, labels: list[str]) -> Column:
    """The place of a label in the declared order, from 1; null if unknown."""
    place = F.array_position(F.lit(labels), value)
    return F.when(place > 0, place)


def enum_range(labels: list[str], first: str | None = None, last: str | None = None) -> list[str]:
    return labels[labels.index(first) if first else 0 : labels.index(last) + 1 if last else len(labels)]


def is_of(value: Column, *types: str) -> Column:
    """value IS OF (types): by the names of Spark's types."""
    return F.typeof(value).isin(*types)


def domain(value: Column, check: Column, name: str) -> Column:
    """``value``, or an error if it is not null and fails the check."""
    return F.when(value.isNotNull() & ~F.coalesce(check, F.lit(True)), F.raise_error(F.lit(f"value for domain {name} violates check constraint"))).otherwise(value)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#x0d;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xmlelement(name: str, attributes: dict[str, Column] | None = None, *content: Column) -> Column:
    """An element; null attributes and contents are left out.  Contents are
    XML already: escape text first."""
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), F.replace(xml_escape(v.cast("string")), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    head = F.concat(F.lit(f"<{name}"), *parts)
    body = F.concat(F.lit(""), *(F.coalesce(c.cast("string"), F.lit("")) for c in content))
    return F.concat(head, F.when(body == "", "/>").otherwise(F.concat(F.lit(">"), body, F.lit(f"</{name}>"))))


def xmlforest(**values: Column) -> Column:
    return F.concat(F.lit(""), *(F.coalesce(F.concat(F.lit(f"<{k}>"), xml_escape(v.cast("string")), F.lit(f"</{k}>")), F.lit("")) for k, v in values.items()))


def inet_value(address: Column) -> Column:
    """A dotted IPv4 address (a length after a slash is ignored) as a number."""
    parts = F.split(F.split_part(address, F.lit("/"), F.lit(1)), r"\.")
    return sum((F.get(parts, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, F.lit(0)).cast("long") * 256**3)


def masklen(address: Column) -> Column:
    bits = F.split_part(address, F.lit("/"), F.lit(2))
    return F.when(bits == "", 32).otherwise(F.nullif(bits, F.lit("")).cast("int"))


def inet_text(value: Column) -> Column:
    return F.concat_ws(".", *(((F.shiftright(value, 8 * (3 - i))).bitwiseAND(F.lit(255))).cast("string") for i in range(4)))


def network(address: Column) -> Column:
    size = F.pow(F.lit(2), 32 - masklen(address)).cast("long")
    v = inet_value(address)
    return F.concat(inet_text(v - v % size), F.lit("/"), masklen(address).cast("string"))


def broadcast_address(address: Column) -> Column:
    size = F.pow(F.lit(2), 32 - masklen(address)).cast("long")
    v = inet_value(address)
    return inet_text(v - v % size + size - 1)


def within(a: Column, b: Column) -> Column:
    """a << b: a's network lies in b's and is smaller."""
    size = F.pow(F.lit(2), 32 - masklen(b)).cast("long")
    return (masklen(a) > masklen(b)) & (F.floor(inet_value(a) / size) == F.floor(inet_value(b) / size))


def netmask(address: Column) -> Column:
    return inet_text(F.lit(2**32) - F.pow(F.lit(2), 32 - masklen(address)).cast("long"))


def hostmask(address: Column) -> Column:
    return inet_text(F.pow(F.lit(2), 32 - masklen(address)).cast("long") - 1)


def set_masklen(address: Column, bits: int) -> Column:
    return F.concat(F.split_part(address, F.lit("/"), F.lit(1)), F.lit(f"/{bits}"))


def host(address: Column) -> Column:
    return F.split_part(address, F.lit("/"), F.lit(1))


def macaddr(text: Column) -> Column:
    """A hardware address in any usual spelling, in lower case with colons."""
    digits = F.lower(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    spelled = F.regexp_replace(digits, "(..)(?=.)", "$1:")
    return F.when(F.length(digits) == 12, spelled).otherwise(F.raise_error(F.concat(F.lit("invalid hardware address: "), text)))


def macaddr_trunc(address: Column) -> Column:
    """The maker's part, the rest zero."""
    return F.concat(F.left(address, F.lit(8)), F.lit(":00:00:00"))


def xmlconcat(*parts: Column) -> Column:
    """Null parts are left out; null if all are."""
    return F.when(F.coalesce(*(p.cast("string") for p in parts)).isNotNull(), F.concat_ws("", *parts))


def xmlcomment(text: Column) -> Column:
    bad = F.contains(text, F.lit("--")) | F.endswith(text, F.lit("-"))
    return F.when(bad, F.raise_error(F.lit("invalid XML comment"))).otherwise(F.concat(F.lit("<!--"), text, F.lit("-->")))


def xmlpi(name: str, content: Column | None = None) -> Column:
    if name.lower() == "xml":
        raise ValueError("a processing instruction cannot be named xml")
    return F.lit(f"<?{name}?>") if content is None else F.concat(F.lit(f"<?{name} "), F.ltrim(content), F.lit("?>"))


def xmlroot(document: Column, version: str = "1.0", standalone: bool | None = None) -> Column:
    alone = "" if standalone is None else f' standalone="{"yes" if standalone else "no"}"'
    return F.concat(F.lit(f'<?xml version="{version}"{alone}?>'), F.regexp_replace(document, r"^<\?xml [^>]*\?>", ""))
