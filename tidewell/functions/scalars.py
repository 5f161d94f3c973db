"""Column functions shared by the operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _bare_letters() -> tuple[str, str]:
    """Lower-case letters that are a letter with marks by canonical decomposition, and the letters without them."""
    pairs = []
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and chr(code) == chr(code).lower() and all(unicodedata.combining(m) for m in marks) and not unicodedata.combining(base):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTS = _bare_letters()


def utc(text: Column) -> Column:
    """ISO-8601 text to an instant; without a zone it is UTC; null if it is no instant. Needs a UTC session."""
    return text.try_cast("timestamp")


def zoned(text: Column) -> Column:
    """ISO-8601 text that names its zone to an instant; null without a zone."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text.try_cast("timestamp"))


def plain(text: Column) -> Column:
    """Lower case, without accents, punctuation or repeated spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), "[¿?¡!,;.]", " "), r"\s+", " "))


def folded(text: Column) -> Column:
    """Lower case without accents or other marks, joined to their letter or standing alone, for searching."""
    return F.regexp_replace(F.translate(F.lower(text), *_ACCENTS), r"\p{Mn}", "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(ratio(100.0 * a, b), digits)


def whole_units(unit: str, later: str, earlier: str) -> Column:
    """Whole units from earlier to later, cut towards zero; both are column expressions."""
    return F.expr(f"timestampdiff({unit}, {earlier}, {later})")


def half_open(t: Column, start: Column, end: Column) -> Column:
    """start <= t < end."""
    return (t >= start) & (t < end)


def completed_name(name: Column, project: Column, dataset: Column) -> Column:
    """A table name with its project and dataset: three parts stay, two get the project, one gets both; lower case."""
    n = F.size(F.split(name, r"\."))
    return F.lower(F.when(n >= 3, name).when(n == 2, F.concat_ws(".", project, name)).otherwise(F.concat_ws(".", project, dataset, name)))


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def dataset_part(name: Column) -> Column:
    return F.get(F.split(name, r"\."), F.size(F.split(name, r"\.")) - 2)


def slug(text: Column) -> Column:
    """Letters and digits joined by single hyphens, without accents, in lower case."""
    return F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-|-$", "")
