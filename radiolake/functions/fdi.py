"""Tooth numbers: quadrant and position, and the three codes in use (Column -> Column).

Two digits (q * 10 + p), detector class ((q - 1) * 8 + p, 0 is background) and label
class ((q - 1) * 8 + p - 1). Raw categories count from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of quadrants and positions.
QUADRANTS = {1: "Maxillary Right (Upper Right)", 2: "Maxillary Left (Upper Left)", 3: "Mandibular Left (Lower Left)", 4: "Mandibular Right (Lower Right)"}
POSITIONS = {
    1: "Central Incisor", 2: "Lateral Incisor", 3: "Canine", 4: "First Premolar",
    5: "Second Premolar", 6: "First Molar", 7: "Second Molar", 8: "Third Molar (Wisdom Tooth)",
}


def from_raw(category: Column) -> Column:
    """Zero-based category to quadrant or position; null counts as 0."""
    return F.coalesce(category, F.lit(0)) + 1


def valid(q: Column, p: Column) -> Column:
    return F.coalesce(q.between(1, 4) & p.between(1, 8), F.lit(False))


def code(q: Column, p: Column, strict: bool = False) -> Column:
    """Two-digit code; null for no tooth, or an error if strict."""
    bad = F.raise_error(F.lit("no such tooth")) if strict else F.lit(None)
    return F.when(valid(q, p), q * 10 + p).otherwise(bad).cast("int")


def decode(c: Column) -> tuple[Column, Column]:
    """(quadrant, position) of a code given as number or text; nulls for no tooth."""
    n = c.cast("string").try_cast("int")
    q, p = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    ok = valid(q, p)
    return F.when(ok, q), F.when(ok, p)


def label(q: Column, p: Column) -> Column:
    return F.when(valid(q, p), F.concat(q.cast("string"), p.cast("string")))


def name(q: Column, p: Column) -> Column:
    """The tooth's name with its number; what isn't known is named by its number, '??' for no tooth. Null for a null part."""
    quadrant = F.create_map(*[F.lit(x) for kv in QUADRANTS.items() for x in kv])
    position = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])
    words = F.coalesce(quadrant[q], F.concat(F.lit("Quadrant "), q.cast("string"))), F.coalesce(position[p], F.concat(F.lit("Tooth "), p.cast("string")))
    return F.concat(words[0], F.lit(" "), words[1], F.lit(" (FDI #"), F.coalesce(label(q, p), F.lit("??")), F.lit(")"))


def read_number(c: Column) -> tuple[Column, Column, Column]:
    """(quadrant, position, why not) of a tooth number given as text: two digits, of a
    tooth that there is. Null counts as bad."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    q, p = F.substring(text, 1, 1).try_cast("int"), F.substring(text, 2, 1).try_cast("int")
    why = F.when(F.length(text) != 2, F.concat(F.lit("not two digits: "), text)).when(q.isNull() | p.isNull(), F.concat(F.lit("not a number: "), text)).when(~valid(q, p), F.concat(F.lit("no such tooth: "), text))
    return F.when(why.isNull(), q), F.when(why.isNull(), p), why


def flipped(q: Column, strict: bool = False) -> Column:
    """The quadrant mirrored left to right; others stay, or raise if strict."""
    other = F.raise_error(F.concat(F.lit("no such quadrant "), q.cast("string"))).cast("int") if strict else q
    return F.when(q == 1, 2).when(q == 2, 1).when(q == 3, 4).when(q == 4, 3).otherwise(other)


def detector_class(q: Column, p: Column) -> Column:
    return F.when(valid(q, p), (q - 1) * 8 + p)


def label_class(q: Column, p: Column) -> Column:
    return F.when(valid(q, p), (q - 1) * 8 + p - 1)
