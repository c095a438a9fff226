"""Fill-in-the-middle: a text's three parts put into another order, so that a model learns to write the middle.

A text is cut into units, each a word with the white space before it (white space at the end is a unit of its
own). ``regexp_count`` gives their number; two cuts come from a hash of the document's id, and one match of a
pattern made for the row, ``(unit{a})(unit{b-a})(rest)`` with possessive quantifiers, is replaced by the parts
in their new order. Possessive groups keep no places to go back to, so a match takes time and stack in
proportion to the text, whatever the counts.

Defined results: a null text counts as empty; an empty text, and one that holds a marker already, stays plain;
a null id is hashed as no digits; repeated rows come out repeated; other columns are left out, whatever their
names; an empty table gives an empty table. A text of any length is one value of one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"\x20\x09-\x0D"
UNIT = rf"[{BLANKS}]*+[^{BLANKS}]++|[{BLANKS}]++"
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    """``changed`` percent of the texts are reordered, ``suffix_first`` percent of those with the suffix in front."""

    changed: int = 50
    suffix_first: int = 80
    seed: int = 42
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        clash = any(other.startswith(one[k:]) for one in marks for other in marks for k in range(1, len(one)))
        clash = clash or any(one in other for one in marks for other in marks if one != other)
        if len(set(marks)) < 3 or "" in marks or clash:
            raise ValueError("markers must differ, and none may begin as another ends")


def _draws(doc_id: Column, seed: int) -> Column:
    """Hex digest that all choices of a document are read from."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)


def _draw(digest: Column, place: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * place, 8), 16, 10).cast("long")


def count_units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def row_pattern(first: Column, second: Column) -> Column:
    """Pattern whose groups are the first ``first`` units, the next ``second`` and the rest."""
    unit = f"(?:{UNIT})"
    counted = lambda n: F.concat(F.lit(f"({unit}{{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit(r"(?s)\A"), counted(first), counted(second), F.lit(r"(.*+)\z"))


def _literal(mark: str) -> str:
    """A marker as it stands in a replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def transform(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n, form, output``: each text, its number of units, and its form as written out."""
    marks = [settings.prefix, settings.suffix, settings.middle]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", _draws(F.col("doc_id"), settings.seed)).withColumn("n", count_units(F.col("text")))
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | held | (_draw(F.col("digest"), 2) % 100 >= settings.changed)
    suffix_first = _draw(F.col("digest"), 3) % 100 < settings.suffix_first
    rows = rows.withColumn("form", F.when(plain, PLAIN).when(suffix_first, SUFFIX_FIRST).otherwise(PREFIX_FIRST))
    cuts = [_draw(F.col("digest"), place) % (F.col("n") + 1) for place in (0, 1)]
    pattern = row_pattern(F.least(*cuts), F.greatest(*cuts) - F.least(*cuts))
    p, s, m = map(_literal, marks)
    order = F.when(F.col("form") == SUFFIX_FIRST, f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    changed = F.regexp_replace(F.col("text"), pattern, order)
    return rows.select("doc_id", "text", "n", "form", F.when(F.col("form") == PLAIN, F.col("text")).otherwise(changed).alias("output"))


def parts(output: Column, form: Column, settings: Settings = Settings()) -> dict[str, Column]:
    """Prefix, middle and suffix read back from an output; null if it is plain.

    The text holds no marker, so the first place of each marker is its own.
    """
    heads = {PREFIX_FIRST: (settings.prefix, settings.suffix), SUFFIX_FIRST: (settings.suffix, settings.prefix)}
    found = {"prefix": F.lit(None).cast("string"), "middle": F.lit(None).cast("string"), "suffix": F.lit(None).cast("string")}
    for order, (one, two) in heads.items():
        second, third = F.instr(output, two), F.instr(output, settings.middle)
        first_part = F.substring(output, F.lit(len(one) + 1), second - 1 - len(one))
        second_part = F.substring(output, second + len(two), third - second - len(two))
        middle = F.substring(output, third + len(settings.middle), F.length(output))
        prefix, suffix = (first_part, second_part) if order == PREFIX_FIRST else (second_part, first_part)
        for name, part in (("prefix", prefix), ("middle", middle), ("suffix", suffix)):
            found[name] = F.when(form == order, part).otherwise(found[name])
    return found


def restore(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text an output was made of."""
    found = parts(output, form, settings)
    return F.when(form == PLAIN, output).otherwise(F.concat(found["prefix"], found["middle"], found["suffix"]))
