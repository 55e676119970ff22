"""Nested bags as text: ``{(a,b),(c,d)}``.

A bag is one field of a separated line. What has a meaning in such a text is written as a backslash
and two hexadecimal digits, so fields may hold any text; a null is the null mark. Reading checks the
whole text: a bag that is not well formed comes back as a reject with its text, a field that does not
fit its type as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from relata.sources.text import NULL_MARK

ESCAPE = "\\"
MARKED = "\t\n\r(),{}"  # fixed value: characters with a meaning in a bag or in a line of fields


def _code(character: str) -> str:
    return f"{ESCAPE}{ord(character):02X}"


def escape(text: Column) -> Column:
    """``text`` without characters that have a meaning; the escape character itself comes first."""
    for character in ESCAPE + MARKED:
        text = F.replace(text, F.lit(character), F.lit(_code(character)))
    return text


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: after it a backslash only begins a code."""
    for character in MARKED + ESCAPE:
        text = F.replace(text, F.lit(_code(character)), F.lit(character))
    return text


def write_bag(bag: Column, members: StructType) -> Column:
    """A bag of structs as text; a null bag is null, a null member a tuple of nulls."""

    def field(member: Column, name: str) -> Column:
        return F.coalesce(escape(member[name].cast("string")), F.lit(NULL_MARK))

    def tuple_text(member: Column) -> Column:
        fields = F.array_join(F.array(*[field(member, f.name) for f in members]), ",")
        return F.concat(F.lit("("), fields, F.lit(")"))

    return F.concat(F.lit("{"), F.array_join(F.transform(bag, tuple_text), ","), F.lit("}"))


def _tuples(text: Column) -> Column:
    """The insides of the tuples of a bag's text, which holds one at least."""
    return F.split(F.substring(text, 3, F.length(text) - 4), r"\),\(", -1)


def well_formed(text: Column, width: int) -> Column:
    """Whether ``text`` is a bag of tuples of ``width`` fields, every character accounted for."""
    codes = "|".join(f"{ord(c):02X}" for c in ESCAPE + MARKED)

    def sound(inside: Column) -> Column:
        fields = F.split(inside, ",", -1)
        plain = F.forall(fields, lambda f: (f == NULL_MARK) | ~F.rlike(f, F.lit(rf"\\(?!{codes})")))
        return (F.size(fields) == width) & ~F.rlike(inside, F.lit(r"[\t\n\r(){}]")) & plain

    framed = F.startswith(text, F.lit("{(")) & F.endswith(text, F.lit(")}")) & (F.length(text) >= 4)
    return (text == "{}") | (framed & F.forall(_tuples(text), sound))


def read_bag(text: Column, members: StructType) -> Column:
    """The bag that a well formed ``text`` holds."""

    def member(inside: Column) -> Column:
        fields = F.split(inside, ",", -1)
        return F.struct(
            *[
                F.nullif(F.get(fields, F.lit(i)), F.lit(NULL_MARK)).alias(f.name)
                for i, f in enumerate(members)
            ]
        )

    def typed(m: Column) -> Column:
        return F.struct(
            *[unescape(m[f.name]).try_cast(f.dataType).alias(f.name) for f in members]
        )

    kind = ArrayType(members).simpleString()
    found = F.transform(F.transform(_tuples(text), member), typed)
    return F.when(text == "{}", F.array().cast(kind)).otherwise(found.cast(kind))


def bags_to_lines(df: DataFrame, separator: str = "\t") -> DataFrame:
    """Each row as one line ``value``: plain fields and bags of structs, in order of columns."""
    fields = []
    for f in df.schema:
        if isinstance(f.dataType, ArrayType):
            text = write_bag(F.col(f.name), f.dataType.elementType)
        else:
            text = escape(F.col(f.name).cast("string"))
        fields.append(F.coalesce(text, F.lit(NULL_MARK)))
    return df.select(F.array_join(F.array(*fields), separator).alias("value"))


def lines_to_bags(
    lines: DataFrame, schema: StructType | str, line: str = "value", separator: str = "\t"
) -> DataFrame:
    """The rows that lines hold, and ``rejected``: the line where it is not as ``schema`` says.

    A line needs as many fields as the schema and a well formed text for each bag. In a rejected row
    all else is null. A plain or bag field that does not fit its type is null.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    split = F.split(F.col(line), separator, -1)
    named = lines.select(
        line, split.alias("__f"), *[
            F.nullif(F.get(split, F.lit(i)), F.lit(NULL_MARK)).alias(f"__{f.name}")
            for i, f in enumerate(wanted)
        ],
    )
    sound = F.size("__f") == len(wanted)
    for f in wanted:
        if isinstance(f.dataType, ArrayType):
            text = F.col(f"__{f.name}")
            sound = sound & (text.isNull() | well_formed(text, len(f.dataType.elementType)))
    checked = named.withColumn("__sound", F.coalesce(sound, F.lit(False)))

    def value(f) -> Column:
        text = F.col(f"__{f.name}")
        if isinstance(f.dataType, ArrayType):
            return read_bag(text, f.dataType.elementType)
        return unescape(text).try_cast(f.dataType)

    return checked.select(
        *[F.when(F.col("__sound"), value(f)).alias(f.name) for f in wanted],
        F.when(~F.col("__sound"), F.col(line)).alias("rejected"),
    )


def rejects(read: DataFrame) -> DataFrame:
    return read.filter("rejected IS NOT NULL").select("rejected")


def accepted(read: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return read.filter("rejected IS NULL").select(*(names or [c for c in read.columns if c != "rejected"]))
