"""Operator 5: personal data, by patterns and by what terms disclose. Built-in functions only.

Patterns find the protected values. The text of a document that holds one is its context, and over
the whole corpus the co-occurrence of value and term tells how much the term gives away: a term
discloses a value if its pointwise mutual information with it comes near the value's whole
information. In all of a document that holds the value, terms that disclose it are generalised, and
those that occur with nothing else are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import settle
from relata.llm.registry import query, table

DISCLOSES = 0.9  # of the value's information
LEAST_CONTEXTS = 3  # different texts that value and term share
TERM = r"[\p{L}\p{M}\p{N}]++"
KINDS = ("email", "ip", "card", "phone")  # fixed value: the order of kinds

# One character stands for a separator between digits, or a dot between the labels of a host name.
# Runs are then one character class, which is matched without recursion whatever their length.
# A match can only begin where a run does, or where the match before ended.
JOINT, STRAY = "\ue000", "\ue001"
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{JOINT}-]))[A-Za-z0-9._%+{JOINT}-]++"
    rf"@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{JOINT}]*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_PLACED = "array<struct<start:int,end:int,value:string>>"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: Column) -> Column:
    """The matches of ``pattern`` in order: an array of (start, end, value), in code points.

    The text between matches tells where they are; its work grows with the square of the number of
    matches in one text.
    """
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACED).alias("found"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(gaps) - 1),
        values,
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )
    return F.aggregate(pairs, empty, add, lambda state: state["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fits(kind: str):
    """Whether a match stays, as a function of it."""

    def small(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+", "")
        number = F.coalesce(F.substring(digits, 1, 3).try_cast("int"), F.lit(0))
        return (F.length(digits) < 4) & (number <= 255)

    def check(match: Column) -> Column:
        value = match["value"]
        if kind == "ip":
            return F.forall(F.split(value, r"\."), small)
        if kind == "card":
            digits = _digits(value)
            return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
        if kind == "phone":
            return F.length(_digits(value)).between(10, 15)
        return F.lit(True)

    return check


def _span(rank: int, kind: str):
    return lambda match: F.struct(
        match["start"].alias("start"),
        F.lit(rank).alias("rank"),
        match["end"].alias("end"),
        F.lit(kind).alias("kind"),
        # of the text itself, as the pattern may have seen a joint
        F.substring("text", match["start"] + 1, match["end"] - match["start"]).alias("value"),
    )


def _base(texts: DataFrame) -> DataFrame:
    """``texts`` with ``found``: the base spans, an array of (start, rank, end, kind, value).

    Patterns are run only on texts that hold the characters which a match needs.
    """
    plain = F.replace("text", F.lit(JOINT), F.lit(STRAY))
    with_digit = F.rlike("text", F.lit("[0-9]"))
    joined_labels = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOINT)
    joined_digits = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    inputs = {
        "email": F.when(F.contains("text", F.lit("@")), joined_labels),
        "ip": F.when(F.contains("text", F.lit(".")) & with_digit, F.col("text")),
        "card": F.when(with_digit, joined_digits),
        "phone": F.when(F.contains("text", F.lit("+")), F.col("text")),
    }
    marked = texts.select("*", *[column.alias(f"for_{k}") for k, column in inputs.items()])
    matched = marked.select(
        *texts.columns,
        *[located(F.col(f"for_{k}"), F.lit(PATTERNS[k])).alias(f"all_{k}") for k in KINDS],
    )
    spans = [
        F.coalesce(
            F.transform(F.filter(F.col(f"all_{k}"), _fits(k)), _span(rank, k)),
            F.array().cast(_SPANS),
        )
        for rank, k in enumerate(KINDS)
    ]
    return matched.select(*texts.columns, F.array_sort(F.concat(*spans)).alias("found"))


def _values(some: DataFrame) -> DataFrame:
    """A row per text and value in it. Texts that are copies of each other have one ``text_key``."""
    one = some.select("text_key", F.explode("found").alias("f"))
    value = F.when(F.col("f.kind") == "email", F.lower("f.value")).otherwise(_digits(F.col("f.value")))
    return one.select("text_key", F.xxhash64("f.kind", value).alias("value_key")).distinct()


def _outside(text: Column, found: Column) -> Column:
    """``text`` with as many blanks in place of each span of ``found``, which is in order of start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(state: Column, span: Column) -> Column:
        before = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        end = F.greatest(state["at"], span["end"])
        blanks = F.call_function("repeat", F.lit(" "), end - F.greatest(state["at"], span["start"]))
        return F.struct(
            end.alias("at"),
            F.concat(state["parts"], F.array(F.concat(before, blanks))).alias("parts"),
        )

    return F.aggregate(
        found,
        start,
        cut,
        lambda state: F.concat_ws(
            "", state["parts"], F.substring(text, state["at"] + 1, F.length(text) - state["at"])
        ),
    )


def _spellings(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_spellings(text), lambda word: F.lower(word)))


def _disclosing(texts: DataFrame, some: DataFrame) -> DataFrame:
    """A row per text and term that discloses a value in it; ``alone`` if nothing else has the term.

    Texts that are copies of each other count once for a pair. Only values in ``LEAST_CONTEXTS``
    different texts or more can be disclosed, so only those meet the terms of their texts. The
    documents that hold a term are counted over the whole corpus, each term once per document and
    combined ahead of the shuffle.
    """
    values = settle(_values(some), "values")
    often = (
        values.groupBy("value_key")
        .agg(F.count("*").alias("contexts"))
        .where(F.col("contexts") >= LEAST_CONTEXTS)
    )
    held = (
        values.join(often, "value_key")
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("value_key", "contexts")).alias("held"))
    )
    outside = _outside(F.col("text"), F.col("found"))
    by_text = settle(
        some.dropDuplicates(["text_key"])
        .join(held, "text_key")
        .select("text_key", "held", _terms(outside).alias("terms")),
        "terms-of-texts",
    )
    pairs = by_text.select("text_key", "held", F.explode("terms").alias("term")).select(
        "text_key", "term", F.inline("held")
    )
    together = settle(
        pairs.groupBy("value_key", "contexts", "term")
        .agg(F.count("*").alias("together"))
        .where(F.col("together") >= LEAST_CONTEXTS),
        "together",
    )
    counts = (
        texts.select(F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("documents"))
    )
    wanted = together.select("term").distinct()
    total = texts.agg(F.greatest(F.count("*"), F.lit(2)).cast("double").alias("n")).first().n
    information = F.log2(total / F.col("contexts"))
    share = F.least(F.col("together") / F.col("documents"), F.lit(1.0))
    mutual = F.log2(share * total / F.col("contexts"))
    disclosing = settle(
        together.join(counts.join(wanted, "term"), "term")
        .where((information > 0) & (mutual >= DISCLOSES * information))
        .select("value_key", "term", (share >= 1).alias("alone")),
        "disclosing",
    )
    return (
        pairs.join(disclosing, ["value_key", "term"])
        .groupBy("text_key", "term")
        .agg(F.max("alone").alias("alone"))
    )


def _overlaps(spans: Column):
    return lambda term: F.exists(
        spans, lambda f: (term["start"] < f["end"]) & (f["start"] < term["end"])
    )


def find_personal(documents: DataFrame) -> DataFrame:
    """Protected spans of each row of ``documents`` (doc_id, text).

    Returns doc_id, text, found (the base spans) and spans (all, with those of the kinds ``term``
    and ``sole_term``, the terms that disclose a value of the document), arrays of (start, rank, end,
    kind, value) in order of start, then of rank.

    A null text is empty and has no spans. Rows without doc_id are searched like others. Repeated
    rows all stay and get the same spans; each counts as a document of the words it holds. Other
    columns are left out. No rows give no rows.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    found = _base(keyed)
    some = settle(found.where(F.size("found") > 0), "with-values")
    told = (
        _disclosing(texts, some)
        .groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "alone"))).alias("told"))
    )
    # The text's own spelling, as lower case may differ in length.
    spelt = F.filter(_spellings(F.col("outside")), lambda t: F.map_contains_key("told", F.lower(t)))
    matching = (
        some.dropDuplicates(["text_key"])
        .join(told, "text_key")
        .select("text_key", "told", _outside(F.col("text"), F.col("found")).alias("outside"))
        .withColumn("spelt", spelt)
        .where(F.size("spelt") > 0)
        .withColumn(
            "pattern",
            F.concat(
                F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"),
                F.concat_ws("|", "spelt"),
                F.lit(r")(?![\p{L}\p{M}\p{N}])"),
            ),
        )
    )
    places = F.transform(
        located(F.col("outside"), F.col("pattern")),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(len(KINDS)).alias("rank"),
            m["end"].alias("end"),
            F.when(F.col("told")[F.lower(m["value"])], "sole_term").otherwise("term").alias("kind"),
            F.lower(m["value"]).alias("value"),
        ),
    )
    terms = matching.select("text_key", places.alias("terms"))
    added = F.filter("terms", lambda t: ~_overlaps(F.col("found"))(t))
    spans = F.array_sort(F.concat("found", F.coalesce(added, F.array().cast(_SPANS))))
    stored = settle(terms.withColumnRenamed("text_key", "term_key"), "terms")
    return found.join(stored, F.col("text_key") == F.col("term_key"), "left").select(
        "doc_id", "text", "found", spans.alias("spans")
    )


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with values replaced by their kind, disclosing words by ``<word>`` or by nothing."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(state: Column, span: Column) -> Column:
        mark = (
            F.when(span["kind"] == "sole_term", F.lit(""))
            .when(span["kind"] == "term", F.lit("<word>"))
            .otherwise(F.concat(F.lit("<"), span["kind"], F.lit(">")))
        )
        before = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], before, mark)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(
        spans,
        start,
        put,
        lambda state: F.concat(
            state["out"], F.substring(text, state["at"] + 1, F.length(text) - state["at"])
        ),
    )


def _listed(spans: Column) -> Column:
    kind = lambda s: F.when(s["kind"] == "sole_term", F.lit("term")).otherwise(s["kind"])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"]))
    )


@query("op5_pii_sanitisation")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal(table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_listed(F.col("found")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
