"""Operator 4: quality rules. Built-in functions only.

Rules on each text, and the frequency of its lines across the documents of one host: normalised
lines are hashed, each host's distinct documents per line are counted, lines above the limit are
removed, and documents left depleted are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import settle
from relata.llm.registry import query, table

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what a word is
SYMBOLS = "[#*$%&|<>]"  # fixed value: characters that count as symbols
LINE_SHARE = 0.001  # of a host's documents that a frequent line is in, beside the least number


def _shift(value: Column, bits: Column, way: str) -> Column:
    return F.call_function(way, value, bits)


def _rules(texts: DataFrame) -> DataFrame:
    """``text`` replaced by the counts that the rules need, all within the row.

    Windows of three words become one number each: hash above, place in the low bits that the
    text's length needs. Sorting brings equal ones together; neighbours of equal hash are compared
    word by word. Each step is a column that the next refers to more than once, so that the
    optimizer keeps it as a column and no array is built anew for each of its members.
    """
    has_word = F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(WORD)))
    parts = texts.select(
        "*",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        has_word.alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    sized = parts.select(
        *[c for c in parts.columns if c not in ("text", "lines")],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("words").cast("long"))).alias("bits"),
    )
    words, bits = F.col("words"), F.col("bits")

    def window(word: Column, place: Column) -> Column:
        hashed = F.xxhash64(word, F.get(words, place + 1), F.get(words, place + 2))
        return _shift(hashed, bits, "shiftleft").bitwiseOR(place.cast("long"))

    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    placed = sized.withColumn("windows", F.sort_array(F.transform(first, window)))
    sorted_ = F.col("windows")
    mask = _shift(F.lit(1).cast("long"), bits, "shiftleft") - 1

    def same(a: Column, b: Column) -> Column:
        at, to = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
        equal = F.lit(True)
        for k in range(3):
            equal = equal & (F.get(words, at + k) == F.get(words, to + k))
        alike = _shift(a, bits, "shiftright") == _shift(b, bits, "shiftright")
        return F.coalesce(F.when(alike, equal), F.lit(False))

    found = F.filter(
        sorted_,
        lambda x, i: same(x, F.get(sorted_, i - 1)) | same(x, F.get(sorted_, i + 1)),
    )
    starts = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask)))
    marked = placed.withColumn("starts", starts)
    begun = F.col("starts")
    covered = F.transform(
        begun, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(begun, i + 1) - at, F.lit(3)))
    )
    return marked.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
    ).drop("words", "bits", "windows", "starts")


def _lines(texts: DataFrame) -> DataFrame:
    """A row per line with a word: its place, its hash after normalising, its number of words.

    Normalised is lower case, runs of blanks as one blank, runs of digits as one zero.
    """
    plain = F.regexp_replace(
        F.regexp_replace(F.lower("text"), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0"
    )
    return (
        texts.select("doc_id", "host", "text_key", F.posexplode(F.split(plain, "\n", -1)))
        .withColumn("line", F.trim("col"))
        .where("line != ''")
        .select(
            "doc_id",
            "host",
            "text_key",
            F.col("pos").alias("place"),
            F.xxhash64("line").alias("line_key"),
            F.size(F.split("line", " ")).alias("line_words"),
        )
    )


def _prepare(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    texts = documents.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("host"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    return texts.withColumn("text_key", F.xxhash64("host", "text"))


def frequent_lines(
    documents: DataFrame, least_documents: int = 20, share: float = LINE_SHARE
) -> DataFrame:
    """Lines (host, line_key) in at least ``least_documents`` and over ``share`` of a host's documents.

    Counts go over distinct doc_ids of all rows; they are combined ahead of each shuffle, so a line
    that a host repeats everywhere sends one row per task.
    """
    texts = _prepare(documents)
    sizes = texts.groupBy("host").agg(F.count_distinct("doc_id").alias("host_documents"))
    counts = (
        _lines(texts)
        .select("host", "line_key", "doc_id")
        .distinct()
        .groupBy("host", "line_key")
        .agg(F.count("doc_id").alias("n_documents"))
        .where(F.col("n_documents") >= least_documents)
    )
    return (
        counts.join(sizes, "host")
        .where(F.col("n_documents") > share * F.col("host_documents"))
        .select("host", "line_key", "n_documents")
    )


def _removed(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per text that has frequent lines: their places and words. A repeated row counts once."""
    return (
        _lines(texts)
        .join(frequent.select("host", "line_key"), ["host", "line_key"])
        .dropDuplicates(["doc_id", "text_key", "place"])
        .groupBy("doc_id", "text_key")
        .agg(F.sum("line_words").alias("removed_words"), F.collect_set("place").alias("places"))
    )


def judge(
    documents: DataFrame,
    least_documents: int = 20,
    share: float = LINE_SHARE,
    least_left: float = 0.5,
) -> DataFrame:
    """Counts and verdict of each row of ``documents`` (doc_id, text, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    removed_words, kept, and text_key and places for ``clean``. ``kept`` is false if a rule on the
    text failed, or if the words left without its host's frequent lines are fewer than
    ``least_left`` of all.

    A null or empty text has no words and fails. Rows without a source form one host. A doc_id
    counts once for a line however often it is repeated; rows without one are judged but not
    counted. Repeated rows all stay and get one verdict. Other columns are left out. An empty
    table gives no rows.
    """
    texts = _prepare(documents)
    frequent = settle(frequent_lines(documents, least_documents, share), "frequent-lines")
    removed = _removed(texts, frequent).withColumnsRenamed(
        {"doc_id": "removed_id", "text_key": "removed_key"}
    )
    joined = (
        _rules(texts)
        .join(
            removed,
            F.col("doc_id").eqNullSafe(F.col("removed_id"))
            & (F.col("text_key") == F.col("removed_key")),
            "left",
        )
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "removed_words",
        (~failed & (left >= least_left * F.col("n_words"))).alias("kept"),
        "text_key",
        "places",
    )


def clean(documents: DataFrame, verdicts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``documents`` that ``judge`` keeps, without their host's frequent lines.

    Returns doc_id, clean_text and the columns named in ``carry``. Other lines are as they were. The
    verdicts are stored first: a filter would else be pushed into the rules, which then build their
    arrays again for each of their members.
    """
    verdicts = settle(verdicts.select("doc_id", "text_key", "places", "kept"), "verdicts")
    kept = (
        verdicts.where("kept")
        .select("doc_id", "text_key", "places")
        .dropDuplicates(["doc_id", "text_key"])
        .withColumnsRenamed({"doc_id": "kept_id", "text_key": "kept_key"})
    )
    rows = _prepare(documents, carry).join(
        kept,
        F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")),
    )
    lines = F.filter(
        F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col("places"), i)
    )
    return rows.select(
        "doc_id",
        F.when(F.col("places").isNull(), F.col("text"))
        .otherwise(F.concat_ws("\n", lines))
        .alias("clean_text"),
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))
      AS lines
  FROM texts
), windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) > 2)
), found AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows)
  WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM found, (VALUES (0), (1), (2)) AS steps(k) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, place, trim(regexp_replace(regexp_replace(lower(line),
      '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS place FROM texts)
), frequent AS (
  SELECT l.host, l.line FROM line l
    JOIN (SELECT host, count(DISTINCT doc_id) AS n FROM texts GROUP BY host) h USING (host)
  WHERE line != '' GROUP BY l.host, l.line, h.n
  HAVING count(DISTINCT doc_id) >= 20 AND count(DISTINCT doc_id) > 0.001 * h.n
), removed AS (
  SELECT doc_id, sum(len(string_split(line, ' '))) AS removed_words
  FROM line JOIN frequent USING (host, line) GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM split s LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  removed_words, NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept
FROM judged
"""


@query("op4_quality_rules", SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents")).drop("text_key", "places")
