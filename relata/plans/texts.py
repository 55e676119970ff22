"""Jobs on free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions.words import pig_latin, tokens
from relata.operators.aggregate import count_by
from relata.plans import views
from relata.plans.registry import query


@query(
    "txt_wordcount",
    r"""
    SELECT word, count(*) AS ct
    FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word
    """,
)
def _(source):
    texts = views.table(source, "documents").select("text")
    words = texts.select(F.explode(tokens(F.col("text"))).alias("word"))
    return count_by(words, "word")


@query(
    "txt_pig_latin",
    r"""
    SELECT doc_id, line_no, array_to_string(list_transform(
             list_zip(regexp_extract_all(line, '\b([bcdfghjklmnpqrstvwxz]*)([\w'']+)', 1),
                      regexp_extract_all(line, '\b([bcdfghjklmnpqrstvwxz]*)([\w'']+)', 2)),
             lambda p: CASE WHEN regexp_matches(p[2], '^[A-Z]')
               THEN upper(p[2][1]) || lower(p[2][2:]) || CASE WHEN p[1] = '' THEN 'w'
                 ELSE p[1] END || 'ay'
               ELSE lower(p[2]) || CASE WHEN p[1] = '' THEN 'w' ELSE p[1] END || 'ay' END),
                 ' ') AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
    """,
)
def _(source):
    texts = views.table(source, "documents").select("doc_id", "text")
    lines = texts.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), pig_latin(F.col("line")).alias("line"))
