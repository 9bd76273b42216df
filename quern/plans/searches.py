"""Queries of text search by position and of near-miss look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import gazetteer, positional
from quern.operators.positional import All, Any, Not, Phrase, Term
from quern.plans.queries import query, t

#: Documents of one table, words of both of its fields.
FIELDS = ["text", "source"]
#: ("of the" in the text or "in the") and not "the the", or "that" and the source src2 and not "is" in the text.
ASKED = Any((All((Any((Phrase(("of", "the"), "text"), Phrase(("in", "the")))), Not(Phrase(("the", "the"))))), All((Term("THAT"), Term("src2", "source"), Not(Term("is", "text"))))))

WORDS_SQL = """w AS MATERIALIZED (SELECT doc_id, 'text' AS f, string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+') AS w FROM documents UNION ALL SELECT doc_id, 'source', string_split_regex(lower(coalesce(source, '')), '[^a-z0-9]+') FROM documents),
p AS MATERIALIZED (SELECT doc_id, f, x, i FROM (SELECT doc_id, f, unnest(w) AS x, unnest(range(len(w))) AS i FROM w) WHERE x IN ('of', 'the', 'in', 'that', 'is', 'src2')),
ph AS (SELECT DISTINCT a.doc_id, a.f, a.x || ' ' || b.x AS g FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.f = b.f AND b.i = a.i + 1),
d AS (SELECT DISTINCT doc_id FROM documents),
m AS (SELECT doc_id FROM d WHERE (
    (doc_id IN (SELECT doc_id FROM ph WHERE g = 'of the' AND f = 'text') OR doc_id IN (SELECT doc_id FROM ph WHERE g = 'in the')) AND doc_id NOT IN (SELECT doc_id FROM ph WHERE g = 'the the')
  ) OR (doc_id IN (SELECT doc_id FROM p WHERE x = 'that') AND doc_id IN (SELECT doc_id FROM p WHERE f = 'source' AND x = 'src2') AND doc_id NOT IN (SELECT doc_id FROM p WHERE f = 'text' AND x = 'is')))"""


@query(f"WITH {WORDS_SQL} SELECT doc_id FROM m")
def boolean_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    found = positional.match(positional.index(t(spark, d, "documents"), "doc_id", FIELDS), ASKED)
    return found.withColumnRenamed("key", "doc_id")


@query(f"""WITH {WORDS_SQL}, tf AS (SELECT doc_id, x, count(*) AS tf FROM p WHERE x IN ('of', 'the', 'in', 'that', 'src2') GROUP BY 1, 2), df AS (SELECT x, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum((1 + ln(tf)) * ln(1 + (SELECT count(*) FROM d) / df)), 6) AS score FROM m JOIN tf USING (doc_id) JOIN df USING (x) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50""")
def ranked_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    found = positional.search(positional.index(t(spark, d, "documents"), "doc_id", FIELDS), ASKED, n=50)
    return found.withColumnRenamed("key", "doc_id")


# ---- near misses


@query()
def near_miss_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of benchmark items that no document has, and the word of documents that each comes nearest to (difflib's ratio: no SQL)."""
    def words(name: str) -> DataFrame:
        return t(spark, d, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 5).distinct()

    return gazetteer.near_misses(words("benchmark"), words("documents"), term="w", name="w")
