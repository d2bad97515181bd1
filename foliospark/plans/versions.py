"""Versions and duplicates of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import duplicates, versions
from foliospark.plans.documents import EMAIL
from foliospark.plans.registry import query
from foliospark.plans.retrieval import chunks
from foliospark.session import load, written


def edited(spark: SparkSession, d: str) -> DataFrame:
    """Each document's pages, and those of a later version of it: words of one spelling changed, some doubled, a last line."""
    old = chunks(spark, d).select(F.col("doc_id").alias("key"), F.lit("a").alias("side"), "page_num", "content")
    last = F.when(F.col("page_num") == 1, F.concat(F.lit("second version "), F.col("content"))).otherwise(F.col("content"))
    new = old.select("key", F.lit("b").alias("side"), "page_num", F.regexp_replace(F.regexp_replace(last, " (the|de|der) ", " this "), r" ([a-z]*ion) ", " $1 $1 ").alias("content"))
    return old.unionByName(new)


@query()
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """Runs of what is unchanged, removed and added in each document; tests rebuild both versions from them."""
    return versions.diff(edited(spark, d))


CHUNKS = r"""pages AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1)::INT AS page_num FROM (
  SELECT doc_id, list_filter(list_transform(range(0, CAST(ceil(length(text) / 3000.0) AS INT) + 1), lambda i: regexp_replace(substring(text, i * 3000 + 1, 3000), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)),
edited AS (SELECT doc_id, page_num, content AS a, regexp_replace(regexp_replace(CASE WHEN page_num = 1 THEN 'second version ' || content ELSE content END, ' (the|de|der) ', ' this ', 'g'), ' ([a-z]*ion) ', ' \1 \1 ', 'g') AS b FROM pages),
sides AS (SELECT doc_id, page_num, [x FOR x IN regexp_split_to_array(a, '[ \t\n\x0B\f\r]+') IF x <> ''] AS a, [x FOR x IN regexp_split_to_array(b, '[ \t\n\x0B\f\r]+') IF x <> ''] AS b FROM edited),
whole AS (SELECT doc_id, flatten(list(a ORDER BY page_num)) AS a, flatten(list(b ORDER BY page_num)) AS b FROM sides GROUP BY doc_id)"""


@query(f"WITH {CHUNKS} SELECT doc_id AS key, md5(array_to_string(a, ' ')) AS a, md5(array_to_string(b, ' ')) AS b, len(b) - len(a) AS grown FROM whole WHERE len(a) > 0")
def version_texts(spark: SparkSession, d: str) -> DataFrame:
    """Both versions, and how many words the later one has more, from the runs of the difference alone."""
    runs = written(versions.diff(edited(spark, d)), "runs")
    stats = versions.statistics(runs).select("key", (F.col("additions") - F.col("removals")).alias("grown"))
    return versions.rebuilt(runs).join(stats, "key").select("key", F.md5("a").alias("a"), F.md5("b").alias("b"), "grown")


PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: What may tell that two documents are of one person.
KEYS = f"""k0 AS (SELECT doc_id, lower(regexp_extract(text, '{EMAIL}')) AS mail, regexp_replace(regexp_extract(text, '{PHONE}'), '[^0-9]', '', 'g') AS phone FROM documents),
k AS (SELECT doc_id, 'm' || mail AS b FROM k0 WHERE mail <> '' UNION ALL SELECT doc_id, 'p' || right(phone, 10) FROM k0 WHERE length(phone) >= 7),
f AS (SELECT b, min(doc_id) AS v FROM k GROUP BY b HAVING count(*) > 1), l AS (SELECT doc_id AS u, v FROM k JOIN f USING (b) WHERE doc_id <> v), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id), s AS (SELECT id, root, count(*) OVER (PARTITION BY root) AS size FROM g)"""


def people(spark: SparkSession, d: str) -> DataFrame:
    found = lambda p: F.nullif(F.regexp_extract("text", p, 0), F.lit(""))
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), found(EMAIL).alias("email"), found(PHONE).alias("phone"), "lang", "source", "n_chars")


def grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = written(people(spark, d), "people")
    return duplicates.groups(rows, {"email": duplicates.email_key(F.col("email")), "phone": duplicates.phone_key(F.col("phone"))})


@query(f"WITH RECURSIVE {KEYS} SELECT id, root, size FROM s")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share an e-mail address or a telephone number, over any number of steps."""
    return grouped(spark, d)


@query(f"""WITH RECURSIVE {KEYS}, x AS (SELECT root, size, lower(lang) AS lang, lower(source) AS source, n_chars FROM s JOIN documents ON doc_id = id WHERE size > 1)
SELECT root, size, list_filter([CASE WHEN count(DISTINCT lang) > 1 THEN 'lang' END, CASE WHEN count(DISTINCT source) > 1 THEN 'source' END, CASE WHEN count(DISTINCT n_chars) > 1 THEN 'n_chars' END], lambda f: f IS NOT NULL) AS fields FROM x GROUP BY root, size""")
def group_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Groups of two or more, with the fields of which they have several values."""
    return duplicates.contradictions(people(spark, d), grouped(spark, d), ["lang", "source", "n_chars"])
