"""Identical, near and linked rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.functions.similarity import jaccard
from grainsift.functions.text import tokens
from grainsift.operators import duplicates, nearpairs
from grainsift.operators.graph import duplicate_clusters
from grainsift.plans.cleaning import deduplicate, fuzzy_dedup
from grainsift.registry import register
from grainsift.registry.views import PEOPLE_COLUMNS, PEOPLE_CTE, TWICE_CTE, orders_twice, people, table

_ALL = ", ".join(PEOPLE_COLUMNS)
GROUPS_CTE = f"{PEOPLE_CTE}, g AS (SELECT {_ALL}, count(*) AS n, min(row_id) AS first_id FROM people GROUP BY {_ALL})"


@register("exact_duplicates", f"""
WITH {GROUPS_CTE} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups,
CAST(sum(n) AS BIGINT) AS n_rows, round(sum(n - 1) / CAST(sum(n) AS DOUBLE), 4) AS duplicate_fraction FROM g""")
def exact_duplicates(spark, sf):
    return duplicates.exact_duplicates(people(spark, sf), "row_id")


_SAME = " AND ".join(f"p.{c} IS NOT DISTINCT FROM g.{c}" for c in PEOPLE_COLUMNS)


@register("duplicate_groups", f"""
WITH {GROUPS_CTE} SELECT g.first_id AS group_id, p.row_id FROM people p JOIN g ON {_SAME} WHERE g.n > 1""")
def duplicate_groups(spark, sf):
    return duplicates.duplicate_groups(people(spark, sf), "row_id")


@register("exact_dedup", f"WITH {GROUPS_CTE} SELECT first_id AS row_id, {_ALL} FROM g")
def exact_dedup(spark, sf):
    return duplicates.exact_dedup(people(spark, sf), "row_id")


@register("duplicate_columns", f"""
WITH {TWICE_CTE}, e AS (SELECT bool_and(o_custkey IS NOT DISTINCT FROM cust_copy) AS a,
bool_and(o_orderstatus IS NOT DISTINCT FROM status_copy) AS b, bool_and(o_custkey IS NOT DISTINCT FROM cust_next) AS c FROM twice)
SELECT 'cust_copy' AS column_name, 'o_custkey' AS same_as FROM e WHERE a UNION ALL
SELECT 'status_copy', 'o_orderstatus' FROM e WHERE b UNION ALL SELECT 'cust_next', 'o_custkey' FROM e WHERE c""")
def duplicate_columns(spark, sf):
    return duplicates.duplicate_columns(orders_twice(spark, sf))


_TEXT_ALL = ", ".join(f"CAST({c} AS STRING)" for c in PEOPLE_COLUMNS)


@register("duplicate_bytes", f"""
WITH {GROUPS_CTE}, b AS (SELECT CAST(coalesce(sum(n * strlen(concat({_TEXT_ALL}))), 0) AS BIGINT) AS bytes FROM g WHERE n > 1)
SELECT bytes AS duplicate_bytes, round(bytes / 1048576.0::DOUBLE, 6) AS duplicate_mb FROM b""")
def duplicate_bytes(spark, sf):
    return duplicates.duplicate_bytes(people(spark, sf), "row_id")


# --- neighbours ------------------------------------------------------------------------------

_CELLS = ", ".join(f"coalesce(CAST({c} AS STRING), 'nan')" for c in PEOPLE_COLUMNS)
NEAR_CTE = f"""ordered AS (SELECT row_number() OVER (ORDER BY row_id) AS pos, list_distinct([{_CELLS}]) AS s FROM people),
near AS (SELECT count(*) AS pairs FROM ordered a JOIN ordered b ON b.pos > a.pos AND b.pos <= a.pos + 4
  WHERE len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE) >= %s
  AND len(list_intersect(a.s, b.s)) < len(list_distinct(list_concat(a.s, b.s)))),
size AS (SELECT count(*) AS n FROM people)"""


@register("neighbour_range_join", f"""
WITH {PEOPLE_CTE}, {NEAR_CTE % '0.4'} SELECT pairs AS near_pairs, n AS n_compared FROM near, size""")
def neighbour_range_join(spark, sf):
    return duplicates.neighbour_pairs(people(spark, sf), "row_id", 0.4)


_ESTIMATE = """CAST(floor(pairs * 0.5) AS BIGINT) AS near_duplicate_pairs,
round(floor(pairs * 0.5::DOUBLE) / (n * (n - 1) / 2.0::DOUBLE), 6) AS near_duplicate_fraction"""


@register("near_dup_estimate", f"WITH {PEOPLE_CTE}, {NEAR_CTE % '0.4'} SELECT {_ESTIMATE} FROM near, size")
def near_dup_estimate(spark, sf):
    return duplicates.near_duplicate_estimate(people(spark, sf), "row_id", 0.4)


@register("duplicate_report", f"""
WITH {GROUPS_CTE}, {NEAR_CTE % '0.85'}, x AS (SELECT CAST(sum(n - 1) AS BIGINT) AS rows, sum(n - 1) / CAST(sum(n) AS DOUBLE) AS f FROM g)
SELECT rows AS exact_duplicate_rows, round(f, 4) AS exact_duplicate_fraction, {_ESTIMATE}, '' AS duplicate_columns
FROM x, near, size""")
def duplicate_report(spark, sf):
    return duplicates.duplicate_report(people(spark, sf), "row_id")


# --- near duplicates --------------------------------------------------------------------------

def near_sql(text: str, threshold: float, source: str = "documents", row_id: str = "doc_id") -> str:
    return fr"""toks AS (SELECT {row_id} AS id, list_sort(list_distinct(list_filter(string_split_regex({text}, '\s+'),
  lambda x: x <> ''))) AS t FROM {source}),
sets AS (SELECT min(id) AS rep, count(*) AS copies, t, len(t) AS k FROM toks GROUP BY t),
scored AS (SELECT a.rep AS id_a, b.rep AS id_b, a.copies AS copies_a, b.copies AS copies_b,
  len(list_intersect(a.t, b.t)) AS shared, a.k + b.k AS total FROM sets a JOIN sets b ON a.rep < b.rep
  AND a.k * {threshold} <= b.k + 1e-9 AND b.k * {threshold} <= a.k + 1e-9),
pairs AS (SELECT id_a, id_b, shared / CAST(total - shared AS DOUBLE) AS jaccard, copies_a, copies_b FROM scored
  WHERE shared / CAST(total - shared AS DOUBLE) >= {threshold} - 1e-9)"""


_OWN = "SELECT rep, rep, 1.0::DOUBLE, copies, copies, CAST(copies * (copies - 1) / 2 AS BIGINT) FROM sets WHERE copies > 1"


@register("near_dup_join", f"""
WITH {near_sql('lower(text)', 0.85)} SELECT id_a, id_b, round(jaccard, 6) AS jaccard, copies_a, copies_b FROM pairs""")
def near_dup_join(spark, sf):
    found = nearpairs.token_sets(table(spark, sf, "documents"), "doc_id", ["text"], lower=True)
    return nearpairs.similar_sets(found, 0.85).withColumn("jaccard", F.round("jaccard", 6))


@register("near_duplicates", f"""
WITH {near_sql('text', 0.9)}, every AS (SELECT *, copies_a * copies_b AS row_pairs FROM pairs UNION ALL {_OWN})
SELECT id_a, id_b, round(jaccard, 6) AS jaccard, copies_a, copies_b, row_pairs FROM every""")
def near_duplicates(spark, sf):
    return nearpairs.near_duplicates(table(spark, sf, "documents"), "doc_id", 0.9, ["text"]).withColumn(
        "jaccard", F.round("jaccard", 6))


@register("suggested_merges", f"""
WITH {near_sql('text', 0.9)}
SELECT id_a AS keep_id, id_b AS merge_id, round(jaccard, 6) AS score FROM pairs
UNION ALL SELECT rep, rep, 1.0 FROM sets WHERE copies > 1""")
def suggested_merges(spark, sf):
    pairs = nearpairs.near_duplicates(table(spark, sf, "documents"), "doc_id", 0.9, ["text"])
    return nearpairs.suggested_merges(pairs).withColumn("score", F.round("score", 6))


@register("minhash_candidates")
def minhash_candidates(spark, sf):
    found = nearpairs.token_sets(table(spark, sf, "documents"), "doc_id", ["text"])
    return nearpairs.minhash_pairs(found, 0.9)


# the greedy choice: pairs in order, each dropping its second unless its first was dropped
_GREEDY = """lost AS (SELECT unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), (SELECT list([id_a, id_b] ORDER BY id_a, id_b)
  FROM pairs)), lambda s, p: CASE WHEN list_contains(s, p[1]) OR list_contains(s, p[2]) THEN s ELSE list_append(s, p[2]) END)) AS rep),
by_row AS (SELECT t.id AS row_id, s.rep, coalesce(r.id_a, s.rep) AS kept_id, coalesce(r.jaccard, 1.0::DOUBLE) AS similarity
  FROM toks t JOIN sets s ON s.t = t.t LEFT JOIN (SELECT id_b, min(id_a) AS id_a, arg_min(jaccard, id_a) AS jaccard FROM pairs
    WHERE id_b IN (FROM lost) AND id_a NOT IN (FROM lost) GROUP BY id_b) r ON r.id_b = s.rep)"""


@register("fuzzy_dedup", f"""
WITH {near_sql('lower(text)', 0.9)}, {_GREEDY} SELECT doc_id, lang, source FROM documents JOIN by_row ON doc_id = row_id
WHERE row_id = kept_id""")
def q_fuzzy_dedup(spark, sf):
    return fuzzy_dedup(table(spark, sf, "documents"), "doc_id", 0.90, ["text"]).select("doc_id", "lang", "source")


_ROW_TEXT = "lower(concat_ws(' ', gender, income, category, email, notes, flag))"
_DEDUP = f"""{GROUPS_CTE}, one AS (SELECT first_id AS row_id, {_ALL} FROM g), {near_sql(_ROW_TEXT, 0.8, 'one', 'row_id')}, {_GREEDY},
removed AS (SELECT p.row_id, 'exact_duplicate' AS stage, g.first_id AS kept_id, 1.0::DOUBLE AS similarity FROM people p JOIN g ON {_SAME}
  WHERE p.row_id <> g.first_id
  UNION ALL SELECT row_id, 'near_duplicate', kept_id, similarity FROM by_row WHERE row_id <> kept_id)"""


@register("dedup_report", f"""
WITH {_DEDUP} SELECT count(*) FILTER (WHERE stage = 'exact_duplicate') AS exact_removed,
count(*) FILTER (WHERE stage = 'near_duplicate') AS fuzzy_removed, count(*) AS total_removed,
(SELECT count(*) FROM people) AS original_rows, (SELECT count(*) FROM people) - count(*) AS cleaned_rows,
CAST(0.8 AS DOUBLE) AS fuzzy_threshold FROM removed""")
def dedup_report(spark, sf):
    return deduplicate(people(spark, sf), "row_id", 0.8).report


@register("dedup_removals", f"WITH {_DEDUP} SELECT row_id, stage, kept_id, round(similarity, 6) AS similarity FROM removed")
def dedup_removals(spark, sf):
    return deduplicate(people(spark, sf), "row_id", 0.8).removed.withColumn("similarity", F.round("similarity", 6))


@register("duplicate_clusters", f"""
WITH RECURSIVE {near_sql('text', 0.9)},
edges AS (SELECT id_a AS u, id_b AS v FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
members AS (SELECT DISTINCT u AS id FROM edges UNION SELECT rep FROM sets WHERE copies > 1),
reach(id, label) AS (SELECT id, id FROM members UNION SELECT e.v, r.label FROM reach r JOIN edges e ON e.u = r.id),
labels AS (SELECT id, min(label) AS cluster_id FROM reach GROUP BY id)
SELECT cluster_id, CAST(sum(copies) AS BIGINT) AS n_rows, count(*) AS n_sets,
(SELECT count(*) FROM pairs p JOIN labels q ON p.id_a = q.id WHERE q.cluster_id = l.cluster_id) AS n_links
FROM labels l JOIN sets ON sets.rep = l.id GROUP BY cluster_id""")
def q_duplicate_clusters(spark, sf):
    return duplicate_clusters(nearpairs.near_duplicates(table(spark, sf, "documents"), "doc_id", 0.9, ["text"]))


@register("token_set_ops", r"""
WITH t AS (SELECT p_partkey, list_distinct(string_split_regex(lower(p_name), '\s+')) AS a,
list_distinct(string_split_regex(lower(concat(p_type, ' ', p_name)), '\s+')) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS together,
round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS jaccard FROM t""")
def token_set_ops(spark, sf):
    sets = table(spark, sf, "part").select(
        "p_partkey", tokens(F.lower("p_name")).alias("a"), tokens(F.lower(F.concat_ws(" ", "p_type", "p_name"))).alias("b"))
    return sets.select("p_partkey", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"),
                       F.size(F.array_union("a", "b")).cast("long").alias("together"),
                       F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))
