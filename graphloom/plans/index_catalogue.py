"""Queries answered from an index of trigrams, and many at once by one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import postings, search, tools
from graphloom.operators.lineage import written
from graphloom.plans.catalogue import BM25, _texts
from graphloom.plans.registry import query, rounded
from graphloom.plans.text_catalogue import GRAMS
from graphloom.plans.upkeep_catalogue import shared

MANY = """with d as (select doc_id as id, lower(coalesce(split_part(text, chr(10), 1), '')) as t, lower(coalesce(text, '')) as c from documents),
x as (select *, concat_ws(' ', t, c) as x, len(regexp_extract_all(concat_ws(' ', t, c), '\\S+')) as dl from d), s as (select count(*)::double as n, avg(dl) as mean from x),
q as (select id as query_id, regexp_extract_all(t, '\\S+')[1:4] as w from d where id % 50 = 0),
asked as (select query_id, 'term' as role, unnest(w) as needle, len(w) as terms from q union all select query_id, 'whole', array_to_string(w, ' '), len(w) from q where len(w) > 0
  union all select query_id, 'pair', unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])), len(w) from q where len(w) > 1),
h as (select needle, id, (length(c) - length(replace(c, needle, ''))) / length(needle)::double as tf, contains(t, needle) as it, dl from (select distinct needle from asked) join x on contains(x, needle)),
f as (select needle, count(*) as df from h group by 1),
v as (select query_id, id, terms, role = 'term' and (tf > 0 or it) as hit, case when role = 'pair' then 1.5 when role = 'whole' then 0 else (case when tf > 0 then ln((n - df + .5) / (df + .5) + 1) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * dl / mean)) else 0 end)
    + (case when it then 3 * ln((n - df + .5) / (df + .5) + 1) else 0 end) end as best,
  case when role = 'pair' then 1.5 when role = 'whole' then 3 * terms * it::int else 2 * it::int + (tf > 0)::int end as sub from h join f using (needle) join asked using (needle), s),
p as (select query_id, id, sum(best) as best, sum(sub) + case when any_value(terms) < 2 then 0 when sum(hit::int) >= .8 * any_value(terms) then 1.5 * any_value(terms) when sum(hit::int) >= .5 * any_value(terms) then .5 * any_value(terms) else 0 end as sub from v group by 1, 2),
r as (select query_id, id, round(best * least(.8, greatest(.1, (n - 500) / 5000)) + sub * (1 - least(.8, greatest(.1, (n - 500) / 5000))), 6) as score from p, s),
top as (select *, row_number() over (partition by query_id order by score desc, id) as rank from r where score > 0)"""


def _asked(t) -> DataFrame:
    """The first words of every fiftieth document's first line."""
    words = F.filter(F.split(F.lower(F.substring_index("text", "\n", 1)), r"\s+"), lambda w: w != "")
    return t("documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 1, 4), " ").alias("query"))


def _index(t) -> postings.Index:
    rows = postings.fields(_texts(t))
    return postings.Index.build(rows, shared(rows.sparkSession, "postings"))


@query(f"{MANY} select query_id, round(max(score), 6) as score, count(*) as n from top where rank <= 10 group by 1")
def bm25_many(t):
    """The best score of each query, and how many documents it finds."""
    found = postings.bm25_many(_asked(t), 10, postings.fields(_texts(t)))
    return found.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("n"))


@query(f"{MANY}, m as (select query_id, max(case when id = query_id then 1.0::double / rank else 0 end) as rr from (select query_id, id, rank() over (partition by query_id order by score desc) as rank from r where score > 0) where rank <= 10 group by 1) select query_id, round(rr, 6) as rr from m")
def retrieval_evaluation(t):
    """Reciprocal rank of the document that a query comes from, equal scores sharing a rank, over all queries at once."""
    asked = written(_asked(t), "asked")
    relevant = asked.select("query_id", F.col("query_id").alias("id"))
    # The first ten and the document itself: what is better than it stands before it, so its place, to the tenth, is that among all.
    found = postings.bm25_many(asked, 10, postings.fields(_texts(t)), also=relevant).select("query_id", "id", rounded("score"))
    shared_rank = found.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    return search.metrics(shared_rank, relevant, 10).select("query_id", rounded("rr"))


@query(BM25)
def bm25_indexed(t):
    index = _index(t)
    asked = index.spark.createDataFrame([(0, "thereon license")], "query_id int, query string")
    return postings.bm25_many(asked, 10, index=index).select("id", rounded("score"))


@query("select doc_id as id from documents where contains(lower(text), 'thereon') or contains(lower(text), 'license')")
def like_indexed(t):
    return _index(t).like("license thereon")


@query(f"""with a as (select p_partkey, {GRAMS.format('p_name')} as x, {GRAMS.format("'larger widgets'")} as y from part)
select p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double, 6) as score from a where len(list_intersect(x, y)) >= 0.3 * len(list_distinct(list_concat(x, y)))""")
def trigram_indexed(t):
    rows = postings.fields(t("part").withColumn("nothing", F.lit("")), "p_partkey", "p_name", "nothing")
    index = postings.Index.build(rows, shared(rows.sparkSession, "postings"))
    return index.similar("larger widgets").select(F.col("id").alias("p_partkey"), rounded("score"))


PARTS = MANY.replace("select id as query_id, regexp_extract_all(t, '\\S+')[1:4] as w from d where id % 50 = 0", "select 0 as query_id, ['license', 'thereon'] as w union all select 1, ['the', 'law'] union all select 2, ['under']")


@query(f"""{PARTS}, fused as (select id, sum(1.0::double / (60 + rank - 1)) as s from top where rank <= 15 group by id)
select id, round(0.10 + 0.85 * s / (select max(s) from fused), 6) as score from fused""")
def sub_query_search(t):
    """Three queries answered by one scan, their rankings fused."""
    docs = _texts(t)
    return tools.sub_query_scores(tools.searched(docs, ["license thereon", "the law", "under"], 15)).select("id", rounded("score"))


@query(f"""{PARTS}, l as (select id, query_id as list, (rank - 1) as rank from top where rank <= 5), m as (select * from l qualify row_number() over (partition by id order by list, rank) = 1)
select id, list::int as list, rank::int as rank from m order by list, rank, id limit 10""")
def compared_lists(t):
    """The same rankings one behind the other, each document where it comes first."""
    found = tools.merged_lists(tools.searched(_texts(t), ["license thereon", "the law", "under"], 5))
    return found.select("id", "list", F.col("rank").cast("int").alias("rank"))
