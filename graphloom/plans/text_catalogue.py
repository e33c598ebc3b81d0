"""Text operators over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.functions import text as T
from graphloom.operators import documents
from graphloom.plans.registry import query, rounded

#: In the SQL engine word boundaries and classes know ASCII alone, so other letters become one that no pattern takes.
PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ɏͰ-῿぀-ヿ一-鿿가-힣]', '_', 'g')"
TITLE = "split_part(text, chr(10), 1)"


def title() -> Column:
    return F.substring_index("text", "\n", 1)


def _digest(words) -> list:
    """How many, and a digest of all in order."""
    return [F.size(words).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(words), "|")).alias("digest")]


def _sql_digest(words: str) -> str:
    return f"len({words})::bigint as n, md5(array_to_string(list_sort({words}), '|')) as digest"


@query(f"select doc_id, {_sql_digest('w')} from (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z가-힣]{{2,}}'), lambda x: lower(x))) as w from documents where text is not null)")
def keyword_tokens(t):
    d = t("documents").where("text is not null").select("doc_id", T.keyword_tokens(F.col("text")).alias("w"))
    return d.select("doc_id", *_digest(F.col("w")))


STOP = ", ".join(f"'{w}'" for w in sorted(T.STOP))


@query(f"""with d as (select doc_id, {TITLE} as title, {PLAIN} as p, regexp_replace({TITLE}, '[À-ÖØ-öø-ɏͰ-῿぀-ヿ一-鿿가-힣]', '_', 'g') || chr(10) || {PLAIN} as x, {TITLE} || chr(10) || text as y from documents where text is not null),
f as (select doc_id, list_concat([trim(title, ' ')], regexp_extract_all(x, '\\b[A-Z][a-z]+(?:[ \\t\\n\\x0B\\f\\r]+[A-Z][a-z]+)+\\b'), regexp_extract_all(x, '\\b[A-Z][a-z]{{2,}}\\b'), regexp_extract_all(y, '\\(([A-Z]{{2,8}})\\)', 1),
  regexp_extract_all(y, '[「『“‘]([ -~가-힣ㄱ-ㅣ·\\-]+)[」』”’]', 1), regexp_extract_all(y, '\\((?:주|사|재|학|재단|사단)\\)(\\w+)', 1)) as f from d),
e as (select doc_id, lower(trim(p, ' ')) as p, i from (select doc_id, unnest(f) as p, unnest(generate_series(1, len(f))) as i from f)),
g as (select doc_id, p, min(i) as i from e where length(p) >= 2 and not regexp_full_match(p, '[0-9]+') and len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w not in ({STOP}))) > 0 group by all)
select doc_id, p as phrase from g qualify row_number() over (partition by doc_id order by i) <= 5""")
def english_phrases(t):
    d = t("documents").where("text is not null").select("doc_id", title().alias("title"), "text")
    return d.select("doc_id", F.explode(T.english_phrases(F.col("title"), F.col("text"))).alias("phrase"))


TAG_SQL = ", ".join("('{}', '(?i)\\b(?:{})\\b')".format(tag, "|".join(words)) for tag, words in T.TAGS.items())


@query(f"select doc_id, tag from (select doc_id, {PLAIN} as p from documents) d, (values {TAG_SQL}) v(tag, pattern) where regexp_matches(p, pattern)")
def regex_tags(t):
    return t("documents").select("doc_id", F.explode(T.tags(F.col("text"))).alias("tag"))


def _kind_sql() -> str:
    scores = {k: " + ".join(f"2 * contains(t, '{w}')::int + contains(c, '{w}')::int" for w in dict.fromkeys(words.lower().split(","))) for k, words in T.KINDS.items()}
    cols = ", ".join(f"{s} as {k}" for k, s in scores.items())
    top = f"greatest({', '.join(scores)})"
    which = " ".join(f"when {k} = top then '{k}'" for k in scores)
    return f"""with d as (select doc_id, lower({TITLE}) as t, lower(text) as c from documents where text is not null), s as (select doc_id, {cols} from d), m as (select *, {top} as top from s)
select doc_id, case when top = 0 then 'concept' {which} end as kind, round(least(1.0, top / 6.0::double), 6) as confidence from m"""


@query(_kind_sql())
def classify_kind(t):
    d = t("documents").where("text is not null").select("doc_id", T.classify_kind(title(), F.col("text")).alias("k"))
    return d.select("doc_id", F.col("k.kind").alias("kind"), F.round("k.confidence", 6).alias("confidence"))


SENTENCES = "string_split(regexp_replace(trim(text, ' '), '([.!?。])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""with s as (select doc_id, list_transform({SENTENCES}, lambda s: trim(s, ' ')) as s from documents where text is not null),
f as (select doc_id, list_distinct(list_filter(s, lambda s: s <> '' and regexp_matches(regexp_replace(s, '[À-ÖØ-öø-ɏͰ-῿]', '_', 'g'), '(?i){"|".join(f"(?:{p})" for p in T.FACTS)}'))) as f from s)
select doc_id, {_sql_digest('f')} from f""")
def extract_facts(t):
    d = t("documents").where("text is not null").select("doc_id", T.facts(F.col("text")).alias("f"))
    return d.select("doc_id", *_digest(F.col("f")))


@query(f"""with s as (select doc_id, {SENTENCES} as s from documents where text is not null),
x as (select doc_id, i, s, len(list_intersect(regexp_split_to_array(lower(s), '[\\s,;:!?()\\[\\]]+'), ['licensed', 'thereon', 'service'])) / 3.0::double + case when i = 1 then 0.1 else 0 end as r
  from (select doc_id, unnest(s) as s, unnest(generate_series(1, len(s))) as i from s)),
y as (select *, row_number() over (partition by doc_id order by r desc, i, s) as best, count(*) filter (r >= 0.3) over (partition by doc_id) as good, sum((r >= 0.3)::int) over (partition by doc_id order by i) as nth from x)
select doc_id, md5(string_agg(s, ' ' order by i)) as digest from y where case when good > 0 then r >= 0.3 and nth <= 5 else best <= 5 end group by doc_id""")
def compress_content(t):
    return t("documents").where("text is not null").select("doc_id", F.md5(T.compress(F.col("text"), "Licensed thereon, service")).alias("digest"))


#: Sentences by sentence: current sentences and their length; a full chunk leaves its last sentences, to 200 characters, for the next one.
CHUNKS = """with recursive s as (select doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?。\\n])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: true) as s from documents),
f(doc_id, i, cur, chunk, n) as (
  select doc_id, 1, [s[1]], null::varchar, 0 from s
  union all
  select f.doc_id, i + 1, case when full_ then list_append(list_filter(cur, lambda x, k: list_sum(list_transform(cur[k:], lambda y: length(y))) <= 200), s[i + 1]) else list_append(cur, s[i + 1]) end,
    case when full_ then array_to_string(cur, ' ') end, n + full_::int
  from (select f.*, s.s, list_sum(list_transform(cur, lambda y: length(y))) + length(s.s[i + 1]) > 1000 as full_ from f join s using (doc_id) where i < len(s.s)) f),
c as (select doc_id, n - 1 as chunk_index, chunk as text from f where chunk is not null
  union all select f.doc_id, f.n, array_to_string(f.cur, ' ') from f join s using (doc_id) where f.i = len(s.s))"""


@query(f"{CHUNKS} select doc_id, chunk_index::int as chunk_index, text from c")
def chunking(t):
    return documents.chunks(t("documents"))


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || substr(md5(concat_ws('->', {', '.join(parts)})), 1, 16)"


@query(f"""{CHUNKS} select {_id('doc_', 'doc_id::varchar')} as source_id, {_id('chunk_', 'doc_id::varchar', 'chunk_index::varchar')} as target_id, 'contains' as kind, 1.0::double as weight from c
union all select {_id('chunk_', 'doc_id::varchar', 'chunk_index::varchar')}, {_id('chunk_', 'doc_id::varchar', '(chunk_index + 1)::varchar')}, 'next_chunk', 1.0 from c where (doc_id, chunk_index + 1) in (select (doc_id, chunk_index) from c)""")
def next_chunk(t):
    return documents.chunk_edges(documents.chunks(t("documents")))


@query(f"""{CHUNKS} select d.doc_id, trim(substr(concat_ws(chr(10), trim({TITLE.replace('text', 'd.text')}, ' '), list_aggregate(list_filter(p.p, lambda x: x <> ''), 'string_agg', chr(10))), 1, 600), ' ') as preview
from documents d join (select doc_id, list(trim(text, ' ') order by chunk_index) as p from c group by 1) p on p.doc_id = d.doc_id where d.text is not null""")
def document_preview(t):
    d = t("documents").where("text is not null")
    parts = documents.chunks(d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("p"))
    texts = F.transform("p", lambda p: p["text"])
    return d.select("doc_id", title().alias("title")).join(parts, "doc_id").select("doc_id", T.preview(F.col("title"), texts).alias("preview"))


def _texts(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), title().alias("title"), F.col("text").alias("content"))


@query("""with p as (select doc_id as id, text, list_filter(list_transform(regexp_split_to_array(text, '[.。\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '') as s from documents where text is not null),
x as (select id, i, s, contains(lower(s), 'license')::int + contains(lower(s), 'thereon')::int as n from (select id, unnest(s) as s, unnest(generate_series(1, len(s))) as i from p)),
b as (select id, s, n from x qualify row_number() over (partition by id order by n desc, i) = 1)
select p.id, substr(case when coalesce(b.n, 0) > 0 then b.s else p.text end, 1, 240) as snippet from p left join b on b.id = p.id""")
def snippet(t):
    return _texts(t).where("content is not null").select("id", X.snippet(F.col("content"), ["license", "thereon"]).alias("snippet"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""with a as (select p_partkey, {GRAMS.format('p_name')} as x, {GRAMS.format("'larger widgets'")} as y from part)
select p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double, 6) as score from a where len(list_intersect(x, y)) >= 0.3 * len(list_distinct(list_concat(x, y)))""")
def trigram_search(t):
    p = t("part").select("p_partkey", T.trigram_similarity(F.col("p_name"), F.lit("larger widgets")).alias("score"))
    return p.where("score >= 0.3").select("p_partkey", rounded("score"))


@query("""with x as (select length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) as n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as en from documents where text is not null)
select case when n > 0 and en >= 0.5 * n then 'en' else 'multi' end as locale, count(*) as n from x group by 1""")
def detect_locale(t):
    return t("documents").where("text is not null").groupBy(T.detect_locale(F.col("text")).alias("locale")).agg(F.count("*").alias("n"))


@query("""with n as (select greatest(2, floor(count(*) * 0.3)) as least from documents), w as (select distinct doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: lower(x))) as token from documents)
select token, count(*) as n from w group by 1 having count(*) >= (select least from n) order by n desc, token limit 30""")
def stopword_suggestions(t):
    return documents.stopword_suggestions(t("documents"), share=0.3)
