"""Duplicate documents: D1 to D7, and what rests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import documents, store
from spanloom.plans import fuzzy, tfidf
from spanloom.plans.components import components
from spanloom.queries.common import DOCS, docs
from spanloom.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "object_type", "text")


def dupes_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.duplicates(_texts(spark, d).select("id", "text"))


def dupes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.duplicates(_texts(spark, d), ["object_type"])


def dupes_marked(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    old = t.select("id", F.col("id").alias("root_id"))
    return store.reset_roots(old, tfidf.duplicates(t.select("id", "text"))).select("id", "root_id")


def mark_dupes_of_type(spark: SparkSession, d: str) -> DataFrame:
    """D4 with S7 on the document table: roots of one type are set anew, those of others stay."""
    all_docs = docs(spark, d)
    kind = "vacancy"
    found = tfidf.duplicates(documents.of_type(all_docs, kind))
    return store.reset_roots(all_docs, found, kind).select("id", "object_type", "root_id")


def term_weights(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their number of terms and the sum of term frequency times inverse document frequency."""
    t = _texts(spark, d)
    tf = t.select("id", F.explode(tfidf.terms(F.col("text"))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("c"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    n = t.count()
    idf = F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1
    return tf.join(df, "w").groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("c") * idf), 4).alias("weight"))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every term."""
    words = _texts(spark, d).select("id", F.explode(tfidf.terms(F.col("text"))).alias("w"))
    return words.groupBy("id", "w").agg(F.count("*").alias("c")).groupBy("w").agg(F.count("*").alias("df"), F.sum("c").alias("tf"))


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar classes, a class named by its smallest id."""
    return tfidf.similar_classes(_texts(spark, d).select("id", "text"))[1]


def exact_canonical(spark: SparkSession, d: str) -> DataFrame:
    """D5, D6 on exact repeats: whole texts at a length no text reaches."""
    t = _texts(spark, d).select(F.col("id").alias("idx"), "text")
    return fuzzy.canonical(t, 0.95, 1_000_000_000)


def exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    """D7, A13."""
    return fuzzy.clusters(exact_canonical(spark, d)).select("canonical", F.array_join("members", ",").alias("members"))


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select(F.col("id").alias("idx"), "text")


def fuzzy_document_edges(spark: SparkSession, d: str) -> DataFrame:
    """D5, J15 on whole documents, with the cut-off and length of the reference."""
    return fuzzy.edges(_long_texts(spark, d), fuzzy.CUTOFF, fuzzy.MIN_LENGTH)


def fuzzy_document_canonical(spark: SparkSession, d: str) -> DataFrame:
    """D5, D6 on whole documents: exact repeats and close matches."""
    return fuzzy.canonical(_long_texts(spark, d), fuzzy.CUTOFF, fuzzy.MIN_LENGTH)


def fuzzy_document_clusters(spark: SparkSession, d: str) -> DataFrame:
    """D7, A13 on whole documents."""
    return fuzzy.clusters(fuzzy_document_canonical(spark, d)).select("canonical", F.array_join("members", ",").alias("members"))


def fuzzy_canonical(spark: SparkSession, d: str) -> DataFrame:
    """D5, D6, J15 on typed keywords in order of id."""
    kw = table(spark, d, "keyword").select(F.col("id").alias("idx"), F.col("value").alias("text"))
    return fuzzy.canonical(kw, 0.85, 5)


def fuzzy_edges(spark: SparkSession, d: str) -> DataFrame:
    kw = table(spark, d, "keyword").select(F.col("id").alias("idx"), F.col("value").alias("text"))
    return fuzzy.edges(kw, 0.85, 5)


def link_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents tied by root_id in any way."""
    return components(table(spark, d, "nav_document").select(F.col("id").alias("a"), F.col("root_id").alias("b")))


QUERIES = {
    "dupes_tfidf": dupes_tfidf,
    "D3_dupes_by_type": dupes_by_type,
    "D4_M5_dupes_marked": dupes_marked,
    "D4_S7_mark_dupes_of_type": mark_dupes_of_type,
    "D1_term_weights": term_weights,
    "A15_term_frequencies": term_frequencies,
    "D2_J14_similar_pairs": similar_pairs,
    "D5_D6_exact_canonical": exact_canonical,
    "D7_A13_exact_clusters": exact_clusters,
    "D5_J15_fuzzy_document_edges": fuzzy_document_edges,
    "D6_fuzzy_document_canonical": fuzzy_document_canonical,
    "D7_A13_fuzzy_document_clusters": fuzzy_document_clusters,
    "D5_J15_fuzzy_edges": fuzzy_edges,
    "D6_fuzzy_canonical": fuzzy_canonical,
    "D3_link_components": link_components,
}


def _dupes_sql(source: str, part: bool) -> str:
    """Rows (part, id, cluster, root_id) of near-duplicates of source (part, id, text)."""
    p = "part" if part else "0"
    return f"""
with recursive src as materialized (select {p} as part, id, text from ({source})),
tf as materialized (select part, id, w, count(*) c from (select part, id,
    unnest(regexp_extract_all(lower(coalesce(text,'')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) w from src) group by all),
df as (select part, w, count(*) df from tf group by all), n as (select part, count(*) n from src group by part),
raw as (select part, id, w, df, c*(ln((1+n)/(1.0+df))+1) v from tf join df using (part, w) join n using (part)),
x as materialized (select part, id, w, df, v/sqrt(sum(v*v) over (partition by part, id)) v from raw),
pre as materialized (select * from (select *, coalesce(sum(v*v) over (partition by part, id order by df, w
    rows between unbounded preceding and 1 preceding),0) before from x) where before <= 1-0.98*0.98+1e-9),
cand as materialized (select distinct part, a.id a, b.id b from pre a join pre b using (part, w) where a.id<b.id and a.df>1),
pairs as materialized (select cand.part, a, b from cand join x p on p.id=a and p.part=cand.part join x q on q.id=b and q.part=cand.part and q.w=p.w
    group by all having sum(p.v*q.v) >= 0.98),
bare as (select part, id, min(id) over (partition by part) r, count(*) over (partition by part) k from src where id not in (select id from tf)),
e as materialized (select a, b from pairs union select b, a from pairs union select id, r from bare where id<>r union select r, id from bare where id<>r),
r(id, root) as (select distinct a, a from e union select e.b, r.root from r join e on e.a=r.id where r.root<e.b),
roots as (select id, min(root) root_id from r group by id),
out as (select part, id, dense_rank() over (partition by part order by root_id) - 1 as cluster, root_id from roots join src using (id))
"""


_DOCS = "select doc_id id, text from documents"
_EXACT = "(select idx, canonical from (select doc_id as idx, min(doc_id) over (partition by text) as canonical from documents where text is not null) where canonical < idx)"

ORACLE = {
    "dupes_tfidf": _dupes_sql(_DOCS, False) + "select id, cluster, root_id from out",
    "D3_dupes_by_type": _dupes_sql("select object_type part, doc_id id, text from documents", True) + "select part as object_type, id, cluster, root_id from out",
    "D4_M5_dupes_marked": _dupes_sql(_DOCS, False) + "select d.doc_id as id, case when o.root_id <> o.id then o.root_id end as root_id from documents d left join out o on o.id = d.doc_id",
    "D4_S7_mark_dupes_of_type": _dupes_sql(f"with {DOCS} select id, text from docs where object_type = 'vacancy'", False)
    + f"select d.id, d.object_type, case when d.object_type is distinct from 'vacancy' then d.root_id when o.root_id <> o.id then o.root_id end as root_id from (with {DOCS} select * from docs) d left join out o on o.id = d.id",
    "D2_J14_similar_pairs": _dupes_sql(_DOCS, False) + """, cls as (select id, min(id) over (partition by list_sort(regexp_extract_all(lower(coalesce(text,'')), '[\\p{L}\\p{N}_]{2,}'))) as c from src)
        select distinct least(p.c, q.c) as class_a, greatest(p.c, q.c) as class_b from pairs join cls p on p.id = a join cls q on q.id = b where p.c <> q.c""",
    "D1_term_weights": """with tf as (select doc_id id, w, count(*) c from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text,'')), '[\\p{L}\\p{N}_]{2,}')) w from documents) group by all),
df as (select w, count(*) df from tf group by w), n as (select count(*) n from documents)
select id, count(*) as terms, round(sum(c*(ln((1.0+n)/(1.0+df))+1)), 4) as weight from tf join df using (w), n group by id""",
    "A15_term_frequencies": """select w, count(*) as df, cast(sum(c) as bigint) as tf from (select doc_id, w, count(*) c from
(select doc_id, unnest(regexp_extract_all(lower(coalesce(text,'')), '[\\p{L}\\p{N}_]{2,}')) w from documents) group by all) group by w""",
    "D5_D6_exact_canonical": f"select * from {_EXACT}",
    "D7_A13_exact_clusters": f"select canonical, string_agg(idx::varchar, ',' order by idx) || ',' || canonical as members from {_EXACT} group by canonical",
    "D3_link_components": """with recursive e as (select distinct id a, root_id b from nav_document where id is not null and root_id is not null and id <> root_id),
u as materialized (select a, b from e union select b, a from e),
r(id, root) as (select distinct a, a from u union select u.b, r.root from r join u on u.a = r.id where r.root < u.b)
select id, min(root) as root from r group by id""",
}
