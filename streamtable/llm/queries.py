"""One query for each operator of this subpackage, over the whole of its table, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtable.llm import bpe, lm_score, toxicity
from streamtable.llm.decontaminate import contamination
from streamtable.llm.html_extract import extract
from streamtable.llm.jaccard_join import jaccard_components
from streamtable.llm.line_dedup import dedup_lines
from streamtable.llm.neighbours import nearest
from streamtable.llm.substring_dedup import dedup_passages
from streamtable.llm.suffix_dedup import dedup_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(column: str):
    return F.sha2(F.encode(F.col(column), "utf-8"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256("text").alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", sha256("text").alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), keep=("doc_id",))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.default_vocabulary(), keep=("doc_id",)))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    """poor is no category of toxicity; labels have only one, and quality is what else they tell of a document."""
    return toxicity.fit_chain(docs, labels, {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("n_links")


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_jaccard_join with each document's number of links."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_bpe": op6_bpe,
    "op7_neighbours": op7_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op9_jaccard_links": op9_jaccard_links,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, i, lines[i] as line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from parts)),
firsts as (select key, min(doc_id) as keep from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
told as (select l.*, f.keep is not null and l.doc_id > f.keep as gone from lines l left join firsts f on l.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from told group by doc_id""",
    "op2_decontamination": r"""
with texts as (select 0 as kind, doc_id as id, text from documents where doc_id is not null union all select 1, item_id, text from benchmark where item_id is not null),
split as (select kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from texts),
shingles as (select distinct kind, id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from split),
items as (select id as item_id, s, count(*) over (partition by id) as n_item from shingles where kind = 1)
select d.id as doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from shingles d join items using (s) where kind = 0 group by d.id, item_id, n_item having count(*) / n_item >= 0.8""",
    "op4_substring_dedup": r"""
with docs as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from docs)),
told as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first from windows) where first < doc_id),
gone as (select distinct doc_id, i + k as at from told, range(50) r(k)),
words as (select doc_id, i as at, w[i] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from docs)),
kept as (select w.doc_id, count(*) as n_words, count(g.at) as n_removed, string_agg(word, ' ' order by w.at) filter (g.at is null) as kept from words w left join gone g on w.doc_id = g.doc_id and w.at = g.at group by w.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs d left join kept k on d.doc_id = k.doc_id""",
    "op9_jaccard_join": r"""
with recursive docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from docs),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join sizes m on a.doc_id = m.doc_id join shingles b on a.s = b.s join sizes n on b.doc_id = n.doc_id where a.doc_id < b.doc_id and 100 * least(m.n, n.n) >= 90 * greatest(m.n, n.n) group by 1, 2),
links as (select x, y from pairs join sizes a on x = a.doc_id join sizes b on y = b.doc_id where 100 * c >= 90 * (a.n + b.n - c)),
ways as (select x, y from links union all select y, x from links),
same as (select doc_id, min(doc_id) over (partition by whole) as class_id from (select doc_id, string_agg(s, chr(0) order by s) as whole from shingles group by doc_id)),
reach as (select x, y from ways union select r.x, b.y from reach r join ways b on r.y = b.x)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce((select min(y) from reach r where r.x = d.doc_id), d.doc_id)) as component_id,
  coalesce(class_id, d.doc_id) as class_id
from docs d left join sizes z on d.doc_id = z.doc_id left join same c on d.doc_id = c.doc_id""",
}
ORACLE_SQL["op9_jaccard_links"] = ORACLE_SQL["op9_jaccard_join"].replace("as class_id\nfrom docs d", "as class_id,\n  (select count(*) from ways w where w.x = d.doc_id) as n_links\nfrom docs d")
