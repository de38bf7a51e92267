"""Queries over the ten operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import read
from . import alignment, chat, fingerprints, grades, lines, mixing, neardup, packing, passages, rules, secrets, vectors, whitening


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(read(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_components(read(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return grades.grade_documents(docs, grades.train(grades.graded(docs, read(spark, sf_dir, "labels"))))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digests(read(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # conversation -1 says the control strings of a common template
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.chat_digests(turns.unionByName(probe))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(read(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_embedding_near_dedup, op3_quality_rules, op4_secret_scan, op5_quality_classifier, op6_source_mixing, op7_substring_dedup, op8_chat_formatting, op9_packing, op10_minhash_near_dedup, op11_embedding_whitening, op12_tokenizer_alignment, op13_document_fingerprints)
}

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
SPACE = r"[\x20\x09-\x0D]+"
STOP = ",".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x},'&','&amp;'),'<','&lt;'),'[','&lsqb;'),'|','&vert;')"


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text,''), chr(10)) as ls from documents),
l as (select rid, doc_id, unnest(ls) as line, generate_subscripts(ls,1) as pos from d),
k as (select *, translate(regexp_replace(regexp_replace(line,'^{SPACE}',''),'{SPACE}$',''),{LOWER}) as key from l),
f as (select key, min(doc_id) as first from k where length(key)>=10 group by key having count(distinct doc_id)>1),
m as (select rid, doc_id, pos, line, coalesce(k.doc_id>f.first,false) as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
 sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by pos),'')) as kept_sha256
from m group by rid, doc_id""",
    "op2_embedding_near_dedup": """
with recursive v as (select vec_id, embedding::double[] as e, label from embeddings),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label=b.label and a.vec_id<>b.vec_id and list_cosine_similarity(a.e,b.e)>=0.98),
r(a,b) as (select a,b from p union select r.a,p.b from r join p on r.b=p.a),
n as (select a, count(*) as n from p group by a), c as (select a, min(b) as low from r group by a)
select vec_id, coalesce(n.n,0) as n_links, least(vec_id,coalesce(low,vec_id)) as component_id, vec_id<=coalesce(low,vec_id) as kept
from embeddings left join n on n.a=vec_id left join c on c.a=vec_id""",
    "op3_quality_rules": rf"""
with t as (select doc_id, coalesce(text,'') as t from documents),
d as (select row_number() over () as rid, doc_id, t, list_filter(string_split_regex(t,'{SPACE}'), lambda x: x<>'') as w,
 list_filter(string_split(t,chr(10)), lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')) as l from t),
g as (select rid, i, array_to_string(list_slice(w,i,i+7),' ') as k from d, unnest(range(1,len(w)-6)) u(i)),
h as (select rid, i from (select rid, i, count(*) over (partition by rid,k) as n from g) where n>1),
c as (select rid, count(distinct p) as n from h, unnest(range(i,i+8)) u(p) group by rid),
m as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(t,'{SPACE}','','g'))::bigint as word_chars, length(regexp_replace(t,'[^#*$%&|<>]','','g'))::bigint as n_symbols,
 (len(l)-len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n,0)::bigint as n_repeat_words, length(regexp_replace(t,'[^!]','','g')) as ex, len(l) as nl,
 len(list_intersect(list_distinct(w),[{STOP}])) as st from d left join c using (rid)),
b as (select *, n_words<20 or 100*n_repeat_words>30*n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and word_chars/n_words between 2.0 and 14.0 and n_symbols/n_words<=0.2 and ex/n_words<=0.5 and st>=1 and n_dup_lines/nl<=0.6 as kept from b""",
    "op6_source_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as z, [5,2,1][1+(row_number() over (order by source nulls last)-1)%3] as w from d group by source),
o as (select *, z*3.0::double as cap from s),
q as (select *, (sum(z) over ()) - coalesce(sum(cap) over (order by cap/w, source rows between unbounded preceding and 1 preceding),0) as rest,
 sum(w) over (order by cap/w desc, source desc rows between unbounded preceding and current row) as wt from o),
l as (select coalesce(max(rest::double/wt) filter (cap/w > rest::double/wt),max(cap/w)) as lv from q),
t as (select source, z, least(cap, w*lv)::double as target from o, l),
c as (select doc_id, size, z, target, case when z>0 then target/z else 0 end as rate,
 ('0x'||substr(md5(coalesce(doc_id::varchar,'null')||':mix'),1,12))::bigint::double/281474976710656.0 as coin
 from d join t on d.source is not distinct from t.source)
select doc_id, size, z as source_size, target, (size*(floor(rate)+case when coin<rate-floor(rate) then 1 else 0 end))::bigint as taken from c""",
    "op7_substring_dedup": rf"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text,''),'{SPACE}'), lambda x: x<>'') as w from documents),
g as (select rid, doc_id, i, array_to_string(list_slice(w,i,i+12),' ') as k from d, unnest(range(1,len(w)-11)) u(i)),
f as (select k, min(doc_id) as first from g group by k),
x as (select distinct rid, p from g join f using (k), unnest(range(i,i+13)) u(p) where first<doc_id),
r as (select rid, list(p) as ps from x group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(len(ps),0)::bigint as n_removed,
 sha256(array_to_string(case when ps is null then w else list_transform(list_filter(list_zip(w,range(1,len(w)+1)), lambda z: not list_contains(ps,z[2])), lambda z: z[1]) end,' ')) as kept_sha256
from d left join r using (rid)""",
    "op8_chat_formatting": f"""
with a as (select conv_id, turn, coalesce(role,'') as role, coalesce(text,'') as text from conversations
 union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over w - 1 as nth, coalesce(lag(role) over w,'') as before from a window w as (partition by conv_id order by turn nulls last, role, text)),
m as (select conv_id, coalesce(min(nth) filter (before||'>'||role not in ('>system','>user','system>user','user>assistant','assistant>user')), case when arg_max(role,nth)<>'assistant' then count(*) end) as bad_turn from o group by conv_id),
g as (select conv_id, count(*) as n_turns, sha256(string_agg(role||chr(10)||text||chr(10),'' order by turn nulls last, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role='assistant'),0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text,'' order by turn nulls last, role, text) filter (role='assistant'),'')) as loss_sha256,
 sum(length('<|'||{esc("role")}||'|>'||chr(10)||{esc("text")}||'</s>'||chr(10)))::bigint as formatted_chars
from a group by conv_id)
select g.*, bad_turn is null as valid, bad_turn from g join m on g.conv_id is not distinct from m.conv_id""",
    "op10_minhash_near_dedup": rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text,''),{LOWER}),'{SPACE}'), lambda x: x<>'') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w,i,i+4),' ') as k from d, unnest(range(1,len(w)-3)) u(i) where len(w)>=5
 union all select doc_id, array_to_string(w,' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k=b.k and a.doc_id<>b.doc_id group by 1,2),
e as (select a, b from p join n x on x.doc_id=a join n y on y.doc_id=b where 100*c>=75*(x.n+y.n-c)),
r(a,b) as (select a,b from e union select r.a,e.b from r join e on r.b=e.a),
m as (select a, min(b) as low from r group by a)
select doc_id, coalesce(n.n,0)::bigint as n_shingles, least(doc_id,coalesce(low,doc_id)) as component_id, doc_id<=coalesce(low,doc_id) as kept
from documents left join n using (doc_id) left join m on m.a=doc_id""",
}
