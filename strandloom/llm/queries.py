"""The registered queries of this subpackage: every operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, hard_negatives, html_text, jpeg, langid, quality, secrets, simhash, substring_dedup, toxicity, trie
from .common import documents

BPE_RANKS = "byte_bpe_50k.tiktoken"


def ranks_path(name: str = BPE_RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store_and_read(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir), secrets.train(secrets.labelled_samples(spark))))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), ranks_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("pos", "end_pos")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_chat_format, op3_decontaminate, op4_language_id, op5_html_text, op6_media_jpeg, op7_toxicity, op8_simhash, op9_secret_scan, op10_bpe, op11_hard_negatives, op12_prefix_trie, op13_quality)}

#: Where SQL can say it; the others are tested against brute force.
ORACLE_SQL = {
    "op2_chat_format": """
with t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as place
    from conversations
), p as (
    select conv_id, place, count(*) over (partition by conv_id) as n_turns,
        string_agg(md5(role) || md5(text), '') over (partition by conv_id order by place) as prefix
    from t
), whole as (
    select prefix, n_turns, min(conv_id) as conv_id, count(*) as n_snapshots from p where place = n_turns group by prefix, n_turns
), kept as (
    select * from whole w where not exists (select 1 from p where p.place < p.n_turns and p.place = w.n_turns and p.prefix = w.prefix)
)
select k.conv_id, k.n_turns, k.n_snapshots,
    string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' order by t.place) as chat
from kept k join t on t.conv_id = k.conv_id group by all
""",
    "op11_hard_negatives": """
with e as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
    from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
""",
    "op12_prefix_trie": r"""
with ids as (
    select conv_id, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: [ascii(substr(conv_id::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end) as state
    from (select distinct conv_id from conversations where conv_id is not null)
), heads as (
    select conv_id, conv_id - conv_id % 20 as base, xor(state, 4294967295) % 4 as h from ids
), t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
    from conversations where conv_id is not null
), built as (
    select h.conv_id, 0 as own, t.place, t.role, t.text from heads h join t on t.conv_id = h.base and t.place <= h.h
    union all select h.conv_id, 1, t.place, t.role, t.text from heads h join t on t.conv_id = h.conv_id and t.place > h.h
), laid as (
    select conv_id, row_number() over w as depth, count(*) over (partition by conv_id) as n, string_agg(md5(role) || md5(text), '') over w as prefix, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
    from built window w as (partition by conv_id order by own, place)
), r as (
    select conv_id, depth, n, md5(prefix) as node, coalesce(lag(md5(prefix)) over (partition by conv_id order by depth), '') as parent, words from laid
    union all select h.conv_id, 0, (select count(*) from built b where b.conv_id = h.conv_id), '', null, 0 from heads h
), nodes as (
    select depth, node, min(conv_id) as conv_id, any_value(parent) as parent, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256
    from r group by depth, node
), full_nodes as (
    select x.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.parent = x.node and c.depth = x.depth + 1) as n_children
    from nodes x left join nodes p on p.node = x.parent and p.depth = x.depth - 1
), sums as (
    select r.depth, r.node, count_if(u.n_children = 0) as n_leaves, sum(u.saved) as saved_tokens
    from full_nodes u join r on r.conv_id = u.conv_id and r.depth <= u.depth group by r.depth, r.node
)
select x.conv_id, x.depth::bigint as depth, x.parent_conv_id, x.n_convs, x.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, x.ends_sha256
from full_nodes x join sums s on s.depth = x.depth and s.node = x.node
""",
}
