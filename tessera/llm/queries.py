"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, langid, mixing, packing, quality, sharding, simhash, substrings, toxicity, warc
from .common import new_path


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_read(spark, sf_dir, "documents"))


OP8 = """
with recursive w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from documents where text is not null),
shingles as (
    select distinct doc_id, unnest(case when len(words) < 5 then [words] else list_transform(range(1, len(words) - 3), lambda i: list_slice(words, i, i + 4)) end) as s
    from w where len(words) > 0
), sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 5 * k >= 4 * (x.n + y.n - k)
    union select x.doc_id, y.doc_id from documents x join documents y on x.text = y.text and x.doc_id <> y.doc_id
), reach as (
    select doc_id as node, doc_id as low from documents
    union
    select links.b, reach.low from reach join links on links.a = reach.node and reach.low < links.b
)
select node as doc_id, min(low) as class_id, node = min(low) as kept from reach group by node
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer(), capacity=1024, end_id=2)


SHARD_BYTES = 1 << 20


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


OP1 = f"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents
), sources as (
    select source, sum(size)::double as s, row_number() over (order by source nulls last) - 1 as rank from sized group by source
), weights as (
    select *, (rank % 3 + 1)::double as w, 3.0 * s as cap from sources
), sorted as (
    select *, row_number() over (order by cap / w, source nulls last) as k, sum(cap) over (order by cap / w, source nulls last) as caps, sum(w) over (order by cap / w, source nulls last) as ws,
        sum(s) over () as total, sum(w) over () as all_w from weights
), level as (
    select arg_min(l, k) as l from (select (total - caps + cap) / (all_w - ws + w) as l, k, cap, w from sorted) where l <= cap / w
), targets as (
    select source, s, w, rank, case when l is null then cap else least(cap, l * w) end as target from sorted, level
), places as (
    select d.*, t.s::bigint as source_size, t.target, floor(t.target + 0.5)::bigint as take, t.w, t.rank,
        coalesce(sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from sized d join targets t on d.source is not distinct from t.source
), taken as (
    select *, (select coalesce(sum(greatest(0, least(size, take - k * source_size - start))), 0) from (select unnest([0, 1, 2, 3]) as k))::bigint as taken from places
)
select doc_id, size, source_size, round(target, 6) as target, taken,
    round(case when taken > 0 and start < take then
        case when rank % 2 = 0
            then 2 * (start / take::double * w) / (0.5 * w + sqrt(0.25 * w * w + 2 * w * (start / take::double * w)))
            else 2 * (start / take::double * w) / (1.5 * w + sqrt(2.25 * w * w - 2 * w * (start / take::double * w))) end end, 9) as position
from taken
"""


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


OP2 = """
with recursive x as (
    select vec_id, embedding::double[] as v, label from embeddings where label is not null and embedding is not null and len(embedding) > 0
        and list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e))) and list_bool_or(list_transform(embedding, lambda e: e <> 0))
), links as (
    select a.vec_id as a, b.vec_id as b from x a join x b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.98
), reach as (
    select vec_id as node, vec_id as low from embeddings
    union
    select links.b as node, reach.low from reach join links on links.a = reach.node and reach.low < links.b
), lowest as (select node, min(low) as component_id from reach group by node),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join lowest on lowest.node = vec_id left join counts on counts.a = vec_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_read(spark, sf_dir, "documents"))


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"))
    return judged.withColumn("class_distance", F.round("class_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def _quality_pass(k: int, sound: str) -> str:
    """References r{k} from the facts that `sound` names, and distances d{k} of all facts."""
    many = len(quality.CLASSES) + 2
    half = "case when {p} > 0 then {p} / 2 * log2(2 * {p} / ({p} + {q})) else 0 end + case when {q} > 0 then {q} / 2 * log2(2 * {q} / ({p} + {q})) else 0 end"
    classes = " + ".join(half.format(p=f"cl[{i}]", q=f"rc[{i}]") for i in range(1, many + 1))
    return f"""
rows{k} as (select unnest(case when lang is null then [null] else [lang, null] end) as ref, doc_id, n_words, cl from {sound}),
means{k} as (select ref, count(*) as n, [{', '.join(f'avg(cl[{i}])' for i in range(1, many + 1))}] as rc from rows{k} group by ref),
known{k} as (select * from means{k} where ref is null or n >= 20),
share{k} as (select r.ref, c.word, sum(c.n / r.n_words) / any_value(m.n) as q from rows{k} r join common c using (doc_id) join known{k} m on m.ref is not distinct from r.ref group by r.ref, c.word),
own{k} as (select f.*, case when f.lang in (select ref from known{k}) then f.lang end as ref from facts f),
in{k} as (
    select o.doc_id, sum({half.format(p='(c.n / o.n_words)', q='coalesce(s.q, 0)')}) as d, sum(c.n / o.n_words) as p, sum(coalesce(s.q, 0)) as q
    from own{k} o join common c using (doc_id) left join share{k} s on s.ref is not distinct from o.ref and s.word = c.word group by o.doc_id
),
all{k} as (select ref, sum(q) as a from share{k} group by ref),
d{k} as (
    select o.*, sqrt(greatest(0, {classes})) as class_distance,
        sqrt(greatest(0, coalesce(i.d, 0) + greatest(0, coalesce(a.a, 0) - coalesce(i.q, 0)) / 2 + ({half.format(p='greatest(0, 1 - coalesce(i.p, 0))', q='greatest(0, 1 - coalesce(a.a, 0))')}))) as word_distance
    from own{k} o join known{k} m on m.ref is not distinct from o.ref left join in{k} i using (doc_id) left join all{k} a on a.ref is not distinct from o.ref
),
kept{k} as (select * from d{k} where not base_failed and class_distance <= 0.158 and word_distance <= 0.32 + 2.2 / sqrt(n_words))"""


_LIST = ", ".join(f"'{w}'" for w in quality.COMMON)
OP4 = f"""
with t as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
starts as (select doc_id, i, list_slice(w, i, i + 2) as tri from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
again as (select doc_id, tri from starts group by all having count(*) > 1),
rep as (select doc_id, count(distinct pos) as n from (select doc_id, unnest([i, i + 1, i + 2]) as pos from starts join again using (doc_id, tri)) group by 1),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as l from t),
counts as (
    select t.doc_id, lang, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(text)::bigint as chars,
        [{', '.join(f"length(regexp_replace(text, '[^{c}]+', '', 'g'))::bigint" for c in [r'\p{Ll}', r'\p{Lu}', r'\p{Nd}', '#*$%&|<>', r".,;:!?''\x22()\-"])}] as c,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
    from t join lines using (doc_id) left join rep using (doc_id)
),
facts as (
    select doc_id, lang, n_words, word_chars, c[4] as n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        list_transform(list_concat(c, [word_chars - list_sum(c), chars - word_chars]), lambda x: x / chars) as cl from counts
),
common as (select doc_id, word, count(*)::double as n from (select doc_id, unnest(list_transform(w, lambda x: lower(x))) as word from t) where word in ({_LIST}) group by all),
sound as (select * from facts where not base_failed),{_quality_pass(0, 'sound')},{_quality_pass(1, 'kept0')}
select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, k.doc_id is not null as kept,
    case when not f.base_failed then round(d.class_distance, 6) end as class_distance, case when not f.base_failed then round(d.word_distance, 6) end as word_distance
from facts f left join d1 d using (doc_id) left join kept1 k using (doc_id)
"""


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), limit=SHARD_BYTES).drop("digest")


OP5 = f"""
with facts as (
    select doc_id, octet_length(encode(coalesce(text, '')))::bigint as bytes, coalesce(md5(text), '') as digest,
        row_number() over (partition by doc_id, text order by 1)::bigint as copy from documents
), keyed as (
    select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '#' || digest || '#' || copy::varchar), 1, 15))::bigint as k from facts
), nodes as (
    select d::int as d, (k >> (60 - d))::bigint as up, sum(bytes)::bigint as b, count(*)::bigint as n
    from keyed, (select unnest(range(0, 61)) as d) group by 1, 2
), fits as (
    select * from nodes where b <= {SHARD_BYTES} or n = 1 or d = 60
), least as (
    select k, copy, min(f.d) as d from (select k, copy, unnest(range(0, 61)) as d from keyed) x join fits f on f.d = x.d and f.up = x.k >> (60 - x.d) group by k, copy
)
select doc_id, bytes, keyed.copy, f.d::int as shard_depth, f.up as shard_prefix, f.b as shard_bytes, f.n as shard_docs
from keyed join least l on keyed.k = l.k and keyed.copy = l.copy join fits f on f.d = l.d and f.up = keyed.k >> (60 - l.d)
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_read(spark, sf_dir, "documents"))


OP6 = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w),
windows as (select doc_id, i, list_slice(words, i, i + 12) as win from starts),
firsts as (select win, min(doc_id) as m from windows group by win),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as at from windows join firsts using (win) where m < doc_id),
flat as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as at from w),
kept as (
    select f.doc_id, string_agg(word, ' ' order by f.at) as kept, count(*) as n from flat f left join gone g on g.doc_id = f.doc_id and g.at = f.at
    where g.at is null group by f.doc_id
)
select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_pages(_read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.page_records(warc.reassemble(warc.read_archives(archives)))


OP7 = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
first as (select payload_digest, min(page_id) as m from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest, case when m < page_id then 'revisit' else 'response' end as record_type, case when m < page_id then m end as refers_to
from p left join first on p.payload_digest = first.payload_digest and payload_bytes >= 100
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_divergence": op4_quality_divergence,
    "op5_extendible_sharding": op5_extendible_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc_segments": op7_warc_segments,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1, "op2_embedding_near_dedup": OP2, "op4_quality_divergence": OP4, "op5_extendible_sharding": OP5, "op6_substring_dedup": OP6, "op7_warc_segments": OP7, "op8_simhash_near_dedup": OP8}
