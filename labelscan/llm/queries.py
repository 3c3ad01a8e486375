"""Registered queries of this package and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.llm.bottom_k import near_duplicates
from labelscan.llm.bpe_chunks import encode_decode
from labelscan.llm.common import pick, table
from labelscan.llm.compression_language import identify
from labelscan.llm.domain_mixing import mix
from labelscan.llm.hard_negatives import hard_negatives
from labelscan.llm.nn_descent import neighbours
from labelscan.llm.ordinal_toxicity import severity
from labelscan.llm.periodic_runs import periodic_runs, plant, run_digests
from labelscan.llm.pii_tagger import find_pii
from labelscan.llm.quality_cascade import quality_report
from labelscan.llm.relative_lz import remove_repeats
from labelscan.llm.token_counts import token_counts
from labelscan.llm.url_trust import judge

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), more=())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), full=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(plant(table(spark, sf_dir, "documents"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "embeddings"), vec_id="long", embedding="array<double>", label="long")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_domain_mixing, op2_nn_descent, op3_bpe_chunks, op4_token_counts, op5_url_trust, op6_substring_dedup, op7_pii,
        op8_minhash_near_dedup, op9_toxicity, op10_quality_rules, op11_periodic_runs,
        op12_hard_negatives, op13_language_id,
    )
}

#: Words of a text in DuckDB; the pattern keeps what is between ASCII white space.
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op6_substring_dedup": rf"""
with d as (select doc_id, {_WORDS.format("text")} w from documents),
win as (select doc_id, i, array_to_string(w[i:i+19], ' ') s from d, unnest(range(1, len(w) - 18)) t(i)),
dup as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) k from win) where k > 1),
gone as (select distinct doc_id, i + j i from dup, unnest(range(0, 20)) t(j)),
word as (select doc_id, i, w[i] x from d, unnest(range(1, len(w) + 1)) t(i)),
kept as (select doc_id, string_agg(x, ' ' order by i) s, count(*) n from word anti join gone using (doc_id, i) group by 1)
select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(s, '')) kept_sha256
from d left join kept using (doc_id)""",
    "op8_minhash_near_dedup": rf"""
with recursive d as (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
s as (select distinct doc_id, array_to_string(w[i:i+4], ' ') s from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on r.b = l.a)
select doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.b) component_id, doc_id = min(r.b) kept
from r join documents on doc_id = r.a left join n using (doc_id) group by doc_id""",
    "op10_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') t, {_WORDS.format("text")} w from documents),
win as (select doc_id, i, array_to_string(w[i:i+2], ' ') s from d, unnest(range(1, len(w) - 1)) t(i)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) k from win) where k > 1),
nr as (select doc_id, count(distinct i + j) r from rep, unnest(range(0, 3)) t(j) group by 1),
m as (select doc_id, t, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines, len(string_split(t, chr(10))) n_lines,
  coalesce(r, 0)::bigint n_repeat_words,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) up, length(t) - length(translate(t, 'abcdefghijklmnopqrstuvwxyz', '')) low
  from d left join nr using (doc_id)),
q as (select *, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_symbols > n_words * 0.1) and not (n_dup_lines > n_lines * 0.5)
  and not (case when up + low > 0 then up / (up + low) else 0 end > 0.5) and not (n_words > 0 and not (word_chars / n_words between 1.5 and 20)) kept
from q""",
    # the CRC bit by bit; runs are islands of places whose words equal those one period further
    "op11_periodic_runs": rf"""
with c as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) h from documents),
d as (select doc_id, h, h // 10 g, w, len(w) n from (select doc_id, {_WORDS.format("text")} w from documents) join c using (doc_id)),
e as (select doc_id, w, n, case when h % 10 = 0 and n > 0 then g % n else n end a, case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) else 1 end p from d),
word as materialized (select doc_id, n, i, w[1 + case when i < a then i else a + (i - a) % p end] x from e, unnest(range(0, n)) t(i)),
same as (select l.doc_id, l.i, r.i - l.i p from word l join word r on l.doc_id = r.doc_id and l.x = r.x and r.i > l.i and r.i - l.i <= l.n // 4),
isle as (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) k from same),
found as (select doc_id, min(i) s, count(*) + p z, p from isle group by doc_id, p, k having count(*) + p >= greatest(6, 4 * p)),
run as materialized (select doc_id, s, z, min(p) p from found group by doc_id, s, z),
gone as (select distinct doc_id, i from run, unnest(range(s + p, s + z)) t(i)),
kept as (select doc_id, string_agg(x, ' ' order by i) t from word anti join gone using (doc_id, i) group by 1),
sums as (select doc_id, count(*) n_runs, string_agg(s || ',' || z || ',' || p || chr(10), '' order by s, p) t from run group by 1),
top as (select * from run qualify row_number() over (partition by doc_id order by z desc, s, p) = 1)
select d.doc_id, coalesce(n_runs, 0)::bigint n_runs, top.s::bigint as start, top.z::bigint as length, top.p::bigint as period,
  (1000 * top.z // top.p)::bigint exponent_milli, sha256(coalesce(sums.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from d left join sums using (doc_id) left join top using (doc_id) left join kept using (doc_id)""",
    "op12_hard_negatives": """
with r as materialized (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) lab,
  list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from r where vec_id % 50 = 0),
s as materialized (select a.vec_id a, r.vec_id b, a.lab = r.lab same, list_inner_product(a.v, r.v)::bigint s from a join r on a.vec_id <> r.vec_id),
p as (select a, b p, s ps from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a anchor_id, p.p positive_id, (row_number() over (partition by p.a, p.p order by s desc, b))::int as rank, b negative_id, ps positive_score, s negative_score
from p join s on p.a = s.a and not same and 100 * s between 50 * ps and 95 * ps
qualify row_number() over (partition by p.a, p.p order by s desc, b) <= 3""",
}
