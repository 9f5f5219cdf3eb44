"""Queries opN_<name> of the thirteen operators, and their SQL where SQL can tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.llm import collocations, embeddings, fill_middle, html_text, mixing, packing, quality_model, rules, sharding, simhash, substring, toxicity, warc


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, most=4)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), most_tokens=4096)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"), fill_middle.Form(), unit="char")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, inside=80, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (
        op1_substring_dedup,
        op2_embedding_dedup,
        op3_quality_classifier,
        op4_simhash_dedup,
        op5_packing,
        op6_sharding,
        op7_mixing,
        op8_quality_rules,
        op9_html_text,
        op10_warc,
        op11_toxicity,
        op12_fill_in_middle,
        op13_collocations,
        pipeline,
    )
    return {f.__name__: f for f in named}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
with d as (select doc_id, {WORDS} as ws from documents),
w as (select doc_id, len(ws) as n, unnest(range(1, len(ws) + 1)) as i, ws from d),
x as (select doc_id, n, i, ws[i] as word, case when i <= n - 49 then md5(array_to_string(ws[i:i + 49], ' ')) end as h from w),
f as (select h, min(doc_id) as least from x where h is not null group by h),
c as (select x.doc_id, x.i, x.word, coalesce(max(case when f.least < x.doc_id then 1 else 0 end) over (partition by x.doc_id order by x.i rows between 49 preceding and current row), 0) as gone
      from x left join f on x.h = f.h),
k as (select doc_id, sum(gone) as removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from c group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""

OP2 = """
with recursive e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
links as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
          where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
reach as (select vec_id as id, vec_id as r from e union select reach.id, links.b from reach join links on links.a = reach.r),
c as (select id, min(r) as component_id from reach group by id),
n as (select a as id, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.component_id, e.vec_id = c.component_id as kept
from e join c on c.id = e.vec_id left join n on n.id = e.vec_id
"""

OP7 = rf"""
with d as (select doc_id, source, text, cast(len({WORDS}) as bigint) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
t as (select *, row_number() over (order by source nulls last) - 1 as turn from s),
w as (select *, cast(case turn % 3 when 0 then 5 when 1 then 2 else 1 end as bigint) as weight from t),
o as (select *, row_number() over (order by 3 * source_size / weight, turn) as k from w),
l as (select *, (select sum(source_size) from o) - 3 * coalesce(sum(source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest,
      sum(weight) over (order by k rows between current row and unbounded following) as others from o),
f as (select min(k) as k from l where rest * weight < 3 * source_size * others),
v as (select rest::double / others::double as level from l where k = (select k from f)),
g as (select source, source_size, case when (select k from f) is null or k < (select k from f) then (3 * source_size)::double else (select level from v) * weight end as target from l),
u as (select *, octet_length(encode(coalesce(text, ''))) / greatest(size, 1)::double as each,
      (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u from d),
k as (select *, -ln(u) / (case when each < 4 then greatest(0.25, each / 4) when each > 9 then greatest(0.25, 9 / each) else 1.0 end) as key from u),
p as (select k.doc_id, k.size, g.source_size, g.target, coalesce(sum(k.size) over (partition by k.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from k join g on k.source is not distinct from g.source),
q as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from p)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::bigint - start)) as bigint) as taken from q
"""


def _op8() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted(set(rules.STOP_WORDS)))
    verdict = " and ".join(f"{name} {sign} {limit!r}" for name, least, most in rules.RULES for sign, limit in ((">=", least), ("<=", most)) if limit is not None)
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from documents),
t as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
a as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from t) where c > 1),
r as (select doc_id, count(distinct i + k) as n from a, (select unnest(range(0, 3)) as k) group by doc_id),
b as (select d.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
      cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
      len(list_filter(ws, lambda w: lower(rtrim(w, '.,;:')) in ({stop}))) as n_stop, length(array_to_string(ws, '')) - len(regexp_extract_all(text, '[!-@\[-`{{-~]')) as letters, greatest(len(ls), 1) as n_lines,
      len(list_filter(ls, lambda l: rtrim(l) like '%...' or rtrim(l) like '%…')) as dots, len(list_filter(ls, lambda l: regexp_matches(ltrim(l), '^[-•*·]'))) as bullets
      from d left join r on r.doc_id = d.doc_id),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(word_chars / nullif(n_words, 0), 0) as mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) as symbols_per_word,
      coalesce(n_stop / nullif(n_words, 0), 0) as stop_word_ratio, n_dup_lines / n_lines as dup_line_ratio, dots / n_lines as ellipsis_line_ratio, bullets / n_lines as bullet_line_ratio,
      coalesce(letters / nullif(word_chars, 0), 0) as letter_ratio from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {verdict} as kept from m
"""


OP10 = """
with p as (select page_id, coalesce(html, '') as h, upper(sha1(coalesce(html, ''))) as x from pages),
m as (select x, max(page_id) as last from p group by x),
c as (select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, g * 5 + 1, 5))::bigint >> (15 - 5 * k)) & 31) + 1)::bigint, 1), '' order by g, k)
      from (select unnest(range(0, 8)) as g), (select unnest(range(0, 4)) as k)) as payload_digest from p)
select c.page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id <> last then last end as refers_to
from c join m on c.x = m.x
"""


OP12 = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, 'null')) as x from documents),
h as (select doc_id, text, length(text) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
      case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1, n - b) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""

OP13 = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) as piece from documents),
s as (select lang, regexp_extract_all(piece, '[^ 	]+') as ws from p),
n as (select lang, cast(sum(len(ws)) as bigint) as n from s group by lang),
g as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, m, count(*) as f from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from s, (select unnest(range(1, 5)) as m)) group by all having count(*) >= 30),
c as (select lang, phrase, m, f as a, string_split(phrase, ' ') as ws from g where m > 1),
k as (select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, cast((2000000 * a::hugeint) // (l.f + r.f) as bigint) as score
      from (select *, unnest(range(1, m)) as k from c) c join g l on l.lang = c.lang and l.phrase = array_to_string(ws[1:k], ' ') join g r on r.lang = c.lang and r.phrase = array_to_string(ws[k + 1:], ' ')),
b as (select lang, phrase, a, first(l order by score, k) as l, first(r order by score, k) as r, min(score) as score from k group by all),
x as (select lang, array_to_string(ws[i:i + z - 1], ' ') as phrase, max(a) as longest from (select *, unnest(range(1, m - z + 2)) as i from c, (select unnest(range(2, 4)) as z) where z < m) group by all),
t as (select b.* from b left join x on x.lang = b.lang and x.phrase = b.phrase where longest is null or 100 * longest::hugeint < 80 * a::hugeint),
o as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from t)
select o.lang, rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1,
        "op2_embedding_dedup": OP2,
        "op7_mixing": OP7,
        "op8_quality_rules": _op8(),
        "op10_warc": OP10,
        "op12_fill_in_middle": OP12,
        "op13_collocations": OP13,
    }
