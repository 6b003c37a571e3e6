"""The registered queries of the operators, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.catalog import registry
from docweave.llm import quality, toxicity
from docweave.llm.conversation_trie import conversation_trie
from docweave.llm.exact_dedup import exact_groups
from docweave.llm.filter_audit import filter_audit
from docweave.llm.mixing import poisson_mix
from docweave.llm.near_dedup import near_groups
from docweave.llm.packing import pack_documents
from docweave.llm.substring_dedup import remove_repeats
from docweave.llm.token_counts import token_counts
from docweave.llm.topk_search import best_products
from docweave.llm.vector_search import nearest
from docweave.llm.url_filter import RULES, judge_urls

QUERIES: dict = {}
ORACLES: dict = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(registry.Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_toxic_lexicon")
def op1(t):
    return toxicity.judged(t.documents, t.labels)


@query("op2_repeated_strings")
def op2(t):
    return remove_repeats(t.documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_prefix_forest")
def op3(t):
    return nearest(t.embeddings, F.col("vec_id") % 20 == 0)


@query("op4_bounded_packing")
def op4(t):
    pieces = pack_documents(t.documents, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)


@query("op5_url_cascade", f"""
with u as (select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as pos from pages),
p as (select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as rest from u),
h as (select page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1, 's') as raw_host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2, 's') as path from p),
k as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h),
m as (select k.page_id, max_by(r.h || r.p, length(r.h || r.p)) as rule, max_by(r.a, length(r.h || r.p)) as action
      from k join (values {_RULE_ROWS}) r(h, p, a)
        on (k.host = r.h or ends_with(k.host, '.' || r.h)) and starts_with(k.path, r.p) group by 1)
select k.page_id, k.host, k.path, m.rule, coalesce(m.action, 'allow') as verdict from k left join m using (page_id)
""")
def op5(t):
    return judge_urls(t.pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op6_exact_dedup", r"""
with n as (select doc_id, length(coalesce(text, '')) as points,
                  sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g')) as text_sha256 from documents),
g as (select *, first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id,
             count(*) over (partition by text_sha256) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
""")
def op6(t):
    return exact_groups(t.documents)


@query("op7_attention_quality")
def op7(t):
    return quality.judged(t.documents, t.labels)


@query("op8_poisson_mix", """
with s as (select source, cast(sum(length(coalesce(text, ''))) as double) as size from documents group by 1),
w as (select source, size, case when size > 0 then pow(size, 0.7) else 0.0 end as target from s),
r as (select source, case when size > 0 then target / sum(target) over () * sum(size) over () / size else 0.0 end as rate from w),
c as (select source, rate, list_transform(range(0, cast(ceil(rate + 10 * sqrt(rate) + 20) as bigint) + 1),
             lambda k: exp(-rate + k * ln(rate) - lgamma(k + 1))) as p from r where rate > 0),
q as (select source, list_transform(range(1, len(p) + 1), lambda k: list_sum(p[1:k])) as steps from c),
d as (select documents.*, cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / 4503599627370496.0 as u
      from documents),
n as (select d.*, len(list_filter(steps, lambda x: x <= u)) as n from d join q on d.source is not distinct from q.source)
select doc_id, text, lang, source, n_chars, cast(unnest(range(1, n + 1)) as integer) as copy from n
""")
def op8(t):
    return poisson_mix(t.documents)


@query("op9_near_groups")
def op9(t):
    return near_groups(t.documents, 85)


@query("op10_token_counts")
def op10(t):
    return token_counts(t.documents, tokenizer("byte_bpe_50k.json"))


@query("op11_filter_audit", r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by text) as lo from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (select part, (case when len(ws) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end)
             || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end)
             || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when lo < w.doc_id then 'E' else '' end) as fails,
             coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l on w.doc_id = l.doc_id),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
      where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as earlier
      from o, (select unnest([1, 2, 3, 4, 5]) as step)),
h as (select part, filter_order, step, letter, fails, n, good, toxic, contains(fails, letter) as hit,
             translate(fails, earlier, '') = fails as there from c, s),
r as (select part, filter_order, step, letter, sum(case when there and not hit then n else 0 end) as kept,
             sum(case when there and hit then n else 0 end) as removed, sum(case when hit and not there then n else 0 end) as redundant,
             sum(case when fails = letter then n else 0 end) as unique_fails, sum(case when there and hit then good else 0 end) as good_lost,
             sum(case when there and hit then toxic else 0 end) as toxic_lost from h group by 1, 2, 3, 4)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, letter) as bigint) as shapley from r
""")
def op11(t):
    return filter_audit(t.documents, t.labels)


@query("op12_conversation_trie", """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
c as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from t group by 1),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda s: ascii(s)::bigint)),
                    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                                            lambda x, z: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint) % 6 as h from c),
r as (select h.conv_id, coalesce(b.turns[1:h], []) || h.turns[h + 1:] as path from h left join c b on b.conv_id = h.conv_id - h.conv_id % 100),
v as (select conv_id, d as depth, md5(to_json(path[1:d])::varchar) as key, case when d > 0 then md5(to_json(path[1:d - 1])::varchar) end as parent,
             case when d > 0 then length(path[d].text) else 0 end as points, d = len(path) as ends
      from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from r)),
n as (select key, depth, parent, min(conv_id) as conv_id, count(*) as n_convs, max(points) as points, bool_and(ends) as leaf,
             string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends) as ids from v group by 1, 2, 3),
s as (select top, count(*) filter (leaf) as n_leaves, sum((n_convs - 1) * points) as saved_tokens
      from (select distinct a.key as top, b.key as key from v a join v b on a.conv_id = b.conv_id and b.depth >= a.depth) join n using (key) group by 1),
k as (select parent as key, count(*) as n_children from n where parent is not null group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(n.ids, '')) as ends_sha256
from n join s on s.top = n.key left join k on k.key = n.key left join n p on p.key = n.parent
""")
def op12(t):
    return conversation_trie(t.conversations)


@query("op13_no_random_access", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 10
""")
def op13(t):
    return best_products(t.embeddings, F.col("vec_id") % 100 == 0)
