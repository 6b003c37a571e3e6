"""Duplicates, profiles, quality scans and text repair over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from docweave import fixed
from docweave.catalog.registry import query
from docweave.functions import text as tx
from docweave.operators import dedup, profile

_SQL_ABBREVIATIONS = f"'{fixed.ABBREVIATIONS}'"


def _pages():
    """Pages are not part of the tables: 3,000 characters count as one."""
    return F.ceil(F.length("text") / 3000)


def _bytes(col):
    return F.octet_length(col)


# --- duplicates -----------------------------------------------------------------------------
@query("ded1_exact_duplicates", """
    select doc_id as copy_id, first_id as original_id, h as group_key
    from (select doc_id, sha256(text) as h, min(doc_id) over (partition by text) as first_id from documents)
    where doc_id <> first_id""")
def exact_duplicates(t):
    return dedup.duplicate_pairs(t.documents, dedup.byte_key(F.col("text")), "doc_id")


NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("ded2_content_groups", f"""
    select sha256({NORMAL}) as group_key, min(doc_id) as first_id, count(*) as members
    from documents group by {NORMAL} having count(*) > 1""")
def content_groups(t):
    return dedup.duplicate_groups(t.documents, dedup.content_key(F.col("text")), "doc_id")


@query("ded2_content_members", f"""
    select doc_id as copy_id, first_id as original_id, sha256(n) as group_key
    from (select doc_id, {NORMAL} as n, min(doc_id) over (partition by {NORMAL}) as first_id from documents)
    where doc_id <> first_id""")
def content_members(t):
    return dedup.duplicate_pairs(t.documents, dedup.content_key(F.col("text")), "doc_id")


@query("ded2_content_total", f"""
    select count(*) as groups, cast(sum(n - 1) as bigint) as duplicates
    from (select count(*) as n from documents group by {NORMAL} having count(*) > 1)""")
def content_total(t):
    groups = dedup.duplicate_groups(t.documents, dedup.content_key(F.col("text")), "doc_id")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("members") - 1).alias("duplicates"))


@query("ded2_curated_corpus", f"""
    select doc_id, lang, n_chars from documents
    qualify row_number() over (partition by {NORMAL} order by doc_id) = 1""")
def curated(t):
    return dedup.keep_first(t.documents, dedup.content_key(F.col("text")), "doc_id").select("doc_id", "lang", "n_chars")


SUFFIX_SQL = """p_name || case p_partkey % 7 when 0 then '' when 1 then ' copy' when 2 then ' (2)' when 3 then ' - copy'
    when 4 then '_copy' when 5 then '-copy' else ' copy 3' end || '.pdf'"""


@query("ded3_name_groups", f"""
    with f as (select p_partkey, {SUFFIX_SQL} as file from part)
    select case p_partkey % 7 when 3 then p_name || ' -' else p_name end as group_key, min(p_partkey) as first_id, count(*) as members
    from f join part using (p_partkey) group by 1 having count(*) > 1""")
def name_groups(t):
    named = t.part.withColumn("file", F.expr(SUFFIX_SQL))
    return dedup.duplicate_groups(named, tx.file_key(F.col("file")), "p_partkey")


@query("ded4_distinct_lines", r"""
    select doc_id, count(*) as lines, count(distinct line) as distinct_lines
    from (select doc_id, trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) as line
          from documents) group by doc_id""")
def distinct_lines(t):
    lines = F.split("text", "\n")
    return t.documents.select(
        "doc_id", F.size(lines).cast("long").alias("lines"),
        F.size(tx.clean_list(lines)).cast("long").alias("distinct_lines"))


@query("ded5_first_per_name", """
    select lower(c_mktsegment) as name, min(c_custkey) as c_custkey,
           arg_min(c_acctbal, c_custkey) as c_acctbal from customer group by 1""")
def first_per_name(t):
    named = t.customer.select(F.lower("c_mktsegment").alias("name"), "c_custkey", "c_acctbal")
    return dedup.first_per_key(named, ["name"], ["c_custkey"])


# --- profiles -------------------------------------------------------------------------------
WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
PROFILE = rf"""select doc_id as file_name, cast(ceil(length(text) / 3000) as bigint) as pages,
    round(strlen(text) / 1024, 2) as file_size_kb, regexp_matches(text, '\S') as has_text,
    cast({WORDS} as bigint) as word_count, length(text) as character_count,
    case when text is null then 'Corrupted' else 'Valid' end as status from documents"""
SUMMARY = """count(*) as documents, count(*) filter (status = 'Valid') as valid,
    count(*) filter (status = 'Corrupted') as corrupted, count(*) filter (has_text) as with_text,
    count(*) filter (not has_text) as without_text, cast(sum(pages) as bigint) as total_pages,
    round(avg(pages), 2) as avg_pages, max(pages) as max_pages, min(pages) as min_pages,
    cast(sum(word_count) as bigint) as total_words, round(avg(word_count), 2) as avg_words,
    cast(sum(character_count) as bigint) as total_characters, round(avg(character_count), 2) as avg_characters,
    first(file_name order by word_count desc, file_name) as largest_document,
    first(file_name order by word_count, file_name) as smallest_document"""


def profiled(t):
    return profile.profile(t.documents, "doc_id", "text", _pages(), _bytes("text"))


@query("src1_document_scan", "select doc_id, source, strlen(text) as size_bytes from documents")
def document_scan(t):
    return t.documents.select("doc_id", "source", _bytes("text").cast("long").alias("size_bytes"))


@query("prf1_profile", PROFILE)
def profile_rows(t):
    return profiled(t)


@query("agg1_profile_summary", f"select {SUMMARY} from ({PROFILE})")
def summary(t):
    return profile.profile_summary(profiled(t))


@query("agg1_summary_by_language", f"""
    with kept as (select * from documents qualify row_number() over (partition by {NORMAL} order by doc_id) = 1)
    select lang, {SUMMARY} from (select p.*, lang from ({PROFILE.replace('from documents', 'from kept')}) p
    join kept on p.file_name = kept.doc_id) group by lang""")
def curated_summary(t):
    """Profile and content key come from one scan; only those few columns are shuffled, never a text."""
    key = dedup.content_key(F.col("text")).alias("content_key")
    rows = profile.profile(t.documents, "doc_id", "text", _pages(), _bytes("text"), [key, F.col("lang")])
    return profile.profile_summary(dedup.first_per_key(rows, ["content_key"], ["file_name"]), ["lang"])


@query("prf2_preview", r"""
    with s as (select * from documents order by sha256(cast(doc_id as varchar)), doc_id limit 25),
    l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from s),
    k as (select doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') as line, i from l),
    n as (select doc_id, line, row_number() over (partition by doc_id order by i) - 1 as line_no from k where line <> '')
    select doc_id, cast(line_no as bigint) as line_no, line from n where line_no < 30""")
def preview(t):
    return profile.preview(t.documents, "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


@query("qua1_encoding_summary", """
    with c as (select length(text) - length(replace(replace(text, 'ä', ''), 'é', '')) as c,
               length(text) - length(replace(text, chr(65533), '')) as b from documents)
    select count(*) filter (c > 0 or b > 0) as contaminated, count(*) filter (c = 0 and b = 0) as clean,
           cast(sum(c) as bigint) as marker_hits, cast(sum(b) as bigint) as replacement_characters from c""")
def encoding_summary(t):
    return profile.encoding_summary(t.documents, "text", ["ä", "é"])


@query("qua1_encoding_hits", """
    with c as (select doc_id, text, generate_subscripts(string_split(text, ''), 1) as i, unnest(string_split(text, '')) as marker from documents)
    select doc_id, i - 1 as at, marker, substr(text, greatest(i - 5, 1), i + 8 - greatest(i - 5, 1)) as context
    from c where marker in ('ä', 'é')""")
def encoding_hits(t):
    return profile.encoding_hits(t.documents, "doc_id", "text", ["ä", "é"])


PROPS = """case when event_type = 'error' then '{' || props when event_type = 'click' then '{"j": 1}'
    when event_type = 'view' then replace(replace(props, ': ', ': "'), '}', '"}') else props end"""


@query("qua2_schema_errors", f"""
    with e as (select event_id, {PROPS} as raw from events)
    select event_id,
      case when not json_valid(raw) then '<root>' else 'k' end as field,
      case when not json_valid(raw) then 'not JSON' when json_extract(raw, '$.k') is null then 'field required'
           else 'wrong type' end as message,
      case when json_valid(raw) then cast(json_extract(raw, '$.k') as varchar) end as value
    from e where not json_valid(raw) or json_type(raw, '$.k') is distinct from 'UBIGINT'""")
def schema_errors(t):
    rows = t.events.select("event_id", F.expr(PROPS).alias("raw"))
    return profile.json_field_errors(rows, "event_id", "raw", {"k": "BIGINT|TINYINT|SMALLINT|INT|LONG"})


ORDER_TYPE = ("order struct<id: bigint not null, priority: string not null, note: string> not null, "
              "items array<struct<part: bigint not null, tags: array<string>, price: struct<net: double not null>>> not null")


@query("qua2_nested_errors", """
    with o as (select o_orderkey, o_custkey, o_orderkey % 17 <> 0 as readable, o_orderkey % 13 = 0 as no_list from orders),
    l as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i
          from lineitem join o on o_orderkey = l_orderkey where readable and not no_list)
    select o_orderkey, '<root>' as field, 'not JSON' as message, null as value from o where not readable
    union all select o_orderkey, 'order.id', 'wrong type', '"' || o_orderkey || '"' from o where readable and o_orderkey % 7 = 0
    union all select o_orderkey, 'order.priority', 'field required', null from o where readable and o_custkey % 5 = 0
    union all select o_orderkey, 'order.note', 'wrong type', '[1]' from o where readable and o_custkey % 5 = 1
    union all select o_orderkey, 'items', 'wrong type', '{"x":1}' from o where readable and no_list
    union all select l_orderkey, 'items.' || i || '.part', 'wrong type', 'null' from l where l_partkey % 11 = 0
    union all select l_orderkey, 'items.' || i || '.tags.1', 'wrong type', cast(l_linenumber as varchar) from l where l_suppkey % 3 = 0
    union all select l_orderkey, 'items.' || i || '.price.net', 'field required', null from l where l_linenumber = 2""")
def nested_errors(t):
    """Orders with their items as nested JSON, in which some leaves are missing or of another type."""
    item = """concat('{"part":', case when l_partkey % 11 = 0 then 'null' else string(l_partkey) end, ',"tags":["a",', case when l_suppkey % 3 = 0 then string(l_linenumber) else '"b"' end,
        '],"price":{', case when l_linenumber = 2 then '' else concat('"net":', cast(l_extendedprice as string)) end, '}}')"""
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.expr(item).alias("j")))), lambda x: x["j"]), ",").alias("items"))
    raw = """concat('{"order":{"id":', case when o_orderkey % 7 = 0 then concat('"', o_orderkey, '"') else string(o_orderkey) end, case when o_custkey % 5 = 0 then '' else ',"priority":"high"' end,
        case when o_custkey % 5 = 1 then ',"note":[1]' when o_custkey % 5 = 2 then ',"note":null' else '' end, '},"items":',
        case when o_orderkey % 13 = 0 then '{"x":1}' else concat('[', coalesce(items, ''), ']') end, case when o_orderkey % 17 = 0 then '' else '}' end)"""
    texts = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.expr(raw).alias("raw"))
    return profile.json_errors(texts, "o_orderkey", "raw", T.StructType.fromDDL(ORDER_TYPE))


@query("qua4_missing_fields", f"""
    with e as (select event_id, {PROPS} as raw from events)
    select event_id, case when json_valid(raw) and list_contains(json_keys(raw), 'k') then 'page' else 'k,page' end as missing
    from e""")
def missing_fields(t):
    rows = t.events.select("event_id", F.expr(PROPS).alias("raw"))
    found = profile.missing_json_fields(rows, "event_id", "raw", ["k", "page"])
    return found.withColumn("missing", F.array_join("missing", ","))


@query("qua5_name_markers", """
    select p_partkey, p_name, case when contains(lower(p_name), 'ring') then 'ring' else 'red' end as marker
    from part where contains(lower(p_name), 'ring') or contains(lower(p_name), 'red')""")
def name_markers(t):
    return profile.name_markers(t.part, "p_partkey", "p_name", ["ring", "red"])


# --- text repair ----------------------------------------------------------------------------
@query("txt1_mojibake_repair", "select doc_id, case when regexp_matches(text, '[ÁÍÏÐÝà]') then null else sha256(text) end as digest from documents")
def mojibake(t):
    """Every document misread as Windows-1252 and repaired: what comes back is the text itself.

    Lost are letters with a byte that Windows-1252 does not have, or reads as a space; such texts have no digest."""
    marks = [(chr(code), name) for code in range(0x80, 0xA0) if (name := bytes([code]).decode("cp1252", "ignore"))]
    read = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), "".join(a for a, _ in marks), "".join(b for _, b in marks))
    repaired = tx.repair_mojibake(read)
    return t.documents.select("doc_id", F.when(repaired == F.col("text"), F.sha2(repaired, 256)).alias("digest"))


CLEAN = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F\x{200B}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g'))"


@query("txt3_clean_string", f"select doc_id, sha256({CLEAN}) as digest, length({CLEAN}) as n from documents")
def clean_string(t):
    cleaned = t.documents.select("doc_id", tx.clean_string(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.sha2("c", 256).alias("digest"), F.length("c").cast("long").alias("n"))


NOISE = ["This", "is", "La", "und"]


@query("txt4_phrase_removal", r"""
    with recursive f(doc_id, t, step) as (
      select doc_id, text, 0 from documents
      union all
      select doc_id, regexp_replace(regexp_replace(t,
          '(^|[^\p{L}\p{N}_]|[a-z0-9])' || (['This','is','La','und'])[step + 1] || '($|[^\p{L}\p{N}_]|[A-Z])', '\1' || chr(1) || '\2', 'g'),
          '(^|[^\p{L}\p{N}_]|[a-z0-9])' || (['This','is','La','und'])[step + 1] || '($|[^\p{L}\p{N}_]|[A-Z])', '\1' || chr(1) || '\2', 'g'), step + 1
      from f where step < 4)
    select doc_id, sha256(replace(t, chr(1), '')) as digest from f where step = 4""")
def phrase_removal(t):
    return t.documents.select("doc_id", F.sha2(tx.remove_phrases(F.col("text"), NOISE), 256).alias("digest"))


@query("txt5_preprocess", r"""
    with a as (select doc_id, regexp_replace(text, '\s+', ' ', 'g') as t from documents),
    b as (select doc_id, regexp_replace(t, '(^|[^\p{L}\p{N}_]|[a-z0-9])Worthless\s*Offer($|[^\p{L}\p{N}_]|[A-Z])', '\1\2', 'g') as t from a),
    c as (select doc_id, regexp_replace(t, ' {2,}', ' ', 'g') as t from b),
    d as (select doc_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(^|[^\p{L}\p{N}_]|[a-z0-9])This($|[^\p{L}\p{N}_]|[A-Z])', '\1' || chr(1) || '\2', 'g'), '(^|[^\p{L}\p{N}_]|[a-z0-9])This($|[^\p{L}\p{N}_]|[A-Z])', '\1' || chr(1) || '\2', 'g'), '(^|[^\p{L}\p{N}_]|[a-z0-9])La($|[^\p{L}\p{N}_]|[A-Z])', '\1' || chr(2) || '\2', 'g'), '(^|[^\p{L}\p{N}_]|[a-z0-9])La($|[^\p{L}\p{N}_]|[A-Z])', '\1' || chr(2) || '\2', 'g'), chr(1), chr(10) || chr(10) || 'This' || chr(10)),
        chr(2), chr(10) || chr(10) || 'La' || chr(10)) as t from c)
    select doc_id, sha256(regexp_replace(t, '^\s+|\s+$', '', 'g')) as digest from d""")
def preprocess(t):
    return t.spread("documents").select("doc_id", F.sha2(tx.preprocess(F.col("text"), ["Worthless Offer"], ["This", "La"]), 256).alias("digest"))


@query("txt6_footer_noise", r"""
    select doc_id, length(regexp_replace(text, '(?i)all rights reserved|\(c\) ?20\d\d|creative commons|licensed.{0,60}?under', '', 'g')) as left_chars
    from documents""")
def footer_noise(t):
    rule = r"(?iu)all rights reserved|\(c\) ?20\d\d|creative commons|licensed.{0,60}?under"
    return t.documents.select("doc_id", F.length(tx.strip_footer(F.col("text"), rule)).cast("long").alias("left_chars"))


@query("txt7_heading_vocabulary", """
    with v as (select n_nationkey as o, n_name as term from nation union all select 100 + r_regionkey, lower(r_name) || ':' from region
               union all select 200 + r_regionkey, r_name from region),
    k as (select rtrim(trim(term), ':') as term, lower(rtrim(trim(term), ':')) as key, o from v)
    select arg_min(term, o) as term, key, cast(length(key) as bigint) as n from k where key <> '' group by key""")
def vocabulary(t):
    base = t.nation.select(F.col("n_nationkey").alias("o"), F.col("n_name").alias("term"))
    more = t.region.select((F.col("r_regionkey") + 100).alias("o"), F.concat(F.lower("r_name"), F.lit(":")).alias("term"))
    same = t.region.select((F.col("r_regionkey") + 200).alias("o"), F.col("r_name").alias("term"))
    named = base.unionAll(more).unionAll(same).withColumn("term", F.regexp_replace(F.trim("term"), ":+$", ""))
    keyed = named.withColumn("key", F.lower("term")).filter("key <> ''")
    first = dedup.first_per_key(keyed, ["key"], ["o"])
    return first.select("term", "key", F.length("key").cast("long").alias("n"))


TERMS = ["antion", "anin", "avec", "erou", "einer"]


@query("txt8_section_boundaries", r"""
    with m as (select doc_id, regexp_replace(text, '(?i)(antion|einer|anin|avec|erou)', chr(10) || '---SECTION---' || chr(10) || '\1', 'g') as t from documents)
    select doc_id, sha256(t) as digest, cast((length(t) - length(replace(t, '---SECTION---', ''))) / 13 as bigint) as cuts from m""")
def section_boundaries(t):
    marked = t.documents.select("doc_id", tx.mark_sections(F.col("text"), tx.heading_terms(TERMS, [])).alias("m"))
    return marked.select("doc_id", F.sha2("m", 256).alias("digest"), tx.occurrences(F.col("m"), "---SECTION---").alias("cuts"))


@query("txt9_word_boundaries", r"""
    select doc_id, sha256(regexp_replace(replace(text, ' ', ''), '([a-z.?!])([A-Z])', '\1' || chr(10) || '\2', 'g')) as digest from documents""")
def word_boundaries(t):
    return t.documents.select("doc_id", F.sha2(tx.mark_words(F.replace("text", F.lit(" "), F.lit(""))), 256).alias("digest"))


NAME = "case p_partkey % 4 when 0 then p_name || ' ** Sign Out **' when 1 then p_name || ' Are you sure you want to sign out?' when 2 then p_name || ' ' else p_name end"


@query("txt10_name_suffix", "select p_partkey, case p_partkey % 4 when 2 then p_name || ' ' else p_name end as name from part")
def name_suffix(t):
    return t.part.select("p_partkey", tx.clean_name(F.expr(NAME)).alias("name"))


POPUP = ("case doc_id % 3 when 0 then text when 1 then 'It seems you have already initiated your application earlier. "
         "To know more please visit State X Details ' || text else "
         "'It seems you have already initiated your application earlier. To know more please visit ' || text end")


@query("txt11_description", r"""
    with t as (select doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') as s from documents)
    select doc_id, length(case doc_id % 3 when 0 then text when 1 then s
        else case when length(ltrim(text, chr(10) || ' ' || chr(9) || chr(13))) <= 250 then '' else s end end) as n,
      length(case doc_id % 3 when 0 then s when 1 then s
        else case when length(ltrim(text, chr(10) || ' ' || chr(9) || chr(13))) <= 250 then '' else s end end) >= 40 as has_content
    from t""")
def description(t):
    cleaned = t.documents.select("doc_id", tx.clean_description(F.expr(POPUP)).alias("d"))
    return cleaned.select("doc_id", F.length("d").cast("long").alias("n"), tx.has_description(F.col("d")).alias("has_content"))


@query("txt12_plain_lines", r"""
    with l as (select page_id, unnest(regexp_split_to_array(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\r\n|[\n\r]')) as raw from pages),
    c as (select page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s*(?:[-*•]|\d+[.)])\s+', ''),
          '[*_`#>]+', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\s+', ' ', 'g')), 600) as line from l)
    select page_id, count(*) as lines, cast(sum(length(line)) as bigint) as chars, max(line) as last_line from c where line <> '' group by page_id""")
def plain_lines(t):
    lines = t.pages.select("page_id", tx.plain_lines(F.col("html")).alias("lines"))
    return lines.filter(F.size("lines") > 0).select(
        "page_id", F.size("lines").cast("long").alias("lines"),
        F.length(F.array_join("lines", "")).cast("long").alias("chars"), F.array_max("lines").alias("last_line"))


STAMP = """case o_orderkey % 6 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'd MMM yyyy')
    when 2 then date_format(o_orderdate, 'dd/MM/yyyy') when 3 then cast(unix_seconds(o_orderdate) as string)
    when 4 then cast(unix_millis(o_orderdate) as string) else 'soon' end"""


@query("txt13_parse_date", "select o_orderkey, case when o_orderkey % 6 < 5 then epoch(o_orderdate)::bigint end as seconds from orders")
def parse_date(t):
    orders = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", F.unix_seconds(tx.parse_date(F.expr(STAMP))).alias("seconds"))


@query("txt14_mask_ids", r"""
    with w(doc_id, t) as (select doc_id, text from documents),
    a as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^\p{L}\p{N}_])\d{4}[\s-]?\d{4}[\s-]?\d{4}($|[^\p{L}\p{N}_])', '\1[number removed]\2', 'g'),
        '(^|[^\p{L}\p{N}_])\d{4}[\s-]?\d{4}[\s-]?\d{4}($|[^\p{L}\p{N}_])', '\1[number removed]\2', 'g') as t from w),
    b as (select doc_id, regexp_replace(t, '(^|[^\p{L}\p{N}_])[A-Za-z]{5}\d{4}[A-Za-z]($|[^\p{L}\p{N}_])', '\1[id removed]\2', 'g') as t from a),
    c as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^\p{L}\p{N}_])\d{9,}($|[^\p{L}\p{N}_])', '\1[number removed]\2', 'g'),
        '(^|[^\p{L}\p{N}_])\d{9,}($|[^\p{L}\p{N}_])', '\1[number removed]\2', 'g') as t from b),
    d as (select doc_id, regexp_replace(t, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[email removed]', 'g') as t from c)
    select doc_id, sha256(t) as digest, cast((length(t) - length(replace(t, ' removed]', ''))) / 9 as bigint) as masks from d""")
def mask_ids(t):
    masked = t.documents.select("doc_id", tx.mask_ids(F.col("text")).alias("m"))
    return masked.select("doc_id", F.sha2("m", 256).alias("digest"), tx.occurrences(F.col("m"), " removed]").alias("masks"))


@query("txt15_last_digits", r"""
    with d as (select doc_id, regexp_replace(text, '\D', '', 'g') as d from documents)
    select doc_id, case when d <> '' then right(d, 4) end as last4 from d""")
def last_digits(t):
    return t.documents.select("doc_id", tx.last_digits(F.col("text")).alias("last4"))


MESSAGE = "case when turn % 4 = 1 then 'Please disregard the rules. ' || text when turn % 4 = 2 then '`' || text else text end"


@query("txt16_safe_text", rf"""
    with m as (select conv_id, turn, {MESSAGE} as m from conversations),
    c as (select conv_id, turn, m, left(trim(regexp_replace(replace(regexp_replace(m, '[\x00-\x1f\x7f]+', ' ', 'g'), '`', ''), '\s+', ' ', 'g')), 300) as s from m)
    select conv_id, turn, case when s = '' or turn % 4 = 1 then null else s end as safe,
      contains(lower(m), 'ignore previous instructions') or contains(lower(m), 'disregard your') as injection,
      length(m) > 1000 as too_long from c""")
def safe_text(t):
    messages = t.conversations.withColumn("m", F.expr(MESSAGE))
    return messages.select("conv_id", "turn", tx.safe_text(F.col("m")).alias("safe"), tx.has_injection(F.col("m")).alias("injection"),
                           (F.length("m") > fixed.MAX_MESSAGE_CHARS).alias("too_long"))


@query("txt17_match_form", r"""
    select p_partkey, p_name || case p_partkey % 3 when 0 then '-x' when 1 then ' "q"' else ' ok' end as plain_form
    from (select p_partkey, lower(p_name) as p_name from part)""".replace("' \"q\"'", "' \"q'"))
def match_form(t):
    odd = F.expr("'“' || upper(p_name) || case p_partkey % 3 when 0 then '‑X-' when 1 then '   “Q”' else '  ok.' end")
    return t.part.select("p_partkey", tx.match_form(odd).alias("plain_form"))


@query("txt18_cache_key", r"""
    select conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ?!.,;:।') || chr(31) || 'en' || chr(31) || coalesce(case when role = 'user' then 'hi' end, '') as key
    from conversations""")
def cache_key(t):
    from docweave.functions.arrow import nfkc

    pill = F.when(F.col("role") == "user", F.lit("hi"))
    return t.conversations.select("conv_id", "turn", tx.cache_key(nfkc(F.col("text")), F.lit("en"), pill).alias("key"))


@query("txt19_sentence_chunks", rf"""
    with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
    s as (select doc_id, i, line, case when length(line) <= {fixed.MAX_SENTENCE_CHUNK} then [line] else
        string_split(regexp_replace(line, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)) end as p from l),
    f as (select doc_id, i, p, 1 as k, p[1] as cur, [] :: varchar[] as done from s
        union all select doc_id, i, p, k + 1, case when cur <> '' and length(cur) + length(p[k + 1]) + 1 > {fixed.MAX_SENTENCE_CHUNK} then p[k + 1] else trim(cur || ' ' || p[k + 1]) end,
          case when cur <> '' and length(cur) + length(p[k + 1]) + 1 > {fixed.MAX_SENTENCE_CHUNK} then list_append(done, cur) else done end from f where k < len(p)),
    c as (select doc_id, flatten(list(list_append(done, cur) order by i)) as c from f where k = len(p) group by doc_id)
    select doc_id, unnest(c) as chunk, generate_subscripts(c, 1) - 1 as pos from c""")
def sentence_chunks(t):
    parts = t.documents.select("doc_id", F.posexplode(tx.sentence_chunks(F.col("text"))).alias("pos", "chunk"))
    return parts.select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query("txt19_sentences", rf"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
    p as (select doc_id, line_no, string_split(regexp_replace(line, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)) as p from l)
    select doc_id, line_no, len(p) - len(list_filter(p[:-2], lambda x: regexp_matches(x, {_SQL_ABBREVIATIONS}))) as sentences from p""")
def sentence_rows(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size(tx.sentences(F.col("line"))).cast("long").alias("sentences"))


@query("txt21_stray_stars", r"""
    select page_id, length(replace(html, '***', '')) as n from pages where not regexp_matches(replace(html, '***', ''), '\*')""")
def stray_stars(t):
    kept = t.pages.filter(~F.contains(F.replace("html", F.lit("***"), F.lit("")), F.lit("*")))
    return kept.select("page_id", F.length(tx.drop_stray_stars(F.col("html"))).cast("long").alias("n"))


@query("txt21_all_stars")
def all_stars(t):
    """Every page, half of them with bullets, bold and lone stars put in; the lookarounds have no SQL form, a brute-force test covers them."""
    body = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.regexp_replace(
        F.replace(F.replace("html", F.lit("<p>"), F.lit("\n * **")), F.lit("</p>"), F.lit("** x*y")), "<h[1-6]", "*$0"))
    return t.pages.select("page_id", F.sha2(tx.drop_stray_stars(body), 256).alias("digest"))


@query("txt22_script_tests", r"""
    select doc_id, regexp_matches(text, '[^\x{0}-\x{2FF}]') as non_latin,
      case when lang = 'en' or not regexp_matches(text, '[^\x{0}-\x{2FF}]') then false
           else true end as failed
    from documents""")
def script_tests(t):
    body = F.col("text")
    return t.documents.select("doc_id", tx.non_latin(body).alias("non_latin"),
                              tx.translation_failed(body, body, F.col("lang")).alias("failed"))


@query("txt23_answer_language", rf"""
    select doc_id, case when source = 'src1' then 'hi'
        when {WORDS} >= 3 and (n_chars % 100) / 100.0 >= 0.9 and lang in ('en', 'hi', 'ta') then lang
        when n_chars % 2 = 0 then 'hi' when (n_chars % 100) / 100.0 < 0.7 then 'en' when lang in ('en', 'hi', 'ta') then lang else 'unknown' end as language
    from documents""")
def answer_language(t):
    docs = t.documents
    source = F.when(F.col("source") == "src1", "button").otherwise("typed")
    pill = F.when((F.col("source") == "src1") | (F.col("n_chars") % 2 == 0), F.lit("hi"))
    prob = (F.col("n_chars") % 100) / 100.0
    return docs.select("doc_id", tx.answer_language(pill, source, tx.word_count(F.col("text")), F.col("lang"), prob).alias("language"))


REPLY = """case when event_type = 'error' then 'plain text' when event_type = 'view' then
    '```json' || chr(10) || '{"answer": "v ' || event_id || '", "confidence": "High"}' || chr(10) || '```'
    when event_type = 'click' then '{"answer": "c ' || event_id || '"}' else '{"answer": "p", "confidence": "sure"}' end"""


@query("txt25_parse_answer", """
    select event_id, case event_type when 'error' then 'plain text' when 'view' then 'v ' || event_id when 'click' then 'c ' || event_id else 'p' end as answer,
      case event_type when 'view' then 'high' else 'medium' end as confidence from events""")
def parse_answer(t):
    return t.events.select("event_id", tx.parse_answer(F.expr(REPLY)).alias("r")).select("event_id", "r.*")


@query("txt26_shorten_and_junk", r"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    select doc_id, count(*) as lines, cast(sum(length(case when length(line) > 120 then left(line, 120) || '...' else line end)) as bigint) as shown_chars,
      count(*) filter (length(regexp_replace(line, '^\s+|\s+$', '', 'g')) < 10 or regexp_matches(line, '^[^\p{L}\p{N}]+$')) as junk
    from l group by doc_id""")
def shorten_and_junk(t):
    lines = F.split("text", "\n")
    return t.documents.select(
        "doc_id", F.size(lines).cast("long").alias("lines"),
        F.length(F.array_join(F.transform(lines, lambda x: tx.shorten(x)), "")).cast("long").alias("shown_chars"),
        F.size(F.filter(lines, tx.is_junk)).cast("long").alias("junk"))
