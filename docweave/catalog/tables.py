"""Sources, chunk tables, synchronisation, resume joins, set operations and reports."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from docweave import fixed
from docweave.catalog.registry import query
from docweave.catalog.sections import OUT, SCORED, chunk_table, query_table, ranked_sql, shown
from docweave.functions import sections as sec, text as tx
from docweave.operators import chunks, evaluate, ordering, search, sync
from docweave.sources import files, listing

STATES_SQL = "[" + ", ".join(f"'{s}'" for s in fixed.STATES) + "]"


# --- sources --------------------------------------------------------------------------------
@query("src3_vocabulary", """
    select p_partkey, p_name as term from part where lower(p_name) not in (select lower(p_name) from part where p_type = 'PROMO' or p_size = 7)""")
def vocabulary(t):
    headings = t.part.filter("p_type = 'PROMO' or p_size = 7").select(F.upper("p_name").alias("term"))
    return files.drop_headings(t.part.select("p_partkey", F.col("p_name").alias("term")), headings)


PAGE_JSON = """'{"data":{"hits":{"items":[{"fields":{"schemeName":"' || p_name || '","slug":"s' || p_partkey || '","updatedAt":"2024-01-0' || (1 + p_size % 9) || '"}},'
    || '{"name":"' || p_brand || '","slug":"' || case when p_size % 2 = 0 then '' else 'b' || p_partkey end || '"},{"slug":"x"}]}}}'"""


@query("src4_json_listing", """
    select p_name as scheme_name, 's' || p_partkey as slug, 'https://site/schemes/s' || p_partkey as url, '2024-01-0' || (1 + p_size % 9) as day from part
    union all select p_brand, 'b' || p_partkey, 'https://site/schemes/b' || p_partkey, null from part where p_size % 2 <> 0""")
def json_listing(t):
    rows = listing.json_listing(t.part.select(F.expr(PAGE_JSON).alias("raw")), "raw", "https://site/schemes/")
    return rows.select("scheme_name", "slug", "url", F.date_format("last_updated", "yyyy-MM-dd").alias("day"))


@query("src5_html_links", r"""
    with a as (select page_id, unnest(regexp_extract_all(html, '<a href="/([^"/?#]+)">([^<]*)</a>', 1)) as slug,
        unnest(regexp_extract_all(html, '<a href="/([^"/?#]+)">([^<]*)</a>', 2)) as name,
        generate_subscripts(regexp_extract_all(html, '<a href="/([^"/?#]+)">([^<]*)</a>', 1), 1) as i from pages)
    select slug, first(trim(name) order by page_id, i) as scheme_name from a where trim(name) <> '' group by slug""")
def html_links(t):
    return listing.html_links(t.pages, "page_id", "html", "/")


@query("src6_source_fallback", """
    select o_orderkey, o_orderstatus, cast(1 as bigint) as source_place from orders where o_orderpriority = '1-URGENT'""")
def source_fallback(t):
    api = t.orders.filter("o_orderstatus = 'none'").select("o_orderkey", "o_orderstatus")
    site = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")
    return sync.first_source_with_rows([api, site])


DETAIL_JSON = """'{"data":{"en":{"basicDetails":{"schemeName":" ' || p_name || ' ","nodalDepartmentName":"' || p_brand || '","schemeCategory":[{"label":"' || p_type || '"},"x"],"updatedAt":"2024-02-03"},'
    || '"schemeContent":{"briefDescription":"**Made** of ' || p_name || '","benefits":"- one\\\\n- two"},"applicationProcess":[{"process_md":"1. go\\\\n2. pay"},"end"]}}}'"""


@query("src7_json_detail", """
    select p_partkey, p_name as scheme_name, p_brand as department, '' as state, p_type || ', x' as category, 'Made of ' || p_name as description,
      'one|two' as benefits, '' as eligibility, 'go|pay|end' as steps, '2024-02-03' as day from part""")
def json_detail(t):
    rows = t.spread("part").select("p_partkey", listing.json_detail(F.expr(DETAIL_JSON)).alias("d")).select("p_partkey", "d.*")
    return rows.select("p_partkey", "scheme_name", "department", "state", "category", "description", F.array_join("benefits", "|").alias("benefits"),
                       F.array_join("eligibility", "|").alias("eligibility"), F.array_join("steps", "|").alias("steps"),
                       F.date_format("last_updated", "yyyy-MM-dd").alias("day"))


@query("src6_source_reasons", """
    with l as (select 'api' as source, cast(0 as bigint) as place, cast(0 as bigint) as rows, 'api failed: timeout' as reason
      union all select 'search', 1, count(*), case when count(*) = 0 then 'search returned no orders' end from orders where o_orderpriority = 'none'
      union all select 'site', 2, count(*), case when count(*) = 0 then 'site has none' end from orders where o_orderstatus = 'P'
      union all select 'archive', 3, count(*), null from orders)
    select * from l where place <= (select min(place) from l where rows > 0)""")
def source_reasons(t):
    """Why a source was passed over: one failed, one is empty, the third is used, the fourth not asked."""
    return sync.source_reasons({
        "api": (t.orders, "api returned no orders", "timeout"), "search": (t.orders.filter("o_orderpriority = 'none'"), "search returned no orders", None),
        "site": (t.orders.filter("o_orderstatus = 'P'"), "site has none", None), "archive": (t.orders, "archive has none", None)})


@query("src6_first_source", "select o_orderkey, o_orderstatus, cast(0 as bigint) as source_place from orders where o_totalprice > 1000")
def first_source(t):
    """The first source has rows: the second is not used."""
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return sync.first_source_with_rows([t.orders.filter("o_totalprice > 1000").select("o_orderkey", "o_orderstatus"), rows])


RECORD_JSON = """concat('{"data":{"en":{"basicDetails":{"schemeName":"', case when p_size % 5 = 0 then '' else p_name end, '","nodalMinistryName":"', case when p_size % 2 = 0 then concat('Ministry ', p_brand) else '' end,
    '","nodalDepartmentName":"', p_brand, '","state":"State  of ', p_size, '","level":"Central","schemeCategory":[{"label":"', p_type, '"},"x",""],"tags":["', p_brand, ' box"," b  c ",""]',
    case when p_size % 3 = 0 then ',"updatedAt":"2024-02-03"' else '' end, '},"schemeContent":{"briefDescription":', case when p_size % 4 = 0 then '[]' else concat('["**Made** of ', p_name, '",{"a":"x","b":["<p>y</p>",""]}]') end,
    ',"detailedDescription_md":"1. long","benefits":["- one", {"z":"two"}]},"eligibilityCriteria":{"eligibilityDescription":"A\\\\nB"},"documentsRequired":[{"documentsRequired_md":"* id\\\\n* card"},"photo",{"k":"v"}],',
    '"applicationProcess":[{"process_md":["1. go","2. pay"]},"end"]}}}')"""
EMPTY_NAMES = "case when p_size % 5 = 0 then 'Listed ' || p_partkey else p_name end"


def _details(rows, *keys):
    listed = ("benefits", "eligibility", "documents", "steps", "tags")
    return rows.select(*keys, "d.*").select(*keys, "scheme_name", "department", "state", "category", "scheme_type", "description", *[F.array_join(c, "|").alias(c) for c in listed],
                                            F.date_format("last_updated", "yyyy-MM-dd").alias("day"))


@query("src7_detail_record", f"""
    select p_partkey, {EMPTY_NAMES} as scheme_name, case when p_size % 2 = 0 then 'Ministry ' || p_brand else p_brand end as department, 'State of ' || p_size as state, p_type || ', x' as category,
      'Central' as scheme_type, case when p_size % 4 = 0 then 'long' else 'Made of ' || p_name || ' x y' end as description, 'one|two' as benefits, 'A|B' as eligibility,
      'id|card|photo|v' as documents, 'go|pay|end' as steps, p_brand || ' box|b c' as tags, case when p_size % 3 = 0 then '2024-02-03' else '2023-01-02' end as day from part""")
def detail_record(t):
    """Every field of the detail record, with list-valued members and what the listing says for those without a name or date."""
    listed = F.concat(F.lit("Listed "), F.col("p_partkey"))
    rows = t.spread("part").select("p_partkey", listing.json_detail(F.expr(RECORD_JSON), listed, F.lit("2023-01-02").cast("timestamp")).alias("d"))
    return _details(rows, "p_partkey")


# The pages have no section headings of their own: the line breaks of the lead become one, the article end another.
PAGE = """replace(replace(replace(html, '<p><b>', '<h2>Details</h2><p><b>'), '<br>', '<h3>Benefits</h3>'),
    '<footer>', '<h2>Eligibility criteria</h2><p>' || url || '</p><h2>Other</h2><p>Last updated: 3 Feb 2024</p>')"""
BODY = rf"""b as (select page_id, regexp_replace({PAGE}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') as body from pages),
    e as (select page_id, body, unnest(regexp_split_to_array(body, '<h[23]>')[2:]) as part, generate_subscripts(regexp_split_to_array(body, '<h[23]>')[2:], 1) as i from b),
    l as (select page_id, i, regexp_extract(part, '^([^<]*)', 1) as title,
        unnest(string_split(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(part, '^[^<]*</h[23]>', ''), '<[^>]*>', chr(10), 'g'),
           '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10))) as raw,
        generate_subscripts(string_split(regexp_replace(regexp_replace(part, '^[^<]*</h[23]>', ''), '<[^>]*>', chr(10), 'g'), chr(10)), 1) as k from e),
    c as (select page_id, i, k, title, left(trim(regexp_replace(regexp_replace(regexp_replace(raw, '^\s*(?:[-*•]|\d+[.)])\s+', ''), '[*_`#>]+', '', 'g'), '\s+', ' ', 'g')), 600) as line from l)"""


@query("src8_html_detail", rf"""
    with {BODY}
    select pages.page_id, sha256(coalesce(string_agg(line, ' ' order by i, k) filter (title = 'Details'), '')) as description,
      count(line) filter (title = 'Benefits') as benefits, sha256(coalesce(string_agg(line, '|' order by i, k) filter (title = 'Benefits'), '')) as benefits_digest,
      coalesce(string_agg(line, '|' order by i, k) filter (title = 'Eligibility criteria'), '') as eligibility, '2024-02-03' as day
    from pages left join (select * from c where line <> '') c on pages.page_id = c.page_id group by pages.page_id""")
def html_detail(t):
    d = t.pages.select("page_id", listing.html_detail(F.expr(PAGE)).alias("d"))
    return d.select("page_id", F.sha2("d.s.description", 256).alias("description"), F.size("d.s.benefits").cast("long").alias("benefits"),
                    F.sha2(F.array_join("d.s.benefits", "|"), 256).alias("benefits_digest"),
                    F.array_join("d.s.eligibility", "|").alias("eligibility"), F.date_format("d.last_updated", "yyyy-MM-dd").alias("day"))


PAYLOAD = """'<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"schemeData":{"basicDetails":{"schemeName":"Page ' || page_id || '","level":"State","tags":["t"]},' ||
    '"documents_required":["form"],"schemeContent":{"benefits":["b1","b2"]}}}}}</script>'"""
SENT = f"case when page_id % 3 = 0 then replace({PAGE}, '<article>', {PAYLOAD} || '<article>') when page_id % 3 = 1 then replace({PAGE}, 'h1>', 'h4>') else {PAGE} end"


@query("src8_page_detail", rf"""
    with {BODY},
    h as (select pages.page_id, coalesce(string_agg(line, ' ' order by i, k) filter (title = 'Details'), '') as description, coalesce(string_agg(line, '|' order by i, k) filter (title = 'Benefits'), '') as benefits,
        coalesce(string_agg(line, '|' order by i, k) filter (title = 'Eligibility criteria'), '') as eligibility, any_value(html) as html
      from pages left join (select * from c where line <> '') c on pages.page_id = c.page_id group by pages.page_id)
    select page_id, case page_id % 3 when 0 then 'Page ' || page_id when 1 then 'Listed ' || page_id else replace(replace(replace(regexp_replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') end as scheme_name,
      case when page_id % 3 = 0 then 'State' else '' end as scheme_type, sha256(case when page_id % 3 = 0 then '' else description end) as description,
      sha256(case when page_id % 3 = 0 then 'b1|b2' else benefits end) as benefits, case when page_id % 3 = 0 then '' else eligibility end as eligibility,
      case when page_id % 3 = 0 then 'form' else '' end as documents, case when page_id % 3 = 0 then 't' else '' end as tags, case when page_id % 3 = 0 then '2023-01-02' else '2024-02-03' end as day from h""")
def whole_page_detail(t):
    """Pages with an embedded payload, without a title, and with both in HTML alone."""
    listed = F.concat(F.lit("Listed "), F.col("page_id"))
    rows = t.pages.select("page_id", listing.page_detail(F.expr(SENT), listed, F.lit("2023-01-02").cast("timestamp")).alias("d"))
    d = _details(rows, "page_id")
    return d.select("page_id", "scheme_name", "scheme_type", F.sha2("description", 256).alias("description"), F.sha2("benefits", 256).alias("benefits"), "eligibility", "documents", "tags", "day")


@query("src9_detail_fallback", """
    select coalesce(doc_id, page_id) as id, case when doc_id is not null and lang <> 'en' then lang else url end as name,
      case when doc_id is not null and lang <> 'en' then n_chars else length(html) end as size
    from documents full join pages on doc_id = page_id""")
def detail_fallback(t):
    api = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("name"), F.col("n_chars").alias("size"))
    page = t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("name"), F.length("html").cast("long").alias("size"))
    return sync.prefer_named(api, page, "id", "name")


@query("src10_running_total", "select cast(max(event_id) as bigint) as running_total from events")
def running_total(t):
    lines = t.events.select("event_id", F.concat_ws(",", "event_type", "value", "event_id").alias("line"))
    return files.running_total(lines, "line", "event_id")


@query("qua3_required_content", """
    select doc_id, case when lang = 'de' then 'scheme_name missing' when n_chars < 500 then 'no description, benefits or eligibility extracted' end as reject_reason from documents""")
def required_content(t):
    name = F.when(F.col("lang") != "de", F.concat(F.lit("Doc "), F.col("doc_id")))
    text = F.when(F.col("n_chars") >= 500, F.col("text"))
    none = F.array().cast("array<string>")
    return listing.required_content(t.documents, name, text, none, none).select("doc_id", "reject_reason")


# --- chunk tables ---------------------------------------------------------------------------
def schemes(t):
    """Documents as schemes: first line, next two, next two with a state, and all the rest."""
    lines = sec.items(F.col("text"))
    state = F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), (F.col("doc_id") % len(fixed.STATES) + 1).cast("int"))
    rows = t.documents.select("doc_id", "lang", "source", lines.alias("l"), state.alias("st"))
    return rows.select(
        F.col("doc_id").alias("scheme_id"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".json")).alias("source_file"),
        F.concat(F.lit("Scheme "), F.col("doc_id")).alias("scheme_name"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("description"),
        F.slice("l", 2, 2).alias("other_benefits"),
        F.concat(F.slice("l", 4, 2), F.when(F.col("lang") == "en", F.array(F.concat(F.lit("Resident of "), F.col("st")))).otherwise(F.array().cast("array<string>"))).alias("conditions"),
        F.slice("l", 6, F.greatest(F.size("l"), F.lit(1))).alias("steps"))


CHUNKS = rf"""l as (select doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents),
    s as (select doc_id as scheme_id, 'd' || doc_id || '.json' as source_file, 'Scheme ' || doc_id as scheme_name, coalesce(l[1], '') as description, array_to_string(l[2:3], ' ') as b,
       array_to_string(list_concat(l[4:5], case when lang = 'en' then ['Resident of ' || ({STATES_SQL})[doc_id % 34 + 1]] else [] end), ' ') as c, array_to_string(l[6:], ' ') as a from l),
    ch as (select source_file || '_' || section as chunk_id, text, scheme_id, source_file, section, state from (
       select *, 'description' as section, 'passage: ' || scheme_name || '. ' || description as text, '' as state from s where length(description) >= 40
       union all select *, 'benefits', 'passage: ' || scheme_name || ' benefits: ' || b, '' from s
       union all select *, 'eligibility', 'passage: ' || scheme_name || ' eligibility: ' || c, coalesce(list_filter({STATES_SQL}, lambda x: contains(lower(c), lower(x)))[1], '') from s
       union all select *, 'application', 'passage: ' || scheme_name || ' application: ' || a, '' from s))"""


@query("sec12_section_chunks", f"with {CHUNKS} select chunk_id, sha256(text) as digest, scheme_id, source_file, section, state from ch")
def section_chunks(t):
    return chunks.build_chunks(schemes(t)).select("chunk_id", F.sha2("text", 256).alias("digest"), "scheme_id", "source_file", "section", "state")


@query("vec4_embedded_chunks", f"with {CHUNKS} select chunk_id, 64 as width, 1.0::double as norm from ch")
def embedded_chunks(t):
    """The default hashing model through the embedder hook; texts already carry their task prefix."""
    from docweave.functions.arrow import embedder, hashing_model

    rows = chunks.build_chunks(schemes(t)).select("chunk_id", embedder(hashing_model, "")("text").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("chunk_id", F.size("v").alias("width"), F.round(length, 4).alias("norm"))


def hashed_sql(text: str) -> str:
    """Counts of the 128 word buckets of a text, as a list."""
    words = rf"list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda w: cast('0x' || left(md5(w), 8) as bigint) % 128)"
    return f"list_transform([{words}], lambda b: list_transform(range(0, 128), lambda i: cast(len(list_filter(b, lambda x: x = i)) as double)))[1]"


UNIT = "list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y))))"


@query("vec4_feature_vectors", f"""
    with {CHUNKS}, h as (select chunk_id, {hashed_sql("'passage: ' || text")} as c from ch), u as (select chunk_id, {UNIT} as v from h)
    select chunk_id, sha256(array_to_string(list_transform(v, lambda x: cast(round(x * 1000000) as bigint)), ',')) as digest from u""")
def feature_vectors(t):
    """The whole vector of every chunk by the default features."""
    from docweave.functions.features import hashed_features

    rows = hashed_features(chunks.build_chunks(schemes(t)), "text")
    return rows.select("chunk_id", F.sha2(F.array_join(F.transform("vector", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ","), 256).alias("digest"))


SEEDS_SQL = ", ".join(f"('{c}', '{p}')" for c, listed in fixed.SEED_PHRASES.items() for p in listed)
HEADING = """case doc_id % 6 when 0 then 'Benefits of the programme' when 1 then 'Who can apply' when 2 then 'Documents to attach' when 3 then 'FAQ list' when 4 then 'How to apply online' else '' end
    || ' ' || case when doc_id % 2 = 0 then left(text, 20) else lang end"""


@query("sec4_seed_categories", f"""
    with s(category, phrase) as (values {SEEDS_SQL}), sh as (select category, {hashed_sql("'query: ' || phrase")} as c from s),
    sv as (select category, {UNIT} as v from sh), e as (select category, unnest(v) as x, generate_subscripts(v, 1) as i from sv),
    m as (select category, list(x order by i) as centroid from (select category, i, avg(x) as x from e group by 1, 2) group by 1),
    h as (select doc_id, {hashed_sql(f"'query: ' || coalesce({HEADING}, '')")} as c from documents), u as (select doc_id, {UNIT} as v from h),
    d as (select doc_id, category, list_dot_product(v, centroid) as score from u, m),
    b as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, category) as place from d)
    select doc_id, category, round(score, 6) as score, score >= {fixed.CONFIDENCE_THRESHOLD} as confident from b where place = 1""")
def seed_categories(t):
    """Headings by the nearest mean of the seed phrases, both embedded as queries."""
    from docweave.functions.features import QUERY, hashed_features, seed_centroids
    from docweave.operators.search import classify_vectors

    headings = hashed_features(t.documents.select("doc_id", F.expr(HEADING).alias("heading")), "heading", prefix=QUERY)
    named = classify_vectors(headings, "vector", seed_centroids(t.spark), "category", "centroid")
    return named.select("doc_id", "category", F.round("score", 6).alias("score"), "confident")


@query("sec13_first_state", f"""
    select l_orderkey, l_linenumber, ({STATES_SQL})[l_partkey % 34 + 1] as state from lineitem""")
def first_state(t):
    state = F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), (F.col("l_partkey") % 34 + 1).cast("int"))
    text = F.concat(F.lit("people of "), F.upper(state), F.lit(" may apply"))
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.first_contained(text, fixed.STATES).alias("state"))


def labelled(t):
    return t.labels.filter("quality = 1").select("doc_id")


@query("snk3_document_load", """
    with i as (select doc_id, doc_id // 2 as file, length(trim(text)) >= 200 as ok from documents),
    e as (select distinct doc_id // 2 as file from labels where quality = 1),
    o as (select *, case when not ok then 'failed' when file in (from e) or doc_id <> min(doc_id) filter (ok) over (partition by file) then 'skipped' else 'inserted' end as outcome from i)
    select outcome, count(*) as rows from o group by outcome""")
def document_load(t):
    incoming = t.documents.select("doc_id", F.floor(F.col("doc_id") / 2).alias("file"), "text")
    existing = labelled(t).select(F.floor(F.col("doc_id") / 2).alias("file"))
    loaded = chunks.load_new(existing, incoming, "file", "doc_id", F.length(F.trim("text")) >= 200)
    return loaded.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


SUFFIX = "case scheme_id % 4 when 0 then ' ** Sign Out **' when 1 then ' Are you sure you want to sign out?' else '' end"
POPPED = """case scheme_id % 3 when 1 then 'It seems you have already initiated your application earlier. To know more please visit State X Details '
    when 2 then 'It seems you have already initiated your application earlier. To know more please visit ' else '' end"""


def incoming_documents(t):
    """Documents as nested records with scraped names and descriptions; two rows compete for a file."""
    name, description = F.concat("scheme_name", F.expr(SUFFIX)), F.concat(F.expr(POPPED), "description")
    sizes = t.documents.select(F.col("doc_id").alias("scheme_id"), (F.length(F.trim("text")) >= 200).alias("valid"))
    return schemes(t).join(sizes, "scheme_id").select(
        F.concat(F.lit("f"), F.floor(F.col("scheme_id") / 2), F.lit(".json")).alias("source_file"), "scheme_id", "valid", F.struct(name.alias("scheme_name")).alias("metadata"),
        F.struct(description.alias("description")).alias("overview"), "other_benefits", "conditions", "steps")


def loaded(t):
    """Documents with a good label are loaded and embedded; then all are loaded, twice."""
    from docweave.functions.features import hashed_features
    from docweave.operators import loads
    from docweave.streaming.files import work_folder

    def build(records):
        return chunks.build_chunks(records.select("*", "metadata.scheme_name", "overview.description"))

    def embed(new):
        return hashed_features(new, "text", "vector").select("chunk_id", "source_file", "section", "text", "vector")

    incoming, folder = incoming_documents(t), work_folder(t.spark, "load")
    documents = loads.document_table(t.spark, f"{folder}/documents", incoming.drop("valid").schema)
    held = loads.chunk_table(t.spark, f"{folder}/chunks", embed(build(incoming)).schema)
    first = incoming.join(labelled(t).withColumnRenamed("doc_id", "scheme_id"), "scheme_id", "left_semi")
    reports = {}
    for turn, rows in (("labelled", first), ("all", incoming), ("again", incoming)):
        reports[turn] = loads.load_documents(documents, rows, "scheme_id", F.col("valid"))
        if turn == "labelled":
            reports["embedded"] = loads.embed_documents(documents, held, build, embed)
    return documents, held, reports


LOADED = f"""{CHUNKS}, i as (select *, 'f' || scheme_id // 2 || '.json' as file, length(trim(text)) >= 200 as ok, scheme_id in (select doc_id from labels where quality = 1) as early
      from s join (select doc_id, text from documents) d on d.doc_id = s.scheme_id),
    a as (select file, min(scheme_id) as scheme_id from i where ok and early group by 1),
    b as (select file, min(scheme_id) as scheme_id from i where ok and file not in (select file from a) group by 1),
    r as (select *, 'done' as embedding_status from a union all select *, 'pending' from b)"""


@query("snk3_loaded_documents", f"""
    with {LOADED} select r.file as source_file, r.scheme_id, embedding_status, scheme_name, case when r.scheme_id % 4 = 1 then 'are you sure you want to sign out' end as suspect,
      sha256(case when r.scheme_id % 3 = 2 and length(description) <= 250 then '' else description end) as digest from r join i on i.scheme_id = r.scheme_id""")
def loaded_documents(t):
    documents, _, _ = loaded(t)
    return documents.read().select("source_file", "scheme_id", "embedding_status", "metadata.scheme_name", "suspect", F.sha2("overview.description", 256).alias("digest"))


@query("snk3_load_counts", f"""
    with {LOADED} select 'labelled' as run, (select count(*) from a) as inserted, count(*) filter (early and ok) - (select count(*) from a) as skipped, count(*) filter (early and not ok) as failed,
      count(*) filter (early) as total from i
    union all select 'all', (select count(*) from b), count(*) filter (ok) - (select count(*) from b), count(*) filter (not ok), count(*) from i
    union all select 'again', 0, count(*) filter (ok), count(*) filter (not ok), count(*) from i""")
def load_counts(t):
    _, _, reports = loaded(t)
    rows = [reports[n].select(F.lit(n).alias("run"), "*") for n in ("labelled", "all", "again")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("snk4_embedded_chunks", f"""
    with {LOADED}, e as (select i.*, case when i.scheme_id % 3 = 2 and length(description) <= 250 then '' else description end as shown from a join i on i.scheme_id = a.scheme_id)
    select file || '_' || section as chunk_id, file as source_file, section, 128 as width from (select *, unnest(['description', 'benefits', 'eligibility', 'application']) as section from e)
    where section <> 'description' or length(shown) >= 40""")
def embedded_chunk_rows(t):
    _, held, _ = loaded(t)
    return held.read().select("chunk_id", "source_file", "section", F.size("vector").alias("width"))


@query("snk4_chunk_append", f"with {CHUNKS} select section, count(*) as embedded from ch where scheme_id not in (select doc_id from labels where quality = 1) group by section")
def chunk_append(t):
    built = chunks.build_chunks(schemes(t))
    stored = built.join(labelled(t).withColumnRenamed("doc_id", "scheme_id"), "scheme_id", "left_semi")
    return chunks.append_new(stored, built).groupBy("section").agg(F.count(F.lit(1)).alias("embedded"))


@query("snk5_replace_chunks", f"""
    with {CHUNKS} select chunk_id, case when scheme_id in (select doc_id from labels where toxic = 1) then 'rebuilt' else 'stored' end as origin from ch
    where section <> 'description' or scheme_id not in (select doc_id from labels where toxic = 1)""")
def replace_chunks(t):
    stored = chunks.build_chunks(schemes(t)).withColumn("origin", F.lit("stored"))
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("scheme_id"))
    changed = schemes(t).join(toxic, "scheme_id", "left_semi").withColumn("description", F.lit("short"))
    rebuilt = chunks.build_chunks(changed).withColumn("origin", F.lit("rebuilt"))
    return chunks.replace_by_key(stored, changed, rebuilt, "source_file").select("chunk_id", "origin")


@query("snk6_feedback_upsert", """
    select user_id, hour(ts) as hour, epoch_us(min(ts)) as created_at, epoch_us(max(ts)) as updated_at, arg_max(event_type, ts) as rating from events group by 1, 2""")
def feedback_upsert(t):
    rows = t.events.select("user_id", F.hour("ts").cast("long").alias("hour"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("rating"))
    early, late = rows.filter("rating = 'view'"), rows.filter("rating <> 'view'")
    stored = chunks.upsert_latest(None, early, ["user_id", "hour"], "rating", "at")
    return chunks.upsert_latest(stored, late, ["user_id", "hour"], "rating", "at")


@query("qua6_reconciliation", f"with {CHUNKS} select count(*) as chunks, count(distinct scheme_id) as documents, count(*) = 4 * count(distinct scheme_id) as complete from ch")
def reconciliation(t):
    built = chunks.build_chunks(schemes(t)).agg(F.count(F.lit(1)).alias("chunks"))
    n = t.documents.agg(F.count(F.lit(1)).alias("documents")).scalar()
    return built.withColumn("documents", n).withColumn("complete", F.col("chunks") == F.col("documents") * 4)


@query("joi14_chunk_maintenance", r"""
    with t as (select doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') as s from documents),
    n as (select doc_id, doc_id % 3 <> 0 as changed, case doc_id % 3 when 0 then text when 1 then s
        else case when length(ltrim(text, chr(10) || ' ' || chr(9) || chr(13))) <= 250 then '' else s end end as d from t)
    select 'd' || n.doc_id || '.json' as source_file, changed,
      case when length(regexp_replace(d, '^\s+|\s+$', '', 'g')) < 40 and l.doc_id is not null then 'delete'
           when length(regexp_replace(d, '^\s+|\s+$', '', 'g')) >= 40 and (changed or l.doc_id is null) then 'embed' else 'keep' end as outcome
    from n left join (select doc_id from labels where quality = 1) l using (doc_id)""")
def chunk_maintenance(t):
    from docweave.catalog.corpus import POPUP

    file = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".json")).alias("source_file")
    described = t.documents.select(file, F.expr(POPUP).alias("description"))
    stored = labelled(t).select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".json_description")).alias("chunk_id"))
    return chunks.maintenance_plan(described, stored).select("source_file", "changed", "outcome")


# --- resume, fetch, scope -------------------------------------------------------------------
@query("joi1_resume", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def resume(t):
    return sync.pending(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("joi2_resume_valid", "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def resume_valid(t):
    return sync.pending(t.documents.select("doc_id"), labelled(t), "doc_id")


@query("top1_next_batch", "select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem) order by o_totalprice desc, o_orderkey limit 100")
def next_batch(t):
    left = sync.pending(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return left.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("top2_error_report", """
    with e as (select event_id, user_id, row_number() over (partition by user_id order by value desc, event_id) as place, count(*) over (partition by user_id) as n from events where event_type = 'error')
    select user_id, event_id, place, greatest(n - 5, 0) as more from e where place <= 5""")
def error_report(t):
    errors = t.events.filter("event_type = 'error'")
    ranked = errors.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")).filter("place <= 5")
    counts = errors.groupBy("user_id").agg(F.greatest(F.count(F.lit(1)) - 5, F.lit(0)).alias("more"))
    return ranked.join(counts, "user_id").select("user_id", "event_id", "place", "more")


@query("joi4_ordered_fetch", """
    with r as (select s_suppkey as request_id, unnest([s_suppkey * 3, -1, s_suppkey]) as p_partkey, generate_subscripts([1, 2, 3], 1) - 1 as pos from supplier)
    select request_id, cast(pos as bigint) as pos, p_partkey, p_name, cast(1 as double) as score from r join part using (p_partkey)""")
def ordered_fetch(t):
    asked = t.supplier.select(F.col("s_suppkey").alias("request_id"), F.array(F.col("s_suppkey") * 3, F.lit(-1).cast("long"), F.col("s_suppkey")).alias("ids"))
    return sync.fetch_in_order(asked, t.part.select("p_partkey", "p_name"), "p_partkey").withColumn("pos", F.col("pos").cast("long"))


BRIDGE = "br as (select distinct l_partkey as scheme_id, n_name as state from lineitem join supplier on l_suppkey = s_suppkey join nation on n_nationkey = s_nationkey)"


def bridge(t):
    lines = t.lineitem.select(F.col("l_partkey").alias("scheme_id"), "l_suppkey")
    named = lines.join(t.supplier, lines.l_suppkey == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("scheme_id", F.col("n_name").alias("state")).distinct()


def scheme_ids(t):
    return t.part.select(F.col("p_partkey").alias("scheme_id"))


@query("joi6_state_scope", f"""
    with {BRIDGE} select scheme_id, 'state' as kind from br where state = 'NATION_3'
    union all select p_partkey, 'central' from part where p_partkey not in (select scheme_id from br)""")
def state_scope(t):
    return sync.state_scope(bridge(t), scheme_ids(t), "nation_3")


@query("agg6_counts_by_state", f"""
    with {BRIDGE}, s as (select p_partkey, count(state) as n, min(state) as state from part left join br on scheme_id = p_partkey group by 1)
    select case when n = 0 then '<none: central/unspecified>' when n > 1 then '<several>' else state end as state, count(*) as schemes from s group by 1""")
def counts_by_state(t):
    return sync.counts_by_state(bridge(t), scheme_ids(t))


@query("eli12_candidates_in_scope", f"""
    with {SCORED}, {BRIDGE}, ids as (select scheme_id from br where state = 'NATION_3' union all select p_partkey from part where p_partkey not in (select scheme_id from br)),
    {ranked_sql('scheme_id in (from ids)', 30)} {OUT}""")
def candidates_in_scope(t):
    """Top candidates of every label inside the schemes of one state plus the central ones."""
    ids = sync.state_scope(bridge(t), scheme_ids(t), "NATION_3").select("scheme_id")
    return shown(search.retrieve(chunk_table(t), query_table(t), within=ids))


# --- synchronisation ------------------------------------------------------------------------
COMPARED = """c as (select o_orderkey, case when o_orderstatus = 'P' then 'new'
     when o_orderpriority <> '5-LOW' and (o_orderstatus = 'O' or o_totalprice % 10 >= 5) then 'updated' else 'unchanged' end as status from orders)"""


def compared(t):
    orders = t.orders.withColumn("at", F.col("o_orderdate").cast("timestamp"))
    listed = orders.select("o_orderkey", F.concat(F.lit("ORDER "), F.col("o_orderkey")).alias("scheme_name"),
                           F.when(F.col("o_orderpriority") != "5-LOW", F.col("at")).alias("last_updated"))
    newer = F.when(F.col("o_totalprice") % 10 >= 5, F.col("at") - F.expr("interval 1 day")).otherwise(F.col("at") + F.expr("interval 1 day"))
    stored = orders.filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("scheme_name"),
        F.when(F.col("o_orderstatus") == "F", F.col("at") - F.expr("interval 9 day")).alias("ingested_at"),
        F.when(F.col("o_orderstatus") == "F", newer).alias("last_synced"))
    return sync.compare_listing(listed, stored)


@query("joi10_sync_compare", f"with {COMPARED} select * from c")
def sync_compare(t):
    return compared(t).select("o_orderkey", "status")


@query("agg8_sync_report", f"""
    with {COMPARED} select count(*) as schemes_checked, count(*) filter (status = 'new') as new_schemes_added, count(*) filter (status = 'updated') as schemes_updated,
      count(*) filter (status = 'unchanged') as schemes_unchanged, (select count(*) from orders where o_totalprice < 2000) as schemes_failed,
      case when (select count(*) from orders where o_totalprice < 2000) > 0 then 'partial' else 'success' end as status from c""")
def sync_report(t):
    return sync.sync_report(compared(t), t.orders.filter("o_totalprice < 2000"))


@query("joi11_field_merge", """
    with o as (select c_custkey as k, 'f' || c_custkey as file, c_name as title, c_mktsegment as segment from customer where c_mktsegment <> 'BUILDING'),
    n as (select c_custkey as k, case when c_mktsegment = 'BUILDING' then 'f' || (c_custkey + 1) else 'g' || c_custkey end as file,
          case when c_acctbal < 3000 then '' else 'New ' || c_name end as title, lower(c_mktsegment) as segment from customer where c_acctbal > 0)
    select coalesce(o.k, n.k) as k, coalesce(o.file, n.file) as file,
      case when o.k is null then n.title else coalesce(nullif(n.title, ''), o.title) end as title,
      case when o.k is null then n.segment else coalesce(nullif(n.segment, ''), o.segment) end as segment,
      case when o.k is null and n.file in (select file from o) then 'error' when o.k is null then 'inserted' when n.k is not null then 'updated' else 'kept' end as action
    from o full join n on o.k = n.k""")
def field_merge(t):
    c = t.customer
    old = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.concat(F.lit("f"), F.col("c_custkey")).alias("file"),
                                                         F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    new = c.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("f"), F.col("c_custkey") + 1)).otherwise(F.concat(F.lit("g"), F.col("c_custkey"))).alias("file"),
        F.when(F.col("c_acctbal") < 3000, "").otherwise(F.concat(F.lit("New "), F.col("c_name"))).alias("title"), F.lower("c_mktsegment").alias("segment"))
    return sync.merge_fields(old, new, "k", "file", ["title", "segment"])


@query("joi12_data_as_of", """
    select l_orderkey as o_orderkey, l_linenumber, 'Data as of ' || strftime(o_orderdate, '%d %b %Y') as data_as_of
    from lineitem left join orders on l_orderkey = o_orderkey and o_orderstatus = 'F'""")
def data_as_of(t):
    stored = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("last_synced"))
    cited = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return sync.data_as_of(cited, stored, "o_orderkey").select("o_orderkey", "l_linenumber", "data_as_of")


@query("joi13_rename_plan", """
    with r as (select 'p' || p_partkey || '.json' as source_file, case when p_size % 3 = 0 then 'P' || p_partkey else p_name end as scheme_name,
        case when p_size % 9 = 0 then null when p_size % 9 = 3 then 'New ' || p_partkey else upper(p_name) end as recovered, p_partkey, p_size from part),
    c as (select * from r where p_size % 3 = 0)
    select source_file, scheme_name, recovered, case when recovered is null then 'unrecoverable'
      when exists (select 1 from r x where lower(x.scheme_name) = lower(c.recovered) and x.source_file <> c.source_file)
        or exists (select 1 from c x where lower(x.recovered) = lower(c.recovered) and x.source_file <> c.source_file) then 'duplicate' else 'rename' end as outcome from c""")
def rename_plan(t):
    rows = t.part.select(
        F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".json")).alias("source_file"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("P"), F.col("p_partkey"))).otherwise(F.col("p_name")).alias("scheme_name"),
        F.expr("case when p_size % 9 = 0 then null when p_size % 9 = 3 then 'New ' || p_partkey else upper(p_name) end").alias("recovered"))
    return sync.rename_plan(rows)


def reports(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("sync_timestamp"), "event_type", "event_id", F.floor("value").alias("v"))
    return rows.select("sync_timestamp", F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
                       F.col("v").alias("new_schemes_added"), (F.col("event_id") % 7).alias("schemes_updated"))


@query("agg7_sync_status", """
    select epoch_us(max(ts) filter (event_type <> 'error')) as last_sync, cast(arg_max(floor(value) + event_id % 7, ts) filter (event_type <> 'error') as bigint) as schemes_updated_last_sync,
      arg_max(event_type, ts) = 'error' as last_sync_failed from events""")
def sync_status(t):
    return sync.sync_status(reports(t)).withColumn("last_sync", F.unix_micros("last_sync"))


# --- evaluation and reports -----------------------------------------------------------------
ANSWER = "case when event_type = 'error' then 'Please see MyScheme.gov.in' when event_type = 'view' then 'I can only help with government schemes' else 'Answer ' || event_id end"


@query("agg2_answer_metrics", f"""
    with r as (select case when user_id % 3 = 0 then 'out_of_scope' else 'scheme_search' end as category, {ANSWER} as answer,
      case when event_type = 'signup' then 'error' else 'ok' end as intent, event_id % 4 as n_sources, value as t from events),
    m as (select count(*) as n, count(*) filter (category = 'out_of_scope') as o, count(*) filter (category = 'out_of_scope' and answer not like 'Answer%') as d,
      count(*) filter (intent <> 'error') as f, count(*) filter (intent <> 'error' and n_sources > 0) as c, avg(t) as a from r)
    select n as total_queries, o as out_of_scope_total, d as out_of_scope_declined, round(d * 100.0 / o, 1) as decline_rate_pct,
      round(c * 100.0 / f, 1) as source_citation_rate_pct, round(a, 3) as avg_response_time_s from m""")
def answer_metrics(t):
    rows = t.events.select(
        F.when(F.col("user_id") % 3 == 0, "out_of_scope").otherwise("scheme_search").alias("category"), F.expr(ANSWER).alias("answer"),
        F.when(F.col("event_type") == "signup", "error").otherwise("ok").alias("intent"), (F.col("event_id") % 4).alias("n_sources"),
        F.col("value").alias("response_time_s"))
    return evaluate.answer_metrics(rows)


@query("agg4_verdict_accuracy", """
    select count(*) as cases, count(*) filter ((quality = 1) = (n_chars >= 600)) as matches,
      round(count(*) filter ((quality = 1) = (n_chars >= 600)) * 100.0 / count(*), 1) as accuracy_pct,
      round(count(*) filter (toxic > 0) * 100.0 / count(*), 1) as unverifiable_pct from labels join documents using (doc_id)""")
def verdict_accuracy(t):
    cases = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return evaluate.verdict_accuracy(cases.select((F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 600).alias("actual"),
                                                  F.col("toxic").alias("n_unverifiable")))


@query("agg5_batch_summary", """
    select (select count(*) from orders) as sources, count(*) as attempted, count(*) filter (l_returnflag = 'N') as ok, count(*) filter (l_returnflag = 'A') as invalid,
      count(*) filter (l_returnflag = 'R') as failed, cast(sum(l_linenumber) as bigint) as pages,
      (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'N')) as remaining from lineitem""")
def batch_summary(t):
    done = t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = sync.pending(t.orders.select("o_orderkey"), done, "o_orderkey").agg(F.count(F.lit(1))).scalar()
    flag = F.col("l_returnflag")
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(flag == "N").alias("ok"), F.count_if(flag == "A").alias("invalid"),
        F.count_if(flag == "R").alias("failed"), F.sum("l_linenumber").alias("pages"),
    ).withColumn("remaining", left).withColumn("sources", t.orders.agg(F.count(F.lit(1))).scalar())


@query("agg9_usage_counters", """
    select event_type as model, case when value < 10 then 'failed' else 'ok' end as outcome, count(*) as calls, round(sum(value), 2) as seconds from events group by 1, 2""")
def usage_counters(t):
    return t.events.groupBy(F.col("event_type").alias("model"), F.when(F.col("value") < 10, "failed").otherwise("ok").alias("outcome")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("seconds"))


@query("flt1_subset_by_ids", """
    select o_orderkey as id, 'known' as kind from orders where o_orderkey in (select l_partkey * 11 from lineitem)
    union all select distinct l_partkey * 11, 'unknown' from lineitem where l_partkey * 11 not in (select o_orderkey from orders)""")
def subset_by_ids(t):
    wanted = t.lineitem.select((F.col("l_partkey") * 11).alias("id"))
    stored = t.orders.select(F.col("o_orderkey").alias("id"))
    known = stored.join(wanted, "id", "left_semi").withColumn("kind", F.lit("known"))
    return known.unionByName(wanted.distinct().join(stored, "id", "left_anti").withColumn("kind", F.lit("unknown")))


@query("set1_union_with_priority", """
    select k, min(p) as source_place from (select o_orderkey as k, cast(0 as bigint) as p from orders union all select l_orderkey, 1 from lineitem union all select l_partkey, 2 from lineitem) group by k""")
def union_with_priority(t):
    tables = [t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), t.lineitem.select(F.col("l_partkey").alias("k"))]
    first, second, third = [rows.withColumn("source_place", F.lit(place).cast("long")) for place, rows in enumerate(tables)]
    return first.unionByName(second).unionByName(third).groupBy("k").agg(F.min("source_place").alias("source_place"))


@query("set2_difference", "select doc_id from documents except select doc_id from labels")
def difference(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("win1_running_total", "select doc_id, n_chars, cast(sum(n_chars) over (order by doc_id) as bigint) as running_total from documents")
def running_pages(t):
    return ordering.global_scan(t.documents.select("doc_id", "n_chars"), ["doc_id"], {"running_total": F.col("n_chars")})


@query("win5_eta", """
    with c as (select event_id, cast(sum(cast(round(value * 100) as bigint)) over (order by event_id) as double) as spent, row_number() over (order by event_id) as done, count(*) over () as n from events)
    select event_id, round(spent / done, 4) as avg_cents, round(spent / done * (n - done), 2) as eta_cents from c""")
def eta(t):
    cents = F.round(F.col("value") * 100).cast("long")
    rows = ordering.global_scan(t.events.select("event_id", "value"), ["event_id"], {"spent": cents, "done": F.lit(1)})
    total = t.events.agg(F.count(F.lit(1))).scalar()
    mean = F.col("spent").cast("double") / F.col("done")
    return rows.select("event_id", F.round(mean, 4).alias("avg_cents"), F.round(mean * (total - F.col("done")), 2).alias("eta_cents"))
