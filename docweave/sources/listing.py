"""Saved listing and detail pages as rows: JSON pages, HTML links, HTML sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave import fixed
from docweave.functions import text as tx
from docweave.functions.text import let

UPDATED_KEYS = ["lastUpdated", "last_updated", "updatedAt", "updated_at", "modifiedAt", "lastModified"]  # fixed values


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _first_text(value: Column, keys: list[str], root: str = "$") -> Column:
    return F.coalesce(*[F.nullif(_text(value, f"{root}.{k}"), F.lit("")) for k in keys])


def json_listing(pages: DataFrame, raw: str, site: str) -> DataFrame:
    """Listed items of JSON pages; items without name or slug are left out."""
    items = F.try_variant_get(F.try_parse_json(raw), "$.data.hits.items", "array<variant>")
    rows = pages.select(F.explode(items).alias("item")).withColumn(
        "f", F.coalesce(F.try_variant_get("item", "$.fields", "variant"), F.col("item")))
    f, item = F.col("f"), F.col("item")
    named = rows.select(
        tx.squeeze(_first_text(f, ["schemeName", "name"])).alias("scheme_name"), _first_text(f, ["slug"]).alias("slug"),
        tx.parse_date(F.coalesce(_first_text(f, UPDATED_KEYS), _first_text(item, UPDATED_KEYS))).alias("last_updated"))
    return named.filter("scheme_name <> '' and slug is not null").withColumn("url", F.concat(F.lit(site), F.col("slug")))


def html_links(pages: DataFrame, id_col: str, html: str, path: str) -> DataFrame:
    """Distinct link targets under ``path``; the first non-empty anchor text names the target.

    Anchors are found inside the page row; the first-wins choice is an aggregate, so a link present on
    every page costs one row per task.
    """
    anchor = r'(?is)<a\s[^>]*href="[^"]*' + path + r'[^"/?#]+[^"]*"[^>]*>.*?</a>'
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(anchor), F.lit(0))).alias("pos", "a"))
    named = found.select(
        id_col, "pos", F.regexp_extract("a", path + r'([^"/?#]+)', 1).alias("slug"),
        tx.squeeze(F.regexp_replace("a", r"<[^>]*>", " ")).alias("name")).filter("name <> ''")
    return named.groupBy("slug").agg(F.min_by("name", F.struct(id_col, "pos")).alias("scheme_name"))


def unescape(col: Column) -> Column:
    for entity, mark in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        col = F.replace(col, F.lit(entity), F.lit(mark))
    return col


def _lines(fragment: Column) -> Column:
    """Plain lines of an HTML fragment: tags end a line, then entities are decoded."""
    return tx.plain_lines(unescape(F.regexp_replace(fragment, r"<[^>]*>", "\n")))


def html_detail(html: Column) -> Column:
    """{scheme_name, description, benefits, eligibility, documents, steps, last_updated} of a page.

    A section runs from a matching h2/h3 to the next h2/h3. Page order inside one row, no explode.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    # Headings matter inside the article only; the mark keeps heading text and section text apart.
    cut = F.regexp_replace(body, r"(?is)<h[23][^>]*>(.*?)</h[23]>", "\u0001$1\u0002")

    def build(parts: Column) -> Column:
        def section(part: Column) -> Column:
            title = tx.squeeze(F.regexp_replace(F.substring_index(part, "\u0002", 1), r"<[^>]*>", " "))
            label = F.lit(None).cast("string")
            for name, pattern in reversed(fixed.PAGE_SECTIONS):
                label = F.when(F.rlike(title, F.lit(tx.nocase(pattern))), F.lit(name)).otherwise(label)
            return F.struct(label.alias("label"), _lines(F.regexp_extract(part, "(?s)\u0002(.*)", 1)).alias("lines"))

        found = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), section)

        def of(name: str, sections: Column) -> Column:
            return F.flatten(F.transform(F.filter(sections, lambda s: s["label"] == name), lambda s: s["lines"]))

        return let(found, lambda s: F.struct(
            F.array_join(of("description", s), " ").alias("description"),
            *[of(n, s).alias(n) for n in ("benefits", "eligibility", "documents", "steps")]))

    title = tx.squeeze(unescape(F.regexp_replace(F.regexp_extract(body, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", " ")))
    plain = unescape(F.regexp_replace(body, r"<[^>]*>", " "))
    updated = tx.parse_date(F.trim(F.regexp_extract(plain, tx.nocase(fixed.UPDATED_PATTERN), 1)))
    return F.struct(title.alias("scheme_name"), let(F.split(cut, "\u0001"), build).alias("s"), updated.alias("last_updated"))


def embedded_json(html: Column) -> Column:
    """The page's own data payload, when the site ships one."""
    payload = F.regexp_extract(html, r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    return F.get_json_object(F.nullif(payload, F.lit("")), "$.props.pageProps.schemeData")


DEPTH = 3  # levels of lists and objects that are flattened into lines
NO_TEXTS = "array<string>"


def _leaves(value: Column, depth: int = DEPTH) -> Column:
    """The texts of a VARIANT: itself, of a list those of its members, of an object those of its values by key."""
    own = F.array(F.try_variant_get(value, "$", "string"))
    if not depth:
        return own
    kind = F.schema_of_variant(value)
    below = lambda listed: F.flatten(F.transform(listed, lambda x: _leaves(x, depth - 1)))
    return F.when(F.startswith(kind, F.lit("ARRAY")), below(F.try_variant_get(value, "$", "array<variant>"))).when(
        F.startswith(kind, F.lit("OBJECT")), below(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")))).otherwise(own)


def _lines_of(values: Column) -> Column:
    """Plain lines of all texts in VARIANTs."""
    texts = F.array_compact(F.flatten(F.transform(values, lambda x: _leaves(x))))
    return F.flatten(F.transform(texts, lambda x: tx.plain_lines(x)))


def json_detail(raw: Column, name: Column | None = None, updated: Column | None = None) -> Column:
    """Normalised detail record of a JSON body: alternative keys, optional ``data`` and ``en`` levels, texts or lists.

    ``name`` and ``updated`` are what the listing says, for records without them.
    """
    body = F.try_parse_json(raw)
    data = F.coalesce(F.try_variant_get(body, "$.data", "variant"), body)
    inner = F.try_variant_get(data, "$.en", "variant")
    en = F.when(F.startswith(F.schema_of_variant(inner), F.lit("OBJECT")), inner).otherwise(data)
    name = F.lit(None).cast("string") if name is None else name
    updated = F.lit(None).cast("timestamp") if updated is None else updated

    def record(en: Column) -> Column:
        def first(*paths: str) -> Column:
            given = [F.try_variant_get(en, p, "variant") for p in paths]
            return F.coalesce(*[F.when(~F.to_json(v).isin('""', "[]", "{}", "null"), v) for v in given])

        def text(*paths: str) -> Column:
            return tx.squeeze(F.coalesce(F.try_variant_get(first(*paths), "$", "string"), F.lit("")))

        def listed(*paths: str) -> Column:
            return _lines_of(F.array_compact(F.array(first(*paths))))

        def members(member: str, *paths: str) -> Column:
            every = F.coalesce(F.try_variant_get(first(*paths), "$", "array<variant>"), F.array().cast("array<variant>"))
            return F.transform(every, lambda x: F.coalesce(F.try_variant_get(x, f"$.{member}", "variant"), x))

        def texts(listed: Column) -> Column:
            return F.filter(F.transform(listed, lambda x: tx.squeeze(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))), lambda x: x != "")

        day = F.coalesce(_first_text(en, UPDATED_KEYS), _first_text(en, UPDATED_KEYS, "$.basicDetails"))
        return F.struct(
            F.coalesce(F.nullif(text("$.basicDetails.schemeName"), F.lit("")), tx.squeeze(name), F.lit("")).alias("scheme_name"),
            text("$.basicDetails.nodalMinistryName", "$.basicDetails.nodalDepartmentName").alias("department"),
            text("$.basicDetails.state").alias("state"), F.array_join(texts(members("label", "$.basicDetails.schemeCategory")), ", ").alias("category"),
            F.array_join(listed("$.schemeContent.briefDescription", "$.schemeContent.detailedDescription_md"), " ").alias("description"),
            listed("$.schemeContent.benefits_md", "$.schemeContent.benefits").alias("benefits"),
            listed("$.eligibilityCriteria.eligibilityDescription_md", "$.eligibilityCriteria.eligibilityDescription").alias("eligibility"),
            _lines_of(members("process_md", "$.applicationProcess")).alias("steps"),
            F.when(day.isNotNull(), tx.parse_date(day)).otherwise(updated).alias("last_updated"),
            text("$.basicDetails.level").alias("scheme_type"),
            _lines_of(members("documentsRequired_md", "$.documents_required", "$.documentsRequired")).alias("documents"),
            texts(members("label", "$.basicDetails.tags")).alias("tags"))

    return let(en, record)


def page_detail(html: Column, name: Column | None = None, updated: Column | None = None) -> Column:
    """Detail record of a page: its embedded payload when there is one, else what the HTML shows."""
    known = F.lit(None).cast("string") if name is None else name
    day = F.lit(None).cast("timestamp") if updated is None else updated

    def choose(payload: Column) -> Column:
        given, seen = json_detail(payload, name, updated), html_detail(html)
        none = F.array().cast(NO_TEXTS)
        titled = F.rlike(html, F.lit(r"(?i)<h1[\s>]"))
        shown = F.struct(
            F.when(titled, seen["scheme_name"]).otherwise(F.coalesce(tx.squeeze(known), F.lit(""))).alias("scheme_name"),
            *[F.lit("").alias(n) for n in ("department", "state", "category")],
            seen["s"]["description"].alias("description"), seen["s"]["benefits"].alias("benefits"), seen["s"]["eligibility"].alias("eligibility"),
            F.coalesce(seen["s"]["steps"], none).alias("steps"), F.coalesce(seen["last_updated"], day).alias("last_updated"),
            F.lit("").alias("scheme_type"), F.coalesce(seen["s"]["documents"], none).alias("documents"), none.alias("tags"))
        return F.when(payload.isNotNull(), given).otherwise(shown)

    return let(embedded_json(html), choose)


def required_content(df: DataFrame, name: Column, description: Column, benefits: Column, conditions: Column) -> DataFrame:
    """Reason a record cannot become a document: null when it can."""
    reason = F.when(F.coalesce(name, F.lit("")) == "", "scheme_name missing").when(
        (F.coalesce(description, F.lit("")) == "") & (F.size(benefits) <= 0) & (F.size(conditions) <= 0),
        "no description, benefits or eligibility extracted")
    return df.withColumn("reject_reason", reason)
