"""Corpus profiles, previews and quality scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docweave.functions import text as tx


def profile(df: DataFrame, name: str, text: str, pages: Column, size_bytes: Column,
            keep: list[Column] | None = None) -> DataFrame:
    """Pages, size, words and characters of every document; a null text counts as corrupted."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(name).alias("file_name"),
        pages.cast("long").alias("pages"),
        F.round(size_bytes / 1024, 2).alias("file_size_kb"),
        (tx.strip(body) != "").alias("has_text"),
        tx.word_count(body).alias("word_count"),
        F.length(body).cast("long").alias("character_count"),
        F.when(F.col(text).isNull(), F.lit("Corrupted")).otherwise(F.lit("Valid")).alias("status"),
        *(keep or []),
    )


def profile_summary(profiled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, page statistics, averages and the largest and smallest document (ties: first name)."""
    words, pages = F.col("word_count"), F.col("pages")
    return profiled.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("status") == "Valid").alias("valid"),
        F.count_if(F.col("status") == "Corrupted").alias("corrupted"),
        F.count_if("has_text").alias("with_text"),
        F.count_if(~F.col("has_text")).alias("without_text"),
        F.sum(pages).alias("total_pages"),
        F.round(F.avg(pages), 2).alias("avg_pages"),
        F.max(pages).alias("max_pages"),
        F.min(pages).alias("min_pages"),
        F.sum(words).alias("total_words"),
        F.round(F.avg(words), 2).alias("avg_words"),
        F.sum("character_count").alias("total_characters"),
        F.round(F.avg("character_count"), 2).alias("avg_characters"),
        F.min_by("file_name", F.struct(-words, F.col("file_name"))).alias("largest_document"),
        F.min_by("file_name", F.struct(words, F.col("file_name"))).alias("smallest_document"),
    )


def preview(df: DataFrame, id_col: str, text: str, documents: int = 25, lines: int = 30) -> DataFrame:
    """The first lines of a repeatable sample of documents: lowest hash of the id first."""
    picked = df.orderBy(F.sha2(F.col(id_col).cast("string"), 256), id_col).limit(documents)
    kept = F.filter(F.transform(F.split(text, "\n"), tx.strip), lambda x: x != "")
    return picked.select(id_col, F.posexplode(F.slice(kept, 1, lines)).alias("line_no", "line"))


def encoding_hits(df: DataFrame, id_col: str, text: str, markers: list[str]) -> DataFrame:
    """One row per marker character with its surroundings."""
    found = df.filter(F.rlike(F.col(text), F.lit("[" + "".join(markers) + "]")))
    return found.select(id_col, F.explode(tx.marker_hits(F.col(text), markers)).alias("hit")).select(id_col, "hit.*")


def encoding_summary(df: DataFrame, text: str, markers: list[str]) -> DataFrame:
    """Documents with and without artifacts, markers and replacement characters in total."""
    body = F.col(text)
    count = sum((tx.occurrences(body, m) for m in markers), F.lit(0).cast("long"))
    bad = tx.occurrences(body, "�")
    return df.select(count.alias("c"), bad.alias("b")).agg(
        F.count_if((F.col("c") > 0) | (F.col("b") > 0)).alias("contaminated"),
        F.count_if((F.col("c") == 0) & (F.col("b") == 0)).alias("clean"),
        F.sum("c").alias("marker_hits"),
        F.sum("b").alias("replacement_characters"),
    )


def json_field_errors(df: DataFrame, id_col: str, raw: str, schema: dict[str, str]) -> DataFrame:
    """One error row per failing field: unreadable row, text that is not JSON, missing or mistyped field.

    ``schema`` maps a top-level field to the VARIANT type names that are accepted.
    """
    parsed = df.select(id_col, raw, F.try_parse_json(raw).alias("_v"))
    kind = F.schema_of_variant("_v")
    checks = []
    for field, accepted in schema.items():
        value = F.try_variant_get("_v", f"$.{field}", "variant")
        found = F.schema_of_variant(value)
        good = F.rlike(found, F.lit(f"^(?:{accepted})"))
        checks.append(F.when(value.isNull(), F.struct(
            F.lit(field).alias("field"), F.lit("field required").alias("message"), F.lit(None).cast("string").alias("value")))
            .when(~good, F.struct(
                F.lit(field).alias("field"), F.lit("wrong type").alias("message"), F.to_json(value).alias("value"))))

    def root(message: str) -> Column:
        return F.array(F.struct(F.lit("<root>").alias("field"), F.lit(message).alias("message"),
                                F.lit(None).cast("string").alias("value")))

    errors = (
        F.when(F.col(raw).isNull(), root("unreadable"))
        .when(F.col("_v").isNull(), root("not JSON"))
        .when(~F.startswith(kind, F.lit("OBJECT")), root("not an object"))
        .otherwise(F.array_compact(F.array(*checks)))
    )
    return parsed.select(id_col, F.explode(errors).alias("e")).select(id_col, "e.*")


#: What ``schema_of_variant`` calls the values that a type accepts.
VARIANT_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "bigint": "BIGINT|TINYINT|SMALLINT|INT|LONG", "int": "BIGINT|TINYINT|SMALLINT|INT|LONG",
                 "double": r"DOUBLE|FLOAT|DECIMAL\(.*\)|BIGINT|TINYINT|SMALLINT|INT|LONG"}
_ERROR = "array<struct<field:string,message:string,value:string>>"


def nested_errors(value: Column, kind: T.DataType, path: Column) -> Column:
    """The failing parts of a VARIANT against a type of any depth, each with its dotted path and its JSON.

    An object's fields follow their declaration, an array's elements their order. A field that is not nullable must
    be there; one that is may be missing or null. A value of the wrong type is one error, and nothing below it is read.
    """
    none = F.array().cast(_ERROR)
    at = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))

    def one(message: str) -> Column:
        shown = F.when(path == "", F.lit("<root>")).otherwise(path)
        return F.array(F.struct(shown.alias("field"), F.lit(message).alias("message"), F.to_json(value).alias("value")))

    found = F.schema_of_variant(value)
    if isinstance(kind, T.StructType):
        inner = []
        for field in kind.fields:
            part = F.try_variant_get(value, f"$['{field.name}']", "variant")
            missing = F.array(F.struct(at(F.lit(field.name)).alias("field"), F.lit("field required").alias("message"), F.lit(None).cast("string").alias("value")))
            checked = nested_errors(part, field.dataType, at(F.lit(field.name)))
            if field.nullable:
                inner.append(F.when(part.isNull() | F.is_variant_null(part), none).otherwise(checked))
            else:
                inner.append(F.when(part.isNull(), missing).otherwise(checked))
        return F.when(F.startswith(found, F.lit("OBJECT")), F.concat(*inner) if inner else none).otherwise(one("wrong type"))
    if isinstance(kind, T.ArrayType):
        elements = F.try_variant_get(value, "$", "array<variant>")
        inner = F.flatten(F.transform(elements, lambda x, i: nested_errors(x, kind.elementType, at(i.cast("string")))))
        return F.when(F.startswith(found, F.lit("ARRAY")), inner).otherwise(one("wrong type"))
    accepted = VARIANT_KINDS[kind.simpleString()]
    return F.when(F.rlike(found, F.lit(f"^(?:{accepted})$")), none).otherwise(one("wrong type"))


def json_errors(df: DataFrame, id_col: str, raw: str, schema: T.DataType) -> DataFrame:
    """One row per failing leaf of a JSON text at any depth: field (such as ``faq.3.answer``), message and value."""
    parsed = df.select(id_col, raw, F.try_parse_json(raw).alias("_v"))
    root = lambda message: F.array(F.struct(F.lit("<root>").alias("field"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("value")))
    errors = F.when(F.col(raw).isNull(), root("unreadable")).when(F.col("_v").isNull(), root("not JSON")).otherwise(nested_errors(F.col("_v"), schema, F.lit("")))
    return parsed.select(id_col, F.inline(errors))


def missing_json_fields(df: DataFrame, id_col: str, raw: str, expected: list[str]) -> DataFrame:
    """Expected keys absent from a parsed record, in the expected order."""
    want = F.array(*[F.lit(x) for x in expected])
    have = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return df.select(id_col, F.array_except(want, have).alias("missing")).filter(F.size("missing") > 0)


def name_markers(df: DataFrame, id_col: str, name: str, markers: list[str]) -> DataFrame:
    """Rows whose name carries a marker of scraped interface text."""
    lowered = F.lower(F.col(name))
    found = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(lowered, m))
    return df.select(id_col, name, F.element_at(found, 1).alias("marker")).filter(F.size(found) > 0)


