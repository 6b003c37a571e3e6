"""The nested document schema; every leaf defaults to "" or [], never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _struct(texts: list[str], lists: list[str] | None = None) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in texts]
    return T.StructType(fields + [T.StructField(n, T.ArrayType(T.StringType())) for n in lists or []])


SCHEME = T.StructType([
    T.StructField("metadata", _struct(["scheme_name", "scheme_type", "state", "implementing_department", "category"])),
    T.StructField("overview", _struct(["description"], ["objectives", "beneficiaries"])),
    T.StructField("benefits", _struct(["financial_assistance"], ["other_benefits"])),
    T.StructField("eligibility", _struct([], ["conditions", "exclusions"])),
    T.StructField("application", _struct(["mode"], ["documents", "steps"])),
    T.StructField("support", _struct(["official_website", "helpline"], ["important_dates", "source_links"])),
    T.StructField("faq", T.ArrayType(_struct(["question", "answer"]))),
    T.StructField("search_metadata", _struct([], ["tags", "keywords"])),
    T.StructField("notes", T.StringType()),
])


def _default(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_default(f.dataType, value[f.name]).alias(f.name) for f in kind.fields])
    empty = F.lit("") if isinstance(kind, T.StringType) else F.array().cast(kind)
    return F.coalesce(value, empty)


def filled(df: DataFrame, field: T.StructField) -> Column:
    """The field with every absent leaf replaced by its empty value."""
    return _default(field.dataType, df[field.name])


def completed(doc: Column, have: T.DataType, kind: T.DataType = SCHEME) -> Column:
    """``doc``, of type ``have``, with every leaf of ``kind``: what it lacks, or has as null, is empty."""
    if isinstance(kind, T.StructType):
        present = {f.name: f.dataType for f in have.fields} if isinstance(have, T.StructType) else {}
        null = lambda f: F.lit(None).cast(f.dataType)
        return F.struct(*[(completed(doc[f.name], present[f.name], f.dataType) if f.name in present else _default(f.dataType, null(f))).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        inner = F.transform(doc, lambda x: completed(x, have.elementType, kind.elementType))
        return F.coalesce(inner, F.array().cast(kind))
    return F.coalesce(doc, F.lit(""))
