"""Two-phase loads: counts, cleaning, and what a crash between the phases leaves."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import loads

RECORD = "source_file string, n long, metadata struct<scheme_name string, state string>, overview struct<description string>"


def records(spark, rows):
    return spark.createDataFrame([(f, n, None if name is None else (name, "Goa"), (text,)) for f, n, name, text in rows], RECORD)


def build(docs):
    return docs.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("section"), "source_file", "overview.description").select(
        F.concat_ws("_", "source_file", "section").alias("chunk_id"), "source_file", F.col("description").alias("text"))


def embed(chunks):
    return chunks.withColumn("vector", F.array(F.length("text").cast("double")))


@pytest.fixture
def tables(spark, tmp_path):
    documents = loads.document_table(spark, str(tmp_path / "documents"), records(spark, []).schema, 3)
    return documents, loads.chunk_table(spark, str(tmp_path / "chunks"), embed(build(records(spark, []))).schema, 3)


def state(documents):
    return {r.source_file: (r.n, r.metadata and r.metadata.scheme_name, r.overview.description, r.embedding_status, r.suspect) for r in documents.read().collect()}


ROWS = [("f1", 2, "Old age ** Sign Out **", "text one"), ("f1", 1, "Farm aid", "text two"), ("f2", 3, "Plan are you sure you want to sign out?", None),
        ("f3", 4, None, "no name"), ("f4", 5, "", ""), (None, 6, "x", "y"), ("f5", 7, "bad", "refused")]


def load(documents, df):
    return loads.load_documents(documents, df, "n", F.col("n") != 7).first().asDict()


def test_counts_add_up_and_repeats_change_nothing(spark, tables):
    documents, chunks = tables
    df = records(spark, ROWS)
    assert load(documents, df) == {"inserted": 4, "skipped": 1, "failed": 2, "total": 7}
    want = {"f1": (1, "Farm aid", "text two", "pending", None), "f2": (3, "Plan", None, "pending", "are you sure you want to sign out"),
            "f3": (4, None, "no name", "pending", None), "f4": (5, "", "", "pending", None)}
    assert state(documents) == want
    assert load(documents, df) == {"inserted": 0, "skipped": 5, "failed": 2, "total": 7} and state(documents) == want
    assert loads.embed_documents(documents, chunks, build, embed).first().asDict() == {"embedded": 8, "skipped": 0, "done": 4}
    assert {s[3] for s in state(documents).values()} == {"done"}
    assert loads.embed_documents(documents, chunks, build, embed).first().asDict() == {"embedded": 0, "skipped": 0, "done": 0}
    assert load(documents, records(spark, [("f9", 1, "New", "t")])) == {"inserted": 1, "skipped": 0, "failed": 0, "total": 1}
    assert loads.embed_documents(documents, chunks, build, embed).first().asDict() == {"embedded": 2, "skipped": 0, "done": 1}
    assert len(state(documents)) == 5 and chunks.read().count() == 10


def test_a_crash_between_chunks_and_status(spark, tables, monkeypatch):
    documents, chunks = tables
    load(documents, records(spark, ROWS))
    monkeypatch.setattr(documents, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        loads.embed_documents(documents, chunks, build, embed)
    monkeypatch.undo()
    assert {s[3] for s in state(documents).values()} == {"pending"} and chunks.read().count() == 8
    assert loads.embed_documents(documents, chunks, build, embed).first().asDict() == {"embedded": 0, "skipped": 8, "done": 4}
    assert {s[3] for s in state(documents).values()} == {"done"} and chunks.read().count() == 8


def test_nothing_to_load(spark, tables):
    documents, chunks = tables
    assert load(documents, records(spark, [])) == {"inserted": 0, "skipped": 0, "failed": 0, "total": 0}
    assert loads.embed_documents(documents, chunks, build, embed).first().asDict() == {"embedded": 0, "skipped": 0, "done": 0}


def test_rows_that_are_not_loaded_are_not_written(spark, tables, monkeypatch):
    """Only inserted records are staged; new chunks and finished documents are written by their tables alone."""
    documents, chunks = tables
    names, real = [], loads.stored

    def spy(df, name, *partitions):
        out = real(df, name, *partitions)
        names.append((name, out))
        return out

    monkeypatch.setattr(loads, "stored", spy)
    load(documents, records(spark, ROWS))
    staged = dict(names)["staged"].collect()
    assert len(staged) == len(ROWS)
    assert all((r.n is None) == (r.outcome != "inserted") for r in staged)
    assert all(r.overview is None and r.metadata is None for r in staged if r.outcome != "inserted")
    loads.embed_documents(documents, chunks, build, embed)
    assert "text" not in {c for n, df in names if n != "staged" and n != "built" for c in df.columns}
    assert "overview" not in {c for n, df in names if n != "staged" for c in df.columns}
