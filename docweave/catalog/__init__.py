"""Named queries over the parquet tables, one per operator."""

from docweave.catalog import corpus, eligibility, messages, sections, sinks, streams, tables, turns  # noqa: F401
from docweave.catalog.registry import ORACLES, QUERIES  # noqa: F401
