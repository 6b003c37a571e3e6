"""Heavy work on the rows of small files is dealt to all tasks, and gives the same rows."""

import pytest
from pyspark.sql import functions as F

from docweave.catalog.registry import QUERIES, Tables
from docweave.operators import mentions

SF = "/root/testdata/sf0.001"


def test_spread_keeps_rows(spark):
    t = Tables(spark, SF)
    assert t.spread("part").exceptAll(t.part).count() == t.part.exceptAll(t.spread("part")).count() == 0


@pytest.mark.parametrize("name", ["src7_json_detail", "src7_detail_record", "txt5_preprocess", "txt24_typo_repair"])
def test_queries_deal_their_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_joint_states_are_still_repaired(spark):
    rows = [(1, "from tamilnadu to Uttar-pradesh"), (2, "no state at all"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "text_id long, text string")
    fixed = {r["text_id"]: r["fixed"] for r in mentions.fix_typos(df, ["zzzz"], [], ["Tamil Nadu", "Uttar Pradesh"]).collect()}
    assert fixed == {1: "from Tamil Nadu to Uttar Pradesh", 2: "no state at all", 3: "", 4: None}
