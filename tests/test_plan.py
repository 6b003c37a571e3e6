from docweave import fixed
from docweave.functions import text as tx
from docweave.plans.corpus import build_documents


def test_page_to_document(spark):
    page = ("Capital Subsidy PlanCheck EligibilityDetailsBenefitsEligibilitySources And ReferencesThis plan helps small units.Sign In"
            "BenefitsSubsidy of 25% on machinery cost.ApplyEligibilityMSME units only.Open to all states."
            "Frequently Asked QuestionsWho can get it?Any unit.When?Any time.")
    terms = tx.heading_terms(fixed.HEADINGS, fixed.HEADING_SYNONYMS)
    known = [("Benefits", "benefits", 0.9), ("Eligibility", "eligibility", 0.9), ("Frequently Asked Questions", "faqs", 0.8),
             ("Sources And References", "objectives", 0.2)]
    headings = spark.createDataFrame(known, "heading string, category string, score double")
    pages = spark.createDataFrame([(1, page), (2, "nothing to find")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in build_documents(pages, headings, terms, fixed.FALLBACK_NOISE).collect()}
    doc = rows[1]["doc"]
    assert doc["overview"]["description"] == "This plan helps small units."
    assert doc["benefits"]["other_benefits"] == ["Subsidy of 25% on machinery cost."]
    assert doc["eligibility"]["conditions"] == ["MSME units only.", "Open to all states."]
    assert [(q["question"], q["answer"]) for q in doc["faq"]] == [("Who can get it?", "Any unit."), ("When?", "Any time.")]
    assert rows[1]["reject_reason"] is None and rows[2]["reject_reason"].startswith("no description")
