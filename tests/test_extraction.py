"""Clause segmentation, the completeness screen and the assessment of cards on literal rows."""

import pytest

from clausework.operators import extract as X
from clausework.plans import ext as P

CARD = "id int, text string, obligations int, explicit boolean, modality string, example boolean, definition boolean, unknown_condition boolean, ambiguities array<string>"


def test_modal_scopes(spark):
    texts = [
        "The owner must keep logs. He shall  must not leave; but may rest.", "If asked, staff should:", "- sign it", "- must pay", "plain", "- after a plain block", "The form must hold fields: «A», «B» and «C»", "unless told, all must or may do:", "• x", "", None, "must",
    ]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "- item of another document")], "doc int, ord int, text string")
    rows = X.modal_scopes(df, "doc", "ord", "text", P.CUES, P.ITEM, P.CONDITION, P.EXCEPTION, P.FIELDS).orderBy("ord", "start", "object").collect()
    got = [(r.ord, r.subject, r.action, r.object, r.modality, r.conditions, r.exceptions, r.parent, r.group) for r in rows]
    assert got == [
        (0, "The owner", "must", "keep logs.", "mandatory", [], [], None, None), (0, "He", "shall", "He shall  must not leave; but may rest.", "mandatory", [], [], None, None), (0, "He shall", "must not", "leave; but", "prohibited", [], [], None, None), (0, "He shall  must not leave; but", "may", "rest.", "permitted", [], [], None, None),
        (1, "If asked, staff", "should", ":", "recommended", [1], [], None, None), (2, "document_author", "include_item", "- sign it", "recommended", [1], [], 1, None), (3, "-", "must", "pay", "mandatory", [1], [], 1, None),
        (6, "The form", "include_field", "A", "mandatory", [], [], None, "required_fields"), (6, "The form", "include_field", "B", "mandatory", [], [], None, "required_fields"), (6, "The form", "include_field", "C", "mandatory", [], [], None, "required_fields"),
        (7, "unless told, all", "must", "or", "mandatory", [], [7], None, None), (7, "unless told, all must or", "may", "do:", "permitted", [], [7], None, None), (8, "document_author", "include_item", "• x", "mixed", [], [7], 7, None), (11, "document_author", "must", "must", "mandatory", [], [], None, None),
    ]
    for r in rows:  # a scope's span is where its action stands, and scopes of a sentence don't overlap
        assert r.group or r.action == "include_item" or r.action in texts[r.ord][r.start : r.end]
    spans = sorted((r.ord, r.start, r.end) for r in rows if r.group is None)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_cues_of_one_modality_are_one(spark):
    df = spark.createDataFrame([(1, 0, "Staff shall must sign and must pay")], "doc int, ord int, text string")
    got = X.modal_scopes(df, "doc", "ord", "text", P.CUES, P.ITEM, P.CONDITION, P.EXCEPTION, P.FIELDS).orderBy("start").collect()
    assert [(r.start, r.end, r.action, r.object) for r in got] == [(0, 26, "shall", "must sign and"), (26, 34, "must", "pay")]
    plan = X.modal_scopes(df, "doc", "ord", "text", P.CUES, P.ITEM, P.CONDITION, P.EXCEPTION, P.FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # scopes stay within their rows; only the window over a document shuffles
    assert X.modal_scopes(df.where("false"), "doc", "ord", "text", P.CUES, P.ITEM, P.CONDITION, P.EXCEPTION, P.FIELDS).count() == 0


def test_completeness_screen(spark):
    rows = [(1, "keep it", 1, True, "mandatory", None, None, None, None), (2, "a, b", 1, True, "mandatory", False, False, False, []), (3, "x", 0, True, "mandatory", True, True, True, ["two_readings"]), (4, "x", 1, True, "mixed", None, None, None, None), (5, "x", 2, True, "mandatory", None, None, None, None), (6, None, None, None, None, None, None, None, None)]
    cues = spark.createDataFrame([(1, 3), (2, 50), (2, 9), (7, 1)], "id int, pos long")
    spans = spark.createDataFrame([(1, 0, 7), (2, 0, 9)], "id int, start long, end long")
    needs = spark.createDataFrame([(1, False, True), (4, True, True), (5, True, None)], "id int, required boolean, unresolved boolean")
    got = {r.id: (r.structural, r.semantic, r.uncovered, r.reasons) for r in X.completeness_screen(spark.createDataFrame(rows, CARD), cues, spans, needs, "[,;]").collect()}
    assert got == {
        1: ("complete", "verified_simple", [], []), 2: ("incomplete", "unknown", [9, 50], ["complex_syntax_needs_semantic_validation", "uncovered_normative_cues"]),
        3: ("complete", "unknown", [], ["condition_needs_interpretation", "definition_not_an_obligation", "example_not_a_general_rule", "no_obligations", "two_readings"]), 4: ("incomplete", "unknown", [], ["unresolved_dependency"]), 5: ("complete", "unknown", [], []), 6: ("complete", "unknown", [], ["no_obligations"]),
    }


GOOD = dict(locator="p1", entity="requirement", provenance=True, profile=True, approved=False, semantic="verified", structural="complete", ambiguous=False, condition_open=False, resolved=False, applies_known=True, modality="mandatory", obligations=1, conditions=0, operator="atom", operands=0, confidence=0.95)
CASES = [
    ({}, "ready", []), ({"provenance": None}, "candidate", ["provenance"]), ({"semantic": "unknown"}, "candidate", ["incomplete"]), ({"structural": "incomplete"}, "candidate", ["incomplete"]), ({"ambiguous": True}, "candidate", ["ambiguity"]), ({"ambiguous": True, "condition_open": True, "resolved": True}, "ready", []),
    ({"condition_open": True}, "candidate", ["condition"]), ({"locator": "gap"}, "candidate", ["source_gap"]), ({"locator": "gap", "approved": True, "confidence": None}, "ready", []), ({"profile": False}, "candidate", ["profile"]), ({"applies_known": None}, "candidate", ["applicability"]), ({"modality": "permitted"}, "candidate", ["modality"]),
    ({"obligations": None}, "candidate", ["no_obligation"]), ({"operator": "any_of", "operands": 1}, "candidate", ["composition"]), ({"operator": "all_of", "operands": 2}, "ready", []), ({"operator": None}, "candidate", ["composition"]), ({"confidence": 0.5}, "candidate", ["confidence"]), ({"confidence": float("nan")}, "candidate", ["confidence"]),
    ({"entity": "definition", "modality": None, "obligations": 0, "operator": None}, "reference", ["reference"]), ({"entity": "definition", "profile": False}, "candidate", ["profile"]),
]


@pytest.mark.parametrize("quoted", [False, True])
def test_card_assessment(spark, quoted):
    """Each reason by itself, and those that come from quotes, dependencies and gaps."""
    shape = "id int, locator string, entity string, provenance boolean, profile boolean, approved boolean, semantic string, structural string, ambiguous boolean, condition_open boolean, resolved boolean, applies_known boolean, modality string, obligations int, conditions int, operator string, operands int, confidence double"
    extra = [({}, "Approve it"), ({}, "If so, pay"), ({"conditions": 1}, "If so, pay"), ({}, "the duties stand in the annex"), ({"entity": "definition"}, "Approve it")] if quoted else []
    cards = [{**GOOD, **c[0], "id": i} for i, c in enumerate([*CASES, *extra])]
    df = spark.createDataFrame([tuple(c[n.split()[0]] for n in shape.split(", ")) for c in cards], shape)
    n = len(CASES)
    citations = spark.createDataFrame([(n + i, "p1", 0, q) for i, (_, q) in enumerate(extra)] + [(0, "p2", 0, "Approve it: another locator")], "id int, locator string, n int, quote string")
    needs = [(0, True, False, "p2"), (1, True, True, None), (2, True, False, "far"), (3, False, False, "far")] + ([(n + 4, True, False, "p1")] if quoted else [])
    gaps = spark.createDataFrame([("gap",)], "locator string")
    got = {r.id: (r.status, r.reasons) for r in X.quality_reasons(df, citations, spark.createDataFrame(needs, "id int, required boolean, unresolved boolean, target string"), gaps, "^Approve", "^If ", "in the annex").collect()}
    want = {i: (s, list(r)) for i, (_, s, r) in enumerate(CASES)}
    want[1] = ("candidate", ["provenance", "dependency"])
    want[2] = ("candidate", ["incomplete", "dependency_context"])
    if quoted:
        want |= {n: ("candidate", ["administrative_action"]), n + 1: ("candidate", ["implicit_context"]), n + 2: ("ready", []), n + 3: ("candidate", ["context_statement"]), n + 4: ("reference", ["reference"])}
    assert got == want
