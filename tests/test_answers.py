"""Answers of a paged service by their tokens."""

import json

from gridgauge.sources import payloads

SCHEMA = "doc long, token string, next_token string, payload string"


def places(spark, rows):
    got = payloads.answers_in_order(spark.createDataFrame(rows, SCHEMA), ["doc"]).collect()
    return {d: [(r.payload, r.whole) for r in sorted((r for r in got if r.doc == d), key=lambda r: r.place)] for d in {r.doc for r in got}}


def test_order_of_answers(spark):
    got = places(spark, [
        (1, "b", None, "c"), (1, None, "a", "a"), (1, "a", "b", "b"),  # out of order
        (2, "", "", "only"), (2, "x", None, "old"),  # one answer, and one that nothing leads to
        (3, None, "a", "a"), (3, "a", "b", "b"),  # the last one is missing
        (4, None, "a", "a"), (4, "a", "a", "b"), (5, None, "a", "a"), (5, "a", "b", "b"), (5, "b", "a", "c"),  # tokens that come again
        (6, None, "a", "a"), (6, None, "a", "a"), (6, None, None, "a"), (6, "a", None, "b"),  # asked again
        (7, "a", None, "b"),  # without a first answer
        (8, None, "a", None), (8, "a", None, "b"),  # an answer without a payload
    ])
    assert got == {
        1: [("a", True), ("b", True), ("c", True)], 2: [("only", True)], 3: [("a", False), ("b", False)], 4: [("a", False), ("b", False)], 5: [("a", False), ("b", False), ("c", False)],
        6: [("a", True), ("b", True)], 8: [(None, True), ("b", True)],
    }
    assert places(spark, []) == {}


def test_long_chain(spark):
    rows = [(1, f"t{k}" if k else None, f"t{k + 1}" if k < 1999 else None, str(k)) for k in range(2000)]
    assert places(spark, rows[::-1])[1] == [(str(k), True) for k in range(2000)]


def test_graph_over_two_answers(spark):
    """A cell is in one answer, its words and its table in the other; a damaged answer and blocks without relations are no fault."""
    child = lambda *ids: [{"Type": "CHILD", "Ids": list(ids)}, {"Type": "MERGED_CELL", "Ids": ["w9"]}]
    cell = lambda i, r, *ids, **more: {"Id": i, "BlockType": "CELL", "RowIndex": r, "ColumnIndex": 1, "Relationships": child(*ids), "Confidence": 80.0, **more}
    first = [{"Id": "t", "BlockType": "TABLE", "Relationships": child("c1", "c2", "c3")}, {"Id": "w1", "BlockType": "WORD", "Text": "Sum"}, {"Id": "w2", "BlockType": "WORD", "Text": "due"}, cell("c3", 3, "s")]
    second = [cell("c1", 1, "w1", "w2", EntityTypes=["COLUMN_HEADER"]), cell("c2", 2, "w3"), {"Id": "w3", "BlockType": "WORD", "Text": "5"}, {"Id": "s", "BlockType": "SELECTION_ELEMENT", "SelectionStatus": "SELECTED"}]
    rows = [(1, "a", "b", json.dumps({"Blocks": second})), (1, None, "a", json.dumps({"Blocks": first})), (1, "b", None, '{"Blocks": [{'), (2, None, None, "{}"), (3, None, None, None)]
    answers = payloads.answers_in_order(spark.createDataFrame(rows, SCHEMA), ["doc"])
    got = payloads.blocks_to_tables(payloads.blocks_of(answers, ["doc"]), ["doc"]).collect()
    assert [(r.doc, r.headers, r.rows, r.confidence) for r in got] == [(1, ["Sum due"], [["5"], ["[X]"]], 80.0)]
