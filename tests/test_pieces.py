"""Order of sorted results, and table scores against plain Python."""

import pytest

from gridgauge.functions import tables as tb
from gridgauge.operators import metrics, sequences
from gridgauge.plans import QUERIES
from gridgauge.sources import payloads

TOOLS = "pymupdf docling aws_textract google_docai gpt5 claude_sonnet mistral".split()
down = lambda x: (x is None, 0 if x is None else -x)


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("jn_01_srt_01_extraction_document", lambda r: (r.filename, r.tool_name, r.table_index)), ("srt_02_by_tier", lambda r: (r.complexity_tier, r.tool_name, r.table_index)), ("srt_05_as_text", lambda r: r.failure_reason),
        ("srt_11_page", lambda r: (r.filename, r.document_id)), ("src_01_documents", lambda r: (r.uploaded_at, r.document_id)), ("src_02_documents_newest", lambda r: (-r.uploaded_at.toordinal(), r.document_id)),
        ("agg_30_document_page", lambda r: (r.document_id, down(r.f1), TOOLS.index(r.tool_name))), ("src_04_run", lambda r: r.table_index), ("agg_55_carriers", lambda r: r.carrier),
    ],
)
def test_order(spark, sf_dir, name, key):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) > 1 and [key(r) for r in rows] == sorted(key(r) for r in rows)


def test_srt_03_04_order(spark, sf_dir):
    rows = QUERIES["srt_03_04_top_documents"](spark, sf_dir).collect()
    by_tool = {}
    for r in sorted(rows, key=lambda r: r.place):
        by_tool.setdefault(r.tool_name, []).append(r)
    assert all([(down(r.f1_score), r.document_id) for r in x] == sorted((down(r.f1_score), r.document_id) for r in x) and [r.place for r in x] == list(range(1, len(x) + 1)) for x in by_tool.values())


def tokens(headers, rows):
    out = ["<table>"]
    for r in ([headers] if headers else []) + rows:
        out += ["<tr>", *[y for x in r for y in ("<td>", (x or "").strip().lower(), "</td>") if y], "</tr>"]
    return [*out, "</table>"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def lines_likeness(a, b):
    def jaccard(x, y):
        shared = sum(min(x.count(c), y.count(c)) for c in set(x))
        every = len(x) + len(y) - shared
        return shared / every if every else 1.0

    return float(not a and not b) if not a or not b else sum(max(jaccard(x, y) for y in b) for x in a) / len(a)


PAIRS = [
    (["A", "b"], [["x", "y"], ["z", ""]], ["a", "B "], [["x", "y"], ["q", None]]), ([], [], [], []), (["a"], [["1"], ["1"], ["2"]], ["a"], [["1"]]), ([], [["a", "b"], ["c"]], ["h"], []),
    (["h", "i"], [["a", "b"]] * 5 + [["c", "d"]], ["h", "i"], [["c", "d"], ["a", "b"], ["b", "a"]]), (["same"], [["x"] * 7] * 9, ["same"], [["x"] * 6] * 11),
]


def test_scores_in_plain_python(spark):
    rows = [(k, *p) for k, p in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "k int, pred_headers array<string>, pred_rows array<array<string>>, true_headers array<string>, true_rows array<array<string>>")
    teds = {r.k: r for r in metrics.teds(df, ["k"]).collect()}
    every = {r.k: r for r in metrics.scores(df, ["k"]).collect()}
    clean = lambda g: [[(x or "").strip().lower() for x in r] for r in g]
    for k, ph, pr, th, tr in rows:
        a, b = tokens(ph, pr), tokens(th, tr)
        assert (teds[k].distance, teds[k].longest) == (edits(a, b), max(len(a), len(b)))
        p, t = clean(([ph] if ph else []) + pr), clean(([th] if th else []) + tr)
        columns = lambda g: [[r[i] for r in g if len(r) > i] for i in range(max(map(len, g), default=0))]
        assert abs(every[k].grits_con - lines_likeness(p, t)) < 1e-12 and abs(every[k].grits_loc - lines_likeness(columns(p), columns(t))) < 1e-12
        shape = lambda x, y: min(len(x), len(y)) / max(len(x), len(y)) if x or y else 1.0
        top = float(not p and not t) if not p or not t else shape(p, t) * shape(columns(p), columns(t))
        assert abs(every[k].grits_top - top) < 1e-12 and abs(every[k].teds_score - (1 - edits(a, b) / max(len(a), len(b)))) < 1e-12


def test_repair_keeps_commas_in_strings():
    assert payloads.repair_json('{"a": "x,]", "b": [1,],}') == '{"a": "x,]", "b": [1]}'
    assert payloads.repair_json('[{"a": 1}, {"b": "cut') == '[{"a": 1}]'


def test_consolidate_after_headers_that_are_data(spark):
    df = spark.createDataFrame([(1, 0, ["A", "B"], [["1", "2"]]), (1, 1, ["b", "a"], [["3", "4"], ["b", "a"]])], "g int, table_index int, headers array<string>, rows array<array<string>>")
    got = sequences.consolidate(df, ["g"]).collect()
    assert len(got) == 1 and got[0].rows == [["1", "2"], ["3", "4"]] and got[0].headers == ["A", "B"] and tb
