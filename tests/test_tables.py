"""Merging, scoring and table functions against small known cases and plain-Python formulas."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.functions import text
from gridgauge.operators import merge, metrics, quality, truth
from gridgauge.sources import payloads

TABLE = "doc long, page_number int, table_index int, headers array<string>, rows array<array<string>>"
PAIR = "k long, pred_headers array<string>, pred_rows array<array<string>>, true_headers array<string>, true_rows array<array<string>>"


def one(spark, c, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v)
    return df.select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs))


@pytest.mark.parametrize(
    ("tables", "want"),
    [
        ([(1, 1, 0, ["A", "B"], [["3", "4"]]), (1, 0, 0, ["A", "B"], [["1", "2"]])], [(2, [["1", "2"], ["3", "4"]], 0, 1)]),
        ([(1, 0, 0, ["Foo"], [["1"]]), (1, 0, 1, ["Bar"], [["2"]])], [(1, [["1"]], 0, 0), (1, [["2"]], 0, 0)]),
        ([(1, 0, 0, ["H"], [["1"]]), (1, 0, 1, ["Other"], [["2"]]), (1, 0, 2, ["H"], [["3"]])], [(1, [["1"]], 0, 0), (1, [["2"]], 0, 0), (1, [["3"]], 0, 0)]),
        ([(1, 0, 0, ["", ""], [["1", "2"]]), (1, 0, 1, ["", ""], [["3", "4"]])], [(1, [["1", "2"]], 0, 0), (1, [["3", "4"]], 0, 0)]),
        ([(1, None, 0, [" h "], [["1"]]), (1, None, 1, ["H"], [["2"]])], [(2, [["1"], ["2"]], 0, 0)]),
        ([(1, 0, 0, ["h"], [["1"]]), (1, 0, 1, ["H"], [])], [(1, [["1"]], 0, 0), (1, [], 0, 0)]),
        ([], []),
    ],
)
def test_merge(spark, tables, want):
    got = merge.merge_fragments(spark.createDataFrame(tables, TABLE), ["doc"]).orderBy("table_index").collect()
    assert [(r.merged_from, r.rows, r.page_from, r.page_to) for r in got] == want
    assert [r.table_index for r in got] == list(range(len(want)))
    assert sum(r.row_count for r in got) == sum(len(t[4]) for t in tables)


def norm(x):
    import re

    s = re.sub(r"[$€£¥₹]", "", ("" if x is None else str(x)).strip().lower())
    return re.sub(r"\s+", " ", re.sub(r"(?<=\d),(?=\d{3})", "", s)).strip()


def plain_scores(ph, pr, th, tr):
    a, b = Counter(norm(c) for r in pr for c in r), Counter(norm(c) for r in tr for c in r)
    tp = sum((a & b).values())
    p, r = tp / max(sum(a.values()), 1), tp / max(sum(b.values()), 1)
    f1 = 2 * p * r / (p + r) if p + r else 0.0
    grid = lambda h, rows: ([[norm(c) for c in h]] if h else []) + [[norm(c) for c in r] for r in rows]
    jac = lambda x, y: (sum((Counter(x) & Counter(y)).values()) / sum((Counter(x) | Counter(y)).values())) if x or y else 1.0
    best = lambda x, y: 1.0 if not x and not y else 0.0 if not x or not y else sum(max(jac(i, j) for j in y) for i in x) / len(x)
    g, t = grid(ph, pr), grid(th, tr)
    cols = lambda g: [[r[i] for r in g if len(r) > i] for i in range(max(map(len, g), default=0))]
    ratio = lambda x, y: min(x, y) / max(x, y) if max(x, y) else 1.0
    top = 1.0 if not g and not t else 0.0 if not g or not t else ratio(len(g), len(t)) * ratio(len(cols(g)), len(cols(t)))
    return {"precision": p, "recall": r, "f1_score": f1, "grits_top": top, "grits_con": best(g, t), "grits_loc": best(cols(g), cols(t))}


def tokens(h, rows):
    out = ["<table>"]
    for r in ([h] if h else []) + rows:
        out.append("<tr>")
        for c in r:
            out += ["<td>", *([norm(c)] if norm(c) else []), "</td>"]
        out.append("</tr>")
    return [*out, "</table>"]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def random_pairs(n=60, seed=5):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["a", "B ", "$1,234.50", "", "x  y", None, "é"])
    table = lambda: ([cell() or "" for _ in range(rng.randint(0, 3))], [[cell() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 4))])
    return [(k, *table(), *table()) for k in range(n)] + [(n, [], [], [], []), (n + 1, [], [["a", "b"], ["a", "c"]], [], [["a", "b"], ["c", "d"]])]


def test_scores_like_plain_python(spark):
    pairs = random_pairs()
    got = {r.k: r for r in metrics.scores(spark.createDataFrame(pairs, PAIR), ["k"]).collect()}
    assert len(got) == len(pairs)
    for k, ph, pr, th, tr in pairs:
        want = plain_scores(ph, pr, th, tr)
        a, b = tokens(ph, pr), tokens(th, tr)
        want["teds_score"] = 1 - edit(a, b) / max(len(a), len(b))
        for m, v in want.items():
            assert got[k][m] == pytest.approx(v, abs=1e-9), (k, m, ph, pr, th, tr)


def test_distance(spark):
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert metrics.distance(a, b) == edit(a, b)
    pairs = random_pairs(10, 9)
    for r in metrics.teds(spark.createDataFrame(pairs, PAIR), ["k"]).collect():
        _, ph, pr, th, tr = pairs[r.k]
        assert r.distance == edit(tokens(ph, pr), tokens(th, tr))


def test_cells(spark):
    for raw, want in ((" $1,234.50 ", "1234.50"), (None, ""), ("A \t B\n", "a b"), ("1,2345", "12345"), ("€ 5", "5")):
        assert one(spark, text.cell(F.lit(raw).cast("string"))) == want == norm(raw)


def test_widths_and_empty(spark):
    assert one(spark, tb.to_width(arr("a", None), 3)) == ["a", "", ""]
    assert one(spark, tb.to_width(arr("a", "b"), 1)) == ["a"]
    h, r = tb.drop_empty(arr("A", "", ""), F.array(arr("1", "", "x"), arr(" ", "", "")))
    assert one(spark, F.struct(h.alias("h"), r.alias("r"))) == (["A", ""], [["1", "x"]])
    h, r = tb.reconcile(arr("A"), F.array(arr("1", "2"), arr("3")))
    assert one(spark, F.struct(h.alias("h"), r.alias("r"))) == (["A", "Col 2"], [["1", "2"], ["3", ""]])
    assert one(spark, tb.unique_names(arr("a", "a", "", "a"))) == ["a", "a_1", "Column_3", "a_2"]
    assert one(spark, tb.auto_named(arr("Column 1", "column 2"))) is True
    assert one(spark, tb.zip_headers(F.array(arr("a", "b"), arr("", "c")))) == ["a", "b c"]
    assert one(spark, tb.fill_sub_headers(arr("Name", "", "", "Q"))) == ["Name", "Name 2", "Name 3", "Q"]
    assert one(spark, tb.split_compound(arr("a  b", "c / d", "e"))) == ["a", "b", "c", "d", "e"]


def test_chunks_and_pages(spark):
    assert one(spark, tb.chunk_lines(arr("aa", "bb", "cccccc", "d"), 5)) == ["aa\nbb", "cccccc", "d"]
    assert one(spark, tb.page_ranges(F.lit(7), 3)) == [(0, 2), (3, 5), (6, 6)]
    assert one(spark, tb.representative_pages(F.lit(4), 9)) == [0, 1, 2, 3]
    got = one(spark, tb.representative_pages(F.lit(100), 9))
    assert got[:3] == [0, 1, 2] and got[-3:] == [97, 98, 99] and len(got) == 9


@pytest.mark.parametrize(("raw", "want"), [("($1,200.00)", "-$1200.00"), ("(5.00)", "-$5.00"), ("(0)", "-0"), ("($-1$)", "-$1"), ("$7", "$7"), ("abc", "abc"), ("", ""), (None, None)])
def test_brackets(spark, raw, want):
    assert one(spark, tb.brackets(F.lit(raw).cast("string"))) == want


def test_quality(spark):
    t = spark.createDataFrame([(1, 0, 0, ["Company", "Amount"], [["x", "$5.00"], ["y", ""]]), (2, 0, 0, [], [])], TABLE)
    got = {r.doc: r for r in quality.validate(t, F.lit(1.0)).collect()}
    assert got[1].completeness == 0.75 and got[1].level in ("excellent", "good", "acceptable", "poor", "failed")
    assert "empty" in got[2].issues and "no_headers" in got[2].issues


def test_truth_merge_undo(spark):
    schema = f"document_id long, table_index int, headers array<string>, rows array<array<string>>, notes string, source string, confirmed boolean, correction_count int, log {truth.LOG}"
    rows = [(1, k, ["a", "b"], [[str(k)], ["x", "y", "z"]], None, "manual", True, 0, []) for k in range(3)]
    t = spark.createDataFrame(rows, schema)
    o = spark.createDataFrame([(1, 0, 1, 0)], "document_id long, primary int, secondary int, survivor int")
    m = truth.merge_tables(t, o)
    got = m.orderBy("table_index").collect()
    assert [r.table_index for r in got] == [0, 1] and got[0].rows == [["0", ""], ["x", "y"], ["1", ""], ["x", "y"]] and got[0].correction_count == 1
    back = truth.undo_merge(m, o).orderBy("table_index").collect()
    assert [r.rows for r in back] == [r[3] for r in rows] and not back[0].log


def test_blocks(spark):
    word = lambda i, t: (1, i, "WORD", [], 0, 0, 1, 1, False, 0.0, t, False)
    cell = lambda i, kids, r, c, h=False: (1, i, "CELL", kids, r, c, 1, 1, h, 90.0, None, False)
    blocks = [
        (1, "t", "TABLE", ["c1", "c2", "c3", "c4", "c5"], 0, 0, 1, 1, False, 0.0, None, False), cell("c1", ["w1"], 1, 1, True), cell("c2", [], 1, 2, True), cell("c3", ["w2", "w3"], 2, 1), cell("c4", ["s"], 2, 2), cell("c5", [], 2, 3),
        word("w1", "Head"), word("w2", "two"), word("w3", "words"), (1, "s", "SELECTION_ELEMENT", [], 0, 0, 1, 1, False, 0.0, None, True),
    ]
    df = spark.createDataFrame(blocks, "doc long, id string, type string, children array<string>, row int, col int, row_span int, col_span int, is_header boolean, confidence double, text string, selected boolean")
    got = payloads.blocks_to_tables(df, ["doc"]).collect()
    assert [(r.headers, r.rows, r.confidence) for r in got] == [(["Head", ""], [["two words", "[X]"]], 90.0)]


@pytest.mark.parametrize(("raw", "want"), [('```json\n{"a":1,}\n```', '{"a": 1}'), ('x {"t":[{"r":[1,2]},{"r":[3', '{"t": [{"r": [1, 2]}]}'), ("no", None), (None, None), ('{"a":"}"}', '{"a": "}"}')])
def test_repair(raw, want):
    assert payloads.repair_json(raw) == want


def test_markdown(spark):
    from gridgauge.sources import markdown

    doc = "intro\n| A | | B |\n|---|---|---|\n| 1 | 2 | 3 |\n|  |  |  |\nend\n| only |\n"
    got = markdown.tables(spark.createDataFrame([(1, doc), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.table_index, r.headers, r.rows) for r in got] == [(1, 0, ["A", "B"], [["1", "2", "3"]])]
