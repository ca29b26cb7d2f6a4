"""Secret scanning with a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: every text that the rule
can match holds, for each clause, all trigrams of at least one alternative.  Each task builds postings
(trigram to texts) for its block of texts, evaluates the queries on them and runs a rule's expression
over its candidates only.  Rules without mandatory trigrams run over every text.  Postings never leave
their block, so nothing is shuffled.

Cases: null text is empty and has no secrets; repeated rows are scanned each; spans of one start are ordered
by kind as the rules are listed; rows without an id are kept; other columns, whatever their names, are never
read (``redact`` keeps them); an empty table gives an empty result.  Texts are scanned whole, whatever their
length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import per_batch, with_text

#: Alternatives that a literal stretch may stand for before it is cut.
MOST_STRINGS = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """``least`` code points are asked of group ``group``; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + ADDED_RULES

#: A conjunction of clauses; each clause is a set of alternatives, each alternative a set of trigrams.
Query = tuple[frozenset[frozenset[bytes]], ...]


def _clause(strings: set[str]) -> frozenset[frozenset[bytes]] | None:
    out = set()
    for s in strings:
        raw = s.encode().translate(LOWER.tobytes())
        if len(raw) < 3:
            return None
        out.add(frozenset(raw[k : k + 3] for k in range(len(raw) - 2)))
    return frozenset(out)


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """Clauses that every match satisfies, over lower-cased (A-Z) UTF-8; no clause: nothing is mandatory."""
    clauses: list = []

    def flush(held: set[str]) -> set[str]:
        if (c := _clause(held)) is not None:
            clauses.append(c)
        return {""}

    def strings(items) -> set[str] | None:
        """All strings that a piece can match, if they are few."""
        out = {""}
        for op, arg in items:
            if (got := one(op, arg)) is None or len(out := {a + b for a in out for b in got}) > MOST_STRINGS:
                return None
        return out

    def one(op, arg) -> set[str] | None:
        if op is kinds.LITERAL:
            return {chr(arg).lower()}
        if op is kinds.IN and all(k is kinds.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(x).lower() for _, x in arg}
        if op is kinds.SUBPATTERN:
            return strings(arg[3])
        if op is kinds.BRANCH:
            every = [strings(x) for x in arg[1]]
            return None if any(x is None for x in every) else set().union(*every)
        if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[1] <= 3 and (got := strings(arg[2])) is not None:
            out, run = set(), {""}
            for n in range(int(arg[1]) + 1):
                if n >= arg[0]:
                    out |= run
                run = {a + b for a in run for b in got}
                if len(run) > MOST_STRINGS:
                    return None
            return out
        return None

    def walk(items, held: set[str]) -> set[str]:
        for op, arg in items:
            got = one(op, arg)
            if got is not None and len(joined := {a + b for a in held for b in got}) <= MOST_STRINGS:
                held = joined
                continue
            held = flush(held)
            if got is not None:
                held = got
            elif op is kinds.SUBPATTERN:
                held = walk(arg[3], held)
            elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[0] >= 1:
                held = flush(walk(arg[2], held))
        return held

    flush(walk(parser.parse(pattern, flags), {""}))
    return tuple(clauses)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.trigrams = sorted({t for q in self.queries for c in q for alt in c for t in alt})
        self.at = {t: k for k, t in enumerate(self.trigrams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(self.trigrams):
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = k + 1

    def postings(self, data: np.ndarray, ends: np.ndarray, block: int = 1 << 22) -> np.ndarray:
        """[trigram, text]: whether the text holds the trigram; of the rules' trigrams only."""
        held = np.zeros((len(self.trigrams), len(ends)), bool)
        for start in range(0, max(len(data) - 2, 0), block):
            low = LOWER[data[start : start + block + 2]].astype(np.uint32)
            codes = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            where = np.flatnonzero(codes)
            text = np.searchsorted(ends, where + start, "right")
            inside = where + start + 3 <= ends[text]
            held[codes[where[inside]].astype(np.int64) - 1, text[inside]] = True
        return held

    def candidates(self, held: np.ndarray) -> list[np.ndarray]:
        """For each rule the texts that satisfy its query."""
        out = []
        for q in self.queries:
            fine = np.ones(held.shape[1], bool)
            for clause in q:
                fine &= np.logical_or.reduce([np.logical_and.reduce(held[[self.at[t] for t in alt]]) for alt in clause])
            out.append(np.flatnonzero(fine))
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each text (rule, start, end) in code points, by start, then rule."""
        raw = texts.to_pylist()
        lengths = np.fromiter((len(x.encode()) for x in raw), np.int64, len(raw))
        data = np.frombuffer("".join(raw).encode(), np.uint8)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        for k, (rule, found) in enumerate(zip(self.rules, self.candidates(self.postings(data, np.cumsum(lengths))))):
            for i in found.tolist():
                for m in self.compiled[k].finditer(raw[i]):
                    if len(m[rule.group]) >= rule.least:
                        spans[i].append((m.start(), k, m.end()))
        return [[(k, a, b) for a, k, b in sorted(x)] for x in spans]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col`` and ``spans``, an array of (kind, start, end) by start, then by the rules' order."""
    kind = dict(df.dtypes)[id_col]

    def make():
        s = scanner(rules)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"kind": rules[k].kind, "start": a, "end": e} for k, a, e in x] for x in s.scan(b.column("text"))]
            made = pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([b.column("id"), made], names=[id_col, "spans"])

        return f

    return per_batch(with_text(df, text_col, (id_col, "id")), make, f"`{id_col}` {kind}, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[{kind}]") -> DataFrame:
    """All columns and rows of ``df``, with ``mark`` in place of each secret; overlapping spans merge into one.

    ``length_col``: a column that holds the text's code points, set anew where the text changed.
    Null texts stay null.
    """
    columns = df.columns

    def make():
        s = scanner(rules)

        def clean(text: str, found: list[tuple[int, int, int]]) -> str:
            out, at = [], 0
            for k, a, e in found:
                if a >= at:
                    out += [text[at:a], mark.format(kind=rules[k].kind)]
                at = max(at, e)
            return "".join([*out, text[at:]])

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(text_col)
            raw = texts.to_pylist()
            found = s.scan(pa.array([x or "" for x in raw], pa.string()))
            new = [clean(x, y) if y else x for x, y in zip(raw, found)]
            cols = []
            for name in columns:
                old = b.column(name)
                if name == text_col:
                    old = pa.array(new, old.type)
                elif name == length_col:
                    old = pa.array([len(x) if y else v for x, y, v in zip(new, found, old.to_pylist())], old.type)
                cols.append(old)
            return pa.RecordBatch.from_arrays(cols, names=columns)

        return f

    return per_batch(df, make, df.schema)


def digests(spans: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds and the joined spans, as one row for each row of ``find_secrets``."""
    base = [r.kind for r in BASE_RULES]
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    only = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("spans", lambda x: x["kind"].isin(base))
    return spans.select(id_col, *map(only, base), F.sha2(said(of_base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The same digests in DuckDB SQL: starts follow from the pieces between a pattern's matches."""
    parts = []
    for k, r in enumerate(RULES):
        pat = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key") if r.flags & re.IGNORECASE else ""
        pat = f"({pat})" + r.pattern.split(")", 1)[1] if pat else r.pattern
        pat = pat.replace("'", "''")
        parts.append(f"""select doc_id, {k} as k, '{r.kind}' as kind,
          list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s, length(m[i]) as n, length(g[i]) as gn
        from (select doc_id, m, g, p, unnest(range(1, len(m) + 1)) as i from (
          select doc_id, regexp_extract_all(t, '{pat}') as m, regexp_extract_all(t, '{pat}', {r.group}) as g, regexp_split_to_array(t, '{pat}') as p from d))
        where length(g[i]) >= {r.least}""")
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE_RULES)
    line = "kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), f as ({" union all ".join(parts)}),
      a as (select doc_id, {counts}, string_agg({line}, ',' order by s, k) filter (kind in ({base})) as b, string_agg({line}, ',' order by s, k) as spans from f group by doc_id)
      select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""
