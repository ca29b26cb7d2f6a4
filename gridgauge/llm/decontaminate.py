"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block maxima.

Documents are cut into overlapping passages, and every passage queries the index.  An item's score is
divided by the score of the item's own text, so 1 is the most any passage can reach and one threshold
holds for all items.  Terms split into essential ones, which are rare, and the others, whose whole
weight in an item, ``rest``, stays below half of the threshold.  Items lie in blocks; each essential
posting knows its block's maximum.  A passage has a pivot only if its terms' largest weights anywhere
plus the largest ``rest`` reach the threshold; without one it is left before any posting is read.  A (passage,
block) pair is skipped if the block maxima of the passage's essential terms plus the block's largest
``rest`` stay below the threshold; then a (passage, item) pair by its own bound; what is left is scored
exactly.  No hit is lost: all three are upper bounds of the score.  ``Index.work`` counts what each step left.
Hits are verified by the shares of the question's and of the answer's word n-grams that stand in the
passage: each has to reach the bound, so a question alone is none.

Cases: null texts are empty; an empty document or item has no hits; an item of one part is verified by that
one; items of equal text all hit, so there are no ties to break; repeated rows give repeated hits before
``distinct``; other columns, whatever their names, are never read; empty tables give an empty result; texts
are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import drop_written, per_batch, with_text, words, written

K1, B = 1.2, 0.75
#: Items of one block; bytes of item text in one broadcast index, at most: larger benchmarks are searched in parts.
BLOCK, INDEX_BYTES = 8, 16_000_000
#: Items whose n-grams a task remembers.
MADE = 4096
#: Words of a passage, at least; passages overlap by half and are twice as long as the longest item.
PASSAGE = 128
GRAM = 5


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: split after the last question mark, else before the last sentence."""
    at = text.rfind("?") + 1
    if not at:
        ends = [m.end() for m in re.finditer(r"[.!]\s+(?=\S)", text)]
        at = ends[-1] if ends else len(text)
    return words(text[:at]), words(text[at:])


def grams(part: list[bytes], n: int) -> set[bytes]:
    n = min(n, len(part))
    return {b" ".join(part[k : k + n]) for k in range(len(part) - n + 1)} if n else set()


class Index:
    """One part of the benchmark, as arrays.  ``df``: items of the whole benchmark with a term; ``count``: items; ``mean``: words of an item.

    Items keep their text; their n-grams are made when a passage reaches one.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], count: int, mean: float, threshold: float):
        self.ids, self.texts, self.threshold = [i for i, _ in items], [t for _, t in items], threshold
        numbers: dict[bytes, int] = {}
        said: list[np.ndarray] = []
        for text in self.texts:
            q, a = question_answer(text)
            said.append(np.array([numbers.setdefault(w, len(numbers)) for w in q + a], np.int32))
        n, n_terms = np.array([len(x) for x in said], np.int64), len(numbers)
        self.stride = max(PASSAGE // 2, int(n.max(initial=0)))
        self.held: dict[bytes, int] = numbers
        # Weights of an item's terms, by item, then term.
        pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) * n_terms + np.concatenate([*said, np.zeros(0, np.int32)]), return_counts=True)
        item, term = pairs // max(n_terms, 1), pairs % max(n_terms, 1)
        often = np.array([df[w] for w in numbers], float)
        weight = np.log(1 + (count - often + 0.5) / (often + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / mean))
        weight /= np.bincount(item, weight, len(n))[item] if len(item) else 1
        self.item_first = np.searchsorted(item, np.arange(len(n) + 1))
        self.item_term, self.item_weight = term.astype(np.int32), weight
        # The rarest terms of an item become essential until the rest weighs little.
        order = np.lexsort((term, often[term], item))
        upto = np.cumsum(weight[order])
        start = np.concatenate(([0.0], upto))[self.item_first[item[order]]]
        taken = 1 - (upto - weight[order] - start) >= threshold / 2
        self.essential = np.zeros(n_terms, bool)
        self.essential[term[order][taken]] = True
        ours = self.essential[term]
        self.rest = np.bincount(item[~ours], weight[~ours], len(n))
        block = np.arange(len(n)) // BLOCK
        self.block_rest = np.maximum.reduceat(self.rest, np.flatnonzero(np.diff(block, prepend=-1))) if len(n) else np.zeros(0)
        # Postings of essential terms, by term, then item, and the maxima of their blocks.
        order = np.lexsort((item[ours], term[ours]))
        of_term = term[ours][order]
        self.item, self.weight = item[ours][order].astype(np.int32), weight[ours][order]
        self.first = np.searchsorted(of_term, np.arange(n_terms + 1))
        opens = np.flatnonzero(np.diff(of_term, prepend=-1) | np.diff(self.item // BLOCK, prepend=-1))
        self.block = self.item[opens] // BLOCK
        self.block_most = np.maximum.reduceat(self.weight, opens) if len(opens) else np.zeros(0)
        self.block_first = np.searchsorted(of_term[opens], np.arange(n_terms + 1))
        self.term_most = np.zeros(n_terms)
        np.maximum.at(self.term_most, of_term, self.weight)
        self.most_rest = self.rest.max(initial=0.0)
        self.work = {"passages": 0, "pivots": 0, "blocks": 0, "open_blocks": 0, "items": 0, "scored": 0}
        self.made: dict[int, tuple] = {}

    def __getstate__(self):
        """Terms travel as one string: none of them has a blank."""
        return self.__dict__ | {"held": b" ".join(self.held), "made": {}}

    def __setstate__(self, state):
        held = state["held"].split(b" ") if state["held"] else []
        self.__dict__.update(state | {"held": dict(zip(held, range(len(held))))})

    def parts(self, i: int) -> tuple:
        """Words of the question and of the answer of an item, and the n-grams of each."""
        got = self.made.get(i)
        if got is None:
            if len(self.made) >= MADE:
                self.made.clear()
            own = question_answer(self.texts[i])
            got = self.made[i] = (own, [grams(x, GRAM) for x in own])
        return got

    @staticmethod
    def spread(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term all places in its postings: (index into ``terms``, place)."""
        n = first[terms + 1] - first[terms]
        ends = np.cumsum(n)
        of = np.repeat(np.arange(len(terms)), n)
        return of, np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(first[terms] - (ends - n), n)

    def search(self, texts: list[str], verify: float) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question share, answer share) of all hits, of each pair the best passage."""
        get, n_terms, cells, terms = self.held.get, len(self.held), [], []
        cut: list[list[bytes]] = []
        base, owners, starts = 0, [], []
        for k, text in enumerate(texts):
            w = words(text)
            cut.append(w)
            got = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
            at = np.flatnonzero(got >= 0)
            at = at[self.essential[got[at]]]
            cells.append(at // self.stride + base)
            terms.append(got[at])
            n = max(1, -(-len(w) // self.stride))
            owners += [k] * n
            starts += range(0, n * self.stride, self.stride)
            base += n
        if not len(self.ids) or not base:
            return []
        cell, term = np.concatenate(cells), np.concatenate(terms)
        # Passage c is cell c and the next one of the same text; each pair of passage and term counts once.
        owners_ = np.array(owners)
        earlier = np.maximum(cell - 1, 0)
        both = (cell > 0) & (owners_[earlier] == owners_[cell])
        pairs = np.unique(np.concatenate((cell, earlier[both])) * n_terms + np.concatenate((term, term[both])))
        passage, term = pairs // max(n_terms, 1), pairs % max(n_terms, 1)
        # Passages with a pivot.
        reach = np.bincount(passage, self.term_most[term], base) + self.most_rest >= self.threshold
        used = reach[passage]
        passage, term = passage[used], term[used]
        # Bound by blocks.
        n_blocks = len(self.block_rest)
        of, at = self.spread(self.block_first, term)
        keys, back = np.unique(passage[of] * n_blocks + self.block[at], return_inverse=True)
        bound = np.bincount(back, self.block_most[at], len(keys)) + self.block_rest[keys % n_blocks]
        open_ = keys[bound >= self.threshold]
        # Bound by items of the open blocks.
        used = np.isin(passage, np.unique(open_ // n_blocks))
        passage, term = passage[used], term[used]
        of, at = self.spread(self.first, term)
        place = passage[of] * n_blocks + self.item[at] // BLOCK
        used = np.isin(place, open_)
        of, at = of[used], at[used]
        keys, back = np.unique(passage[of] * len(self.ids) + self.item[at], return_inverse=True)
        bound = np.bincount(back, self.weight[at], len(keys)) + self.rest[keys % len(self.ids)]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        left = keys[bound >= self.threshold].tolist()
        for k, x in zip(self.work, (base, int(reach.sum()), len(self.block[self.spread(self.block_first, term)[1]]), len(open_), len(keys), len(left))):
            self.work[k] += x
        for key in left:
            p, i = divmod(key, len(self.ids))
            k = owners[p]
            part = cut[k][starts[p] : starts[p] + 2 * self.stride]
            held = {get(x, -1) for x in part}
            own = slice(self.item_first[i], self.item_first[i + 1])
            score = sum(v for t, v in zip(self.item_term[own].tolist(), self.item_weight[own].tolist()) if t in held)
            if score < self.threshold:
                continue
            shares, found = [], True
            have: dict[int, set[bytes]] = {}
            for own, g in zip(*self.parts(i)):
                n = min(GRAM, len(own))
                if n not in have:
                    have[n] = grams(part, n)
                hits = len(g & have[n])
                shares.append(hits / len(g) if g else 1.0)
                found &= hits >= verify * len(g)
            if found:
                best[k, i] = max(best.get((k, i), (0.0, 0.0, 0.0)), (score, *shares))
        return [(k, i, *x) for (k, i), x in best.items()]


def indexes(benchmark: DataFrame, item_col: str, item_text_col: str, threshold: float) -> Iterator[Index]:
    """The benchmark as indexes of at most ``INDEX_BYTES`` of item text, about; statistics are those of all items."""
    kind = dict(benchmark.dtypes)[item_col]

    def tokens(b: pa.RecordBatch) -> pa.RecordBatch:
        said = [words(x) for x in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("item"), b.column("text"), pa.array([sorted({w.decode() for w in x}) for x in said], pa.list_(pa.string())), pa.array(map(len, said), pa.int64())], names=["item", "text", "terms", "n"])

    items, path = written(per_batch(with_text(benchmark.where(F.col(item_col).isNotNull()), item_text_col, (item_col, "item")), lambda: tokens, f"item {kind}, text string, terms array<string>, n long").where("n > 0"))
    count, mean, size = items.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_parts = max(1, -(-size // INDEX_BYTES))
    part_of = F.pmod(F.xxhash64("item", "text"), F.lit(n_parts))
    df_of = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for k in range(n_parts):
        own = items.where(part_of == k)
        rows = own.select("item", "text").orderBy("item", "text").collect()
        rare = df_of.join(own.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").collect()
        yield Index([(r.item, r.text) for r in rows], {r.term.encode(): r.df for r in rare}, count, mean, threshold)
    drop_written(benchmark.sparkSession, path)


def searched(held: Index, texts: list[str], verify: float) -> Iterator[tuple]:
    """Hits of ``Index.search``, a few texts at a time."""
    for start in range(0, len(texts), 256):
        for k, *x in held.search(texts[start : start + 256], verify):
            yield (start + k, *x)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, verify: float = 0.5) -> DataFrame:
    """(``id_col``, ``item_col``, score, question_overlap, answer_overlap) of all documents that hold test items.

    ``threshold``: share of an item's own BM25 score; ``verify``: share of its question's and of its answer's n-grams.  The index is sent
    to every task in parts of at most ``INDEX_BYTES`` of item text; each part reads the documents once.
    """
    kinds = dict(df.dtypes) | {"item": dict(benchmark.dtypes)[item_col]}
    docs = with_text(df, text_col, (id_col, "id"))
    schema = f"`{id_col}` {kinds[id_col]}, `{item_col}` {kinds['item']}, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(benchmark, item_col, item_text_col, threshold):
        sent = df.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            held = sent.value

            def f(b: pa.RecordBatch) -> pa.RecordBatch:
                ids = b.column("id")
                hits = [(k, held.ids[i], *x) for k, i, *x in searched(held, b.column("text").to_pylist(), verify)]
                cols = list(zip(*hits)) or [[]] * 5
                return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c) if c else pa.array([], t) for c, t in zip(cols[1:], (pa.int64(), *[pa.float64()] * 3)))], names=[id_col, item_col, "score", "question_overlap", "answer_overlap"])

            return f

        found = per_batch(docs, make, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, verify: float = 0.5) -> DataFrame:
    """Rows of ``df``, all columns, whose text holds no test item; one pass a part of the benchmark, without a shuffle."""
    for index in indexes(benchmark, item_col, item_text_col, threshold):
        sent = df.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            held = sent.value

            def f(b: pa.RecordBatch) -> pa.RecordBatch:
                hit = {k for k, *_ in searched(held, [x or "" for x in b.column(text_col).to_pylist()], verify)}
                return b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_()))

            return f

        df = per_batch(df, make, df.schema)
    return df
