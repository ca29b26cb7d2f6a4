"""Fill-in-middle transformation of texts.

A text is cut into prefix, middle and suffix at two token ranks that its id decides, and written in the order
prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``), each part behind its mark; or left as it is
(``plain``).  A token is white space with the word behind it, or white space at the end of a text.

The bytes of a batch of texts are taken apart into chunks that overlap by one byte.  A token starts where a text
starts or where white space follows other bytes, so two adjacent bytes decide, and the starts of all chunks are
counted at once.  Prefix sums over the counts say which chunk holds a cut's rank, and only these chunks are scanned
again for the cut's place.  Nothing is shuffled; a long text is many chunks of one task's batch.

Cases: null text is empty; an empty text is plain, with no tokens; a null id is hashed as an empty one; repeated
rows come out alike; a text that holds one of the marks is plain, so that the marks of an output part it safely;
other columns, whatever their names, are never read; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import per_batch, with_text

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk; chunks that are counted at once.
CHUNK, AT_ONCE = 4096, 1024

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


class Chunks:
    """Token starts and code points of each chunk of the texts ``data[ends[k]:ends[k + 1]]``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.ends = data, ends
        of_text = -(-np.diff(ends) // CHUNK)
        self.first = np.concatenate(([0], np.cumsum(of_text)))
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], of_text)
        self.starts = np.repeat(ends[:-1], of_text) + inside * CHUNK
        self.opens = inside == 0
        stops = np.minimum(self.starts + CHUNK, np.repeat(ends[1:], of_text))
        self.tokens, self.chars = np.zeros(len(stops) + 1, np.int64), np.zeros(len(stops) + 1, np.int64)
        for k in range(0, len(stops), AT_ONCE):
            some = slice(k, k + AT_ONCE)
            low, high, at = self.starts[k], stops[some][-1], self.starts[some]
            edges = self.edges(low, high)
            edges[at[self.opens[some]] - low] = True
            self.tokens[k + 1 : k + 1 + len(at)] = np.add.reduceat(edges, at - low, dtype=np.int64)
            self.chars[k + 1 : k + 1 + len(at)] = np.add.reduceat(self.leads(low, high), at - low, dtype=np.int64)
        self.stops, self.tokens, self.chars = stops, np.cumsum(self.tokens), np.cumsum(self.chars)

    def edges(self, low: int, high: int) -> np.ndarray:
        """Whether white space begins at each byte, as the byte before it shows."""
        space = SPACE[self.data[max(low - 1, 0) : high]]
        if low == 0:
            space = np.concatenate(([True], space))
        return space[1:] & ~space[:-1]

    def leads(self, low: int, high: int) -> np.ndarray:
        return (self.data[low:high] & 0xC0) != 0x80

    def n_tokens(self) -> np.ndarray:
        return self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """Byte in ``data`` and code point in the text where its token ``rank`` starts; the text's end behind the last token."""
        a, b = self.first[text], self.first[text + 1]
        rank += self.tokens[a]
        if rank >= self.tokens[b]:
            return int(self.ends[text + 1]), int(self.chars[b] - self.chars[a])
        k = int(np.searchsorted(self.tokens, rank, "right")) - 1
        low = int(self.starts[k])
        edges = self.edges(low, int(self.stops[k]))
        edges[0] |= self.opens[k]
        off = int(np.flatnonzero(edges)[rank - self.tokens[k]])
        return low + off, int(self.chars[k] - self.chars[a] + np.count_nonzero(self.leads(low, low + off)))


def ranks(id_col: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the digest of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def infill(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``id_col``, ``n`` tokens, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``.

    ``percent`` of the texts are cut; ``spm_percent`` of those start with the suffix.
    """
    kind = dict(df.dtypes)[id_col]
    one, two, three, four = ranks(F.col("id"), seed)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | (three % 100 >= percent) | marked
    form = F.when(plain, "plain").when(four % 100 < spm_percent, "spm").otherwise("psm")
    rows = with_text(df, text_col, (id_col, "id")).select("id", "text", one.alias("one"), two.alias("two"), form.alias("form"))

    def make():
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text")
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            whole = texts.buffers()[2]
            data = np.frombuffer(whole, np.uint8)[ends[0] : ends[-1]] if whole else np.zeros(0, np.uint8)
            ends -= ends[0]
            chunks = Chunks(data, ends)
            n, out, sizes = chunks.n_tokens().tolist(), [], []
            for k, (form, one, two) in enumerate(zip(*(b.column(c).to_pylist() for c in ("form", "one", "two")))):
                a, d = int(ends[k]), int(ends[k + 1])
                if form == "plain":
                    out.append(data[a:d].tobytes())
                    sizes.append((None, None))
                    continue
                (low, before), (high, upto) = (chunks.place(k, x) for x in sorted((one % (n[k] + 1), two % (n[k] + 1))))
                parts = data[a:low].tobytes(), data[low:high].tobytes(), data[high:d].tobytes()
                out.append(b"".join((p, parts[0], s, parts[2], m, parts[1]) if form == "psm" else (s, parts[2], p, parts[0], m, parts[1])))
                sizes.append((before, upto - before))
            cols = [b.column("id"), pa.array(n, pa.int64()), b.column("form"), *(pa.array(x, pa.int64()) for x in zip(*sizes)), pa.array(out, pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

        return f

    return per_batch(rows, make, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    part = lambda k: F.element_at(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``infill`` with the digests of the outputs and of the texts rebuilt from them."""
    kept = [id_col, "n", "form", "prefix_chars", "middle_chars"]
    return made.select(*kept, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle() -> str:
    """The same rows in DuckDB SQL: tokens as a list."""
    group = lambda k: f"cast('0x' || substr(s, {8 * k + 1}, 8) as bigint)"
    return rf"""with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
      w as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as k, {", ".join(f"{group(k)} as h{k + 1}" for k in range(4))} from d),
      c as (select *, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) as lo, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) as hi,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from w),
      p as (select *, array_to_string(k[1:lo], '') as a, array_to_string(k[lo + 1:hi], '') as m, array_to_string(k[hi + 1:len(k)], '') as z from c)
      select doc_id, cast(len(k) as bigint) as n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || a || '<M>' || m end) as output_sha256,
        sha256(case form when 'plain' then t else a || m || z end) as restored_sha256 from p"""
