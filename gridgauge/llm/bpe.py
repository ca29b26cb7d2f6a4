"""Byte-level BPE by speculation and verification.

Every distinct word is first cut greedily into the longest vocabulary tokens.  A cut is the merge
procedure's own result exactly when each token and each adjacent pair of tokens is, taken alone, left
as it is by the merges.  That test runs over all proposed pairs of a batch at once, against sorted
arrays of known pairs; only words with a failing pair go through the exact merging.

Cases: null text is the empty text and has no tokens; special tokens that stand in a text keep their
ids (as the tokenizers library does by default); of merges of one rank the leftmost comes first; repeated rows
give repeated results; rows without an id are kept; other columns, whatever their names, are never read; an
empty table gives an empty result.  Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridgauge.llm.common import kept, per_batch, with_text

# Code point ranges that the regex package's Unicode data has as letters and numbers and the tokenizers
# library's (Unicode 16) hasn't.
LATER = "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
# Fixed value: the byte-level pre-tokenisation pattern of the public vocabulary; {L} and {N} are letters and numbers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\p{White_Space}{L}{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bytes of a word up to which words are merged a round at a time; longer ones have a heap.  What stands for no merge.
SHORT, NONE = 64, 1 << 62
#: Places of the hash table of merges, a power of two, several times their number.
SLOTS = 1 << 19
#: Factor of the rolling hashes.
ROLL = np.uint64(0x100000001B3)
#: Characters of text whose new words are learnt together.
BLOCK = 2_000_000

OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def patterns() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """The pattern as it is, what finds a character added after Unicode 16, and the pattern for texts with one.

    The regex package may know a later Unicode version than the tokenizers library, to which such
    characters are neither letters nor numbers.
    """
    later = "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (x.split("-") for x in LATER.split()))
    plain = PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")
    older = PATTERN.replace("[{L}]", rf"[\p{{L}}--[{later}]]").replace("[{N}]", rf"[\p{{N}}--[{later}]]").replace(r"[^\p{White_Space}{L}{N}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{later}]]")
    return regex.compile(plain), regex.compile(f"[{later}]"), regex.compile(older, regex.V1)


def hashed(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Vocabulary:
    """Tokens as bytes, merge ranks by pair of ids, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        chars = byte_chars()
        to_bytes = lambda token: bytes(chars[c] for c in token)
        self.ids = {to_bytes(token): i for token, i in said["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.single = [self.ids[bytes([k])] for k in range(256)]
        self.single_ = np.array(self.single, np.int64)
        self.longest = max(map(len, self.ids))
        self.merges: dict[int, int] = {}  # pair of ids to rank and merged id, each pair in one number
        for rank, merge in enumerate(said["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = to_bytes(left), to_bytes(right)
            self.merges.setdefault(self.ids[a] << 32 | self.ids[b], rank << 32 | self.ids[a + b])
        self.keys, self.values = np.full(SLOTS, -1), np.zeros(SLOTS, np.int64)
        for code, slot in zip(self.merges, hashed(np.fromiter(self.merges, np.int64, len(self.merges))).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (SLOTS - 1)
            self.keys[slot], self.values[slot] = code, self.merges[code]
        self.token_hashes, self.token_ids = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1)
        for token, i in self.ids.items():
            if len(token) <= SHORT:
                h = 0
                for x in token:
                    h = h * int(ROLL) + x + 1 & 0xFFFFFFFFFFFFFFFF
                slot = int(hashed(np.array([h], np.uint64))[0])
                while self.token_ids[slot] >= 0:
                    slot = (slot + 1) & (SLOTS - 1)
                self.token_hashes[slot], self.token_ids[slot] = h, i
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def propose(self, words: list[bytes]) -> list[list[int]]:
        """``greedy`` of each word, all words at once: the longest token at each byte by rolling hashes, then the way through.

        What the hashes find is held against the words' own bytes; should one differ, all are cut one by one.
        """
        short = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT]
        out = [[] if 0 < len(w) <= SHORT else self.greedy(w) for w in words]
        raw = b"".join([words[k] for k in short])
        data = np.frombuffer(raw, np.uint8)
        n = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
        end = np.repeat(np.cumsum(n), n)
        longest, token = np.ones(len(data), np.int64), self.single_[data]
        at, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        for size in range(1, int(n.max(initial=0)) + 1):
            inside = at + size <= end[at]
            at, h = at[inside], h[inside]
            h = h * ROLL + data[at + size - 1] + np.uint64(1)
            if size > 1:
                found = self.token_of(h)
                hit = found >= 0
                longest[at[hit]], token[at[hit]] = size, found[hit]
        word, place, parts = np.arange(len(short)), np.cumsum(n) - n, []
        while len(word):
            parts.append((word, token[place]))
            place = place + longest[place]
            on = place < np.cumsum(n)[word]
            word, place = word[on], place[on]
        if not parts:
            return out
        of, flat = np.concatenate([w for w, _ in parts]), np.concatenate([t for _, t in parts])
        order = np.argsort(of, kind="stable")
        flat = flat[order]
        if self.decode(flat) != raw:
            return [self.greedy(w) for w in words]
        ends = np.cumsum(np.bincount(of, minlength=len(short))).tolist()
        ids, start = flat.tolist(), 0
        for k, stop in zip(short, ends):
            out[k] = ids[start:stop]
            start = stop
        return out

    def token_of(self, h: np.ndarray) -> np.ndarray:
        """The token with each rolling hash, -1 for none."""
        out, todo = np.full(len(h), -1), np.arange(len(h))
        slot = hashed(h)
        while len(todo):
            held = self.token_ids[slot]
            hit = (held >= 0) & (self.token_hashes[slot] == h[todo])
            out[todo[hit]] = held[hit]
            on = (held >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def rank(self, code: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair of ids, ``NONE`` without a merge; by a hash table with linear probing."""
        out, todo = np.full(len(code), NONE), np.arange(len(code))
        slot = hashed(code)
        while len(todo):
            key = self.keys[slot]
            hit = key == code[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (key >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def exact(self, words: list[bytes]) -> list[list[int]]:
        """For each word: merge the pair of the lowest rank, from the left, until none is left; all words a round at a time."""
        out: list[list[int]] = [self.exact_long([self.single[x] for x in w]) if len(w) > SHORT else [] for w in words]
        short = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT]
        ids = self.single_[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        n = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
        word, who = np.repeat(np.arange(len(short)), n), np.array(short, np.int64)
        while len(ids):
            pair = np.full(len(ids), NONE)
            inside = np.flatnonzero(word[:-1] == word[1:])
            pair[inside] = self.rank(ids[inside] << 32 | ids[inside + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(pair, first)
            size = np.diff(np.append(first, len(ids)))
            done = best == NONE
            if done.any():
                ended = np.repeat(done, size)
                parts = np.split(ids[ended], np.cumsum(size[done])[:-1])
                for k, part in zip(who[word[first[done]]].tolist(), parts):
                    out[k] = part.tolist()
                ids, word, pair = ids[~ended], word[~ended], pair[~ended]
                best, size = best[~done], size[~done]
                if not len(ids):
                    break
            hit = pair == np.repeat(best, size)
            # Of hits in a row, which share a token, every second one counts.
            at = np.flatnonzero(hit)
            begins = np.concatenate(([True], np.diff(at) > 1))
            at = at[(at - np.repeat(at[begins], np.diff(np.append(np.flatnonzero(begins), len(at))))) % 2 == 0]
            ids[at] = pair[at] & 0xFFFFFFFF
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            ids, word = ids[left], word[left]
        return out

    def exact_long(self, ids: list[int]) -> list[int]:
        """The same in near-linear time, with a heap of the pairs."""
        n, get = len(ids), self.merges.get
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get(ids[k] << 32 | ids[k + 1])) is not None]
        # Equal ranks are equal pairs, so order is by rank, then place.
        heapq.heapify(heap)
        while heap:
            m, k, a, b = heapq.heappop(heap)
            r = after[k]
            if not alive[k] or r < 0 or ids[k] != a or ids[r] != b:
                continue
            ids[k], alive[r], after[k] = m & 0xFFFFFFFF, False, after[r]
            if after[r] >= 0:
                before[after[r]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) >= 0 and (m := get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[right]))
        return [ids[k] for k in range(n) if alive[k]]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered in one vectorised pass."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        return self.bytes[np.arange(total) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Speculative encoder with bounded memories of words and of checked pairs."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 300_000, most_pairs: int = 1_000_000):
        self.v, self.most_words, self.most_pairs = vocabulary, most_words, most_pairs
        self.plain, self.later, self.older = patterns()
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        self.codes = np.zeros(0, np.int64)
        self.fine = np.zeros(0, bool)
        self.proposed = self.failed = 0
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.said: list[str] = []
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.add([*self.v.special], [[i] for i in self.v.special.values()])

    def add(self, words: list[str], ids: list[list[int]]) -> None:
        for w in words:
            self.words[w] = len(self.words)
        self.said += [",".join(map(str, x)) for x in ids]
        n = np.array([len(x) for x in ids], np.int64)
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(n) - n))
        self.count = np.concatenate((self.count, n))
        self.flat = np.concatenate((self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave token ``a`` followed by ``b`` as it is; ``b`` of -1: token ``a`` alone."""
        asked, back = np.unique(a.astype(np.int64) * (1 << 32) + b + 1, return_inverse=True)
        at = np.searchsorted(self.codes, asked)
        at_ = np.minimum(at, max(len(self.codes) - 1, 0))
        known = (self.codes[at_] == asked) if len(self.codes) else np.zeros(len(asked), bool)
        if not known.all():
            new = asked[~known]
            tokens = self.v.tokens
            want = [[x >> 32] if not x & 0xFFFFFFFF else [x >> 32, (x & 0xFFFFFFFF) - 1] for x in new.tolist()]
            said = [got == x for got, x in zip(self.v.exact([b"".join([tokens[k] for k in x]) for x in want]), want)]
            if len(self.codes) + len(new) > self.most_pairs:
                fine = np.empty(len(asked), bool)
                fine[known] = self.fine[at_[known]]
                fine[~known] = said
                self.codes, self.fine = asked, fine
            else:
                codes, fine = np.concatenate((self.codes, new)), np.concatenate((self.fine, np.array(said, bool)))
                order = np.argsort(codes)
                self.codes, self.fine = codes[order], fine[order]
            at_ = np.searchsorted(self.codes, asked)
        return self.fine[at_][back]

    def learn(self, words: Iterable[str]) -> None:
        """Speculate on words not seen before, verify all their pairs at once, merge the failing ones exactly."""
        if not (words := list(words)):
            return
        raw = [w.encode() for w in words]
        ids = self.v.propose(raw)
        n = np.array([len(x) for x in ids])
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(ids)), n)
        nxt = np.append(flat[1:], -1)
        nxt[np.append(of[1:] != of[:-1], True)] = -1
        single = (nxt == -1) & (n[of] > 1)  # a last token was tested with the one before
        fine = np.ones(len(flat), bool)
        fine[~single] = self.compatible(flat[~single], nxt[~single])
        failing = np.unique(of[~fine])
        for k, merged in zip(failing.tolist(), self.v.exact([raw[k] for k in failing.tolist()])):
            ids[k] = merged
        self.proposed, self.failed = self.proposed + len(ids), self.failed + len(failing)
        self.add(words, ids)

    def find(self, text: str) -> list[str]:
        return (self.plain if latin(text) or not self.later.search(text) else self.older).findall(text)

    def cut(self, text: str) -> list[str]:
        if self.split is None or not any(x in text for x in self.v.special):
            return self.find(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.find(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.find(text[at:])

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a whole text, as an array and as comma-separated text."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """``encode`` of each text; new words are learnt once for a block of texts."""
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and (not block or size + len(texts[at]) <= BLOCK):
                block.append(self.cut(texts[at]))
                size += len(texts[at])
                at += 1
            every = set().union(*block)
            if new := every.difference(self.words):
                if len(self.words) + len(new) > self.most_words:
                    self.forget()
                    new = every.difference(self.words)
                self.learn(new)
            for words in block:
                yield self.spell(words)

    def spell(self, words: list[str]) -> tuple[np.ndarray, str]:
        if not words:
            return np.zeros(0, np.int32), ""
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        n = self.count[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.first[at] - (ends - n), n)]
        return ids, ",".join(map(self.said.__getitem__, at.tolist()))


def encoder(path: str) -> Encoder:
    return kept(("bpe", path), lambda: Encoder(Vocabulary(path)))


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode each text, decode the ids again, and return ``id_col`` with the chosen ``OUTPUTS``.

    One pass over the rows without a shuffle; a task holds one Arrow batch and the bounded word memory.
    ``path``: the vocabulary file, the same on every machine.
    """
    path = path or default_path()
    kind = dict(df.dtypes)[id_col]
    outputs = tuple(outputs)

    def make():
        e = encoder(path)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            got: dict[str, list] = {k: [] for k in outputs}
            for ids, said in e.encode_all(b.column("text").to_pylist()):
                raw = e.v.decode(ids) if any(k.startswith("decoded") for k in outputs) else b""
                decoded = raw.decode("utf-8", "replace")
                if "n_tokens" in got:
                    got["n_tokens"].append(len(ids))
                if "ids" in got:
                    got["ids"].append(ids)
                if "decoded" in got:
                    got["decoded"].append(decoded)
                if "ids_sha256" in got:
                    got["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                if "decoded_sha256" in got:
                    got["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            cols = [pa.array(v, types.get(k, pa.string())) for k, v in got.items()]
            return pa.RecordBatch.from_arrays([b.column("id"), *cols], names=[id_col, *outputs])

        return f

    schema = ", ".join([f"`{id_col}` {kind}", *(f"{k} {OUTPUTS[k]}" for k in outputs)])
    return per_batch(with_text(df, text_col, (id_col, "id")), make, schema)
