"""Personal data: four exact patterns, and spans that a linear-chain conditional random field adds.

The field runs over the words of a text.  A word counts by its shape (digits, upper and lower case, marks), its number
of digits, what trails it, and by itself if the labelled table has it often; so do the words beside it.  Weights and
the transitions between tags are fitted on the driver to a small labelled table (``SENTENCES`` rows at most), by
forward and backward sums.  ``labelled`` makes such a table by rule; another of its columns may be given.

Decoding is Viterbi's, in numpy, over all stretches of a batch at once.  A word whose tag "none" leads by more than any
change of its two transitions can outweigh has that tag on the best path, whatever stands beside it, so paths are
sought only between such words; the result is that of whole texts.  Added spans that overlap one of the patterns' are
left out.

Cases: null text is empty and holds nothing; repeated rows come out alike; rows without an id are kept; spans of one
start are ordered as the kinds are listed; of equally good paths the one with the tag listed first is taken; without
labelled sentences only the patterns count; other columns, whatever their names, are never read; an empty table gives
an empty result; texts are read whole, in time that grows with their length.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgauge.llm.common import per_batch, with_text

BASE = ("email", "ip", "card", "phone")
#: Tags of the field; the first is none, the last is a name's words behind its first.
TAGS = ("", "mail", "addr", "account", "tel", "ssn", "iban", "name", "name+")
KINDS = BASE + TAGS[1:-1]
#: Labelled sentences, at most; words of which the tags are kept at once; distinct words remembered.
SENTENCES, BLOCK, MOST_WORDS = 4000, 1 << 18, 200_000
#: Sentences of like length that are summed at once in training.
GROUP = 256

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ ends one local part at most, so the characters before it are read once."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches, by start, then kind."""
    out = [(a, 0, e) for a, e in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# Words


MARKS = "\"'<>&#*$%!?;:,.="
SEEN = 48


def shape_of(core: str) -> str:
    """Letters and runs of digits by kind and about how many; other characters as they are."""
    out, k = [], 0
    while k < len(core):
        c = core[k]
        n = k
        if "0" <= c <= "9":
            while n < len(core) and "0" <= core[n] <= "9":
                n += 1
            size = n - k
            out.append("d" + (str(size) if size <= 4 else "six" if size <= 7 else "ten" if size <= 11 else "card" if size <= 19 else "more"))
        elif c.isalpha():
            while n < len(core) and core[n].isalpha():
                n += 1
            part = core[k:n]
            out.append("X" if part.isupper() else "x" if not part[0].isupper() else "Xx")
        else:
            n = k + 1
            out.append(c if c < "\x7f" else "o")
        k = n
    return "".join(out[:12])


def features_of(word: str) -> list[str]:
    start = word[:SEEN]
    core = start.strip(MARKS)
    digits = sum("0" <= c <= "9" for c in core)
    shape = shape_of(core)
    plain = re.sub(r"six|ten|card|more|\d+", "", shape)
    size = "long" if len(word) > SEEN else ""
    marks = "".join(sorted({c for c in plain if not c.isalnum()}))
    out = ["any", f"shape {shape}", f"plain {plain}", f"digits {min(digits, 20)}{size}", f"marks {marks}"]
    if core and core.isalpha():
        out.append(f"word {core.lower()}")
    elif any(c.isalpha() for c in core) and digits:
        out.append("mixed")
    if word[-1:] in MARKS:
        out.append(f"end {'stop' if word[-1] in '.,;:!?' else 'mark'}")
    return out


@dataclass(frozen=True, eq=False)
class Model:
    """Weights of a word's own features, of the word before and of the word behind: [feature, tag]; transitions [from, to]."""

    features: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray

    def slack(self) -> float:
        """What two transitions can gain at most by another tag than none between them."""
        m = self.moves
        gain = m[:, 1:, None] + m[None, 1:, :] - m[:, :1, None] - m[None, :1, :]
        return float(gain.max()) if gain.size else 0.0


class Words:
    """Emissions of words; words of the same known features are one type.  Type 0 parts texts."""

    def __init__(self, model: Model):
        self.at = {f: k for k, f in enumerate(model.features)}
        self.model, self.of_word, self.types, self.plain = model, {}, {(): 0}, {}
        self.table = np.zeros((3, 64, len(TAGS)), np.float32)

    def __call__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = text.strip(MARKS)
        key = None
        if core.isalpha() and len(text) <= SEEN and text.startswith(core):
            # All such words of one case and end that the model doesn't know by themselves have the same features.
            low = core.lower()
            own = low if f"word {low}" in self.at else None
            key = own, core.isupper(), core[0].isupper(), text[-1] if len(text) > len(core) else ""
            if (t := self.plain.get(key)) is not None:
                return self.keep(word, t)
        known = tuple(self.at[f] for f in features_of(text) if f in self.at)
        t = self.types.get(known)
        if t is None:
            t = self.types[known] = len(self.types)
            if t >= self.table.shape[1]:
                self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
            self.table[:, t] = self.model.weights[:, list(known)].sum(1)
        if key:
            self.plain[key] = t
        return self.keep(word, t)

    def keep(self, word: bytes, t: int) -> int:
        if len(self.of_word) >= MOST_WORDS:
            self.of_word.clear()
        self.of_word[word] = t
        return t

    def types_of(self, texts: list[list[bytes]]) -> np.ndarray:
        """Types of all words, with a parting type before and behind each text."""
        get, out = self.of_word.get, [0]
        for words in texts:
            for w in words:
                t = get(w)
                out.append(self(w) if t is None else t)
            out.append(0)
        return np.array(out, np.int32)

    def emissions(self, types: np.ndarray, low: int, high: int) -> np.ndarray:
        own, before, behind = self.table
        return own[types[low:high]] + before[types[low - 1 : high - 1]] + behind[types[low + 1 : high + 1]]


@lru_cache(maxsize=2)
def words_of(model: Model) -> Words:
    """Words that a worker has met in any of its tasks."""
    return Words(model)


def tags_of(words: Words, texts: list[list[bytes]]) -> np.ndarray:
    """Best tag of every word and of the places between texts (0), as ``types_of`` lists them."""
    types = words.types_of(texts)
    slack = words.model.slack() + 1e-3
    places, kept = [np.zeros(0, np.int64)], [np.zeros((0, len(TAGS)), np.float32)]
    for low in range(1, len(types) - 1, BLOCK):
        high = min(low + BLOCK, len(types) - 1)
        e = words.emissions(types, low, high)
        open_ = np.flatnonzero((e[:, 0] - e[:, 1:].max(1) <= slack) & (types[low:high] != 0))
        places.append(open_ + low)
        kept.append(e[open_])
    out = np.zeros(len(types), np.int8)
    at = np.concatenate(places)
    if len(at):
        out[at] = viterbi(at, np.concatenate(kept), words.model.moves)
    return out


def viterbi(at: np.ndarray, e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of the stretches of places ``at`` without a gap, with tag 0 before and behind each; all stretches at once."""
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    size = np.diff(first, append=len(at))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best = moves[0] + e[first]
    came = np.zeros(e.shape, np.int8)
    longer = np.searchsorted(-size, -np.arange(size[0]), "left").tolist()  # stretches of more than so many places
    for t in range(1, size[0]):
        n = longer[t]
        ways = best[:n, :, None] + moves
        came[first[:n] + t] = ways.argmax(1)
        best[:n] = ways.max(1) + e[first[:n] + t]
    tag, out = (best + moves[:, 0]).argmax(1), np.zeros(len(at), np.int8)
    for t in range(size[0] - 1, -1, -1):
        n = longer[t]
        # Stretches of exactly t + 1 places end here with the tag they have.
        out[first[:n] + t] = tag[:n]
        if t:
            tag[:n] = came[first[:n] + t, tag[:n]]
    return out


# Training


def fit(sentences: list[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.1, ridge: float = 2e-3, least: int = 5) -> Model:
    """Weights that maximise the likelihood of the tags, with a ridge; a word itself is a feature if ``least`` sentences have it."""
    sentences = [(w, t) for w, t in sentences if w and len(w) == len(t)]
    seen = Counter(f for w, _ in sentences for f in {f for x in w for f in features_of(x)})
    features = tuple(sorted(f for f, n in seen.items() if n >= (least if f.startswith("word ") else 2)))
    weights, moves = np.zeros((3, len(features), len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
    if not features:
        weights[0, :, 0] = 1
        return Model(features, weights.astype(np.float32), moves.astype(np.float32))
    number, place = {f: k for k, f in enumerate(features)}, {t: k for k, t in enumerate(TAGS)}
    kinds: dict[tuple[int, ...], int] = {(): 0}
    sentences = sorted(sentences, key=lambda s: len(s[0]))
    groups = [numbered(sentences[k : k + GROUP], number, place, kinds) for k in range(0, len(sentences), GROUP)]
    held = np.zeros((len(kinds), len(features)))
    for known, k in kinds.items():
        held[k, list(known)] = 1
    x = [weights, moves]
    moment, square = [np.zeros_like(p) for p in x], [np.zeros_like(p) for p in x]
    for step in range(1, steps + 1):
        parts = [loss(weights, moves, held, *group) for group in groups]
        for i, (p, m, v) in enumerate(zip(x, moment, square)):
            g = sum(grads[i] for _, grads in parts) / len(sentences) + ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(features, weights.astype(np.float32), moves.astype(np.float32))


def numbered(sentences: list[tuple[list[str], list[str]]], number: dict[str, int], place: dict[str, int], kinds: dict[tuple[int, ...], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Types and tags of the words, with a place before and behind them, and which places are words."""
    size = np.array([len(w) for w, _ in sentences])
    types, gold = np.zeros((2, len(size), size.max() + 2), np.int64)
    for k, (w, tags) in enumerate(sentences):
        types[k, 1 : len(w) + 1] = [kinds.setdefault(tuple(number[f] for f in features_of(x) if f in number), len(kinds)) for x in w]
        gold[k, 1 : len(w) + 1] = [place[t] for t in tags]
    return types, gold, np.arange(1, size.max() + 1)[None, :] <= size[:, None]


def loss(weights: np.ndarray, moves: np.ndarray, held: np.ndarray, types: np.ndarray, gold: np.ndarray, inside: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Negative log likelihood of the sentences' tags, and its gradient by weights and transitions.

    ``types`` and ``gold`` have a place before and one behind the words; ``inside`` says which places are words.
    """
    rows, longest = inside.shape
    own, before, behind = (held @ w for w in weights)
    e = own[types[:, 1:-1]] + before[types[:, :-2]] + behind[types[:, 2:]]
    k, at, last = e.shape[2], np.arange(rows), inside.sum(1) - 1
    top = e.max(2, keepdims=True)
    odds, step = np.exp(e - top), np.exp(moves)
    # Sums over all paths up to and from each place, scaled to 1; places behind a sentence's end repeat its last sums.
    alpha, beta, scale = np.zeros((rows, longest, k)), np.zeros((rows, longest, k)), np.ones((rows, longest))
    for t in range(longest):
        ahead = (step[0] if t == 0 else alpha[:, t - 1] @ step) * odds[:, t]
        scale[:, t] = np.where(inside[:, t], ahead.sum(1), 1)
        alpha[:, t] = np.where(inside[:, t, None], ahead / scale[:, t, None], alpha[:, t - 1])
    ends = alpha[:, -1] @ step[:, 0]
    beta[:, -1] = step[:, 0] / ends[:, None]
    for t in range(longest - 2, -1, -1):
        back = (odds[:, t + 1] * beta[:, t + 1]) @ step.T / scale[:, t + 1, None]
        beta[:, t] = np.where(inside[:, t + 1, None], back, beta[:, -1])
    z = np.log(scale).sum(1) + (top[:, :, 0] * inside).sum(1) + np.log(ends)
    p = alpha * beta * inside[:, :, None]
    said = np.eye(k)[gold[:, 1:-1]] * inside[:, :, None]
    likely = (e * said).sum((1, 2)) + moves[0, gold[:, 1]] + moves[gold[at, last + 1], 0] + (moves[gold[:, 1:-2], gold[:, 2:-1]] * inside[:, 1:]).sum(1)
    ahead = odds[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * inside[:, 1:, None]
    g_moves = step * (alpha[:, :-1].reshape(-1, k).T @ ahead.reshape(-1, k)) - said[:, :-1].reshape(-1, k).T @ said[:, 1:].reshape(-1, k)
    g_moves[0] += (p[:, 0] - said[:, 0]).sum(0)
    g_moves[:, 0] += (p[at, last] - said[at, last]).sum(0)
    off = (p - said).reshape(-1, k)
    grads = []
    for shift in (types[:, 1:-1], types[:, :-2], types[:, 2:]):
        by_type = np.stack([np.bincount(shift.ravel(), off[:, j], len(held)) for j in range(k)], 1)
        grads.append(held.T @ by_type)
    return float((z - likely).sum()), [np.stack(grads), g_moves]


def labelled(spark: SparkSession, n: int = 1500, seed: int = 11) -> DataFrame:
    """A table of sentences made by rule: ``words`` and ``tags``, arrays of equal length."""
    rows = made_sentences(n, seed)
    return spark.createDataFrame(rows, "words array<string>, tags array<string>")


def train(table: DataFrame, sentences: int = SENTENCES) -> Model:
    """A model from the columns ``words`` and ``tags`` of at most ``sentences`` rows, those of the smallest hashes."""
    some = table.where("words is not null and tags is not null").select("words", "tags").orderBy(F.xxhash64("words", "tags"), "words", "tags").limit(sentences)
    return fit([(list(r.words), list(r.tags)) for r in some.collect()])


def made_sentences(n: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """Sentences of invented words that hold personal data or what looks like it."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    syllables = "an er in on the re de la le que el os ung sch heit zu be ment ou eau ti ed ha é ü ñ ç ö".split()
    small = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 4)))
    large = lambda: small().capitalize()
    ascii_word = lambda: re.sub("[^a-z]", "o", small())
    hexed = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    titles = "Mr. Mrs. Ms. Dr. Prof. Herr Frau Mme Monsieur Señor Señora".split()

    def name() -> list[str]:
        return [large() for _ in range(rng.randint(1, 3))]

    def number() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{b}-{c}"], [f"{a}.{b}.{c}"], [f"0{digits(3)}/{digits(7)}"], [f"0{digits(3)}", digits(7)], ["+1", f"({a})", f"{b}-{c}"], [f"+{digits(2)}", digits(3), digits(7)], [f"00{digits(2)}", digits(2), digits(7)]])

    def account() -> list[str]:
        four = [digits(4) for _ in range(4)]
        return pick([[digits(rng.choice((13, 15, 16, 16, 16, 19)))], four, ["-".join(four)]])

    def address() -> list[str]:
        return [pick([".".join(str(rng.randint(0, 255)) for _ in range(4)) + pick(["", "", f":{digits(4)}"]), ":".join(hexed(4) for _ in range(8)), f"fe80::{hexed(4)}:{hexed(4)}"])]

    def mail() -> list[str]:
        a, b, c = ascii_word(), ascii_word(), pick(("com", "org", "net", "de"))
        return pick([[a, "[at]", b, "[dot]", c], [a, "(at)", b, "(dot)", c], [f"{a}[at]{b}.{c}"], [f"{a}(at){b}.{c}"], [f"{a}.{b}@{b}.{c}"], [f"{a}{digits(2)}@{b}.example.{c}"]])

    def iban() -> list[str]:
        a = pick(("DE", "FR", "ES", "GB", "IT")) + digits(2)
        return pick([[a + digits(18)], [a, *(digits(4) for _ in range(4)), digits(2)]])

    data: dict[str, tuple[list[str], Callable[[], list[str]]]] = {
        "tel": (["tel.", "phone", "call", "Tel:", "phone:", "mobile", "fax", ""], number), "account": (["card", "account", "no.", "", "Kreditkarte"], account), "addr": (["from", "host", "ip", "address", ""], address),
        "mail": (["mail", "write", "contact", "to", ""], mail), "ssn": (["ssn", "SSN:", "social", "", "number"], lambda: [f"{digits(3)}-{digits(2)}-{digits(4)}"]), "iban": (["IBAN", "iban:", "account", ""], iban), "name": (titles, name),
    }

    def other() -> list[str]:
        return pick([
            ["Version", f"{digits(1)}.{digits(1)}."], [f"version {digits(1)}"], [str(rng.randint(1000, 2100))], [f"{digits(2)},{digits(3)}"], [f"{digits(1)}.{digits(2)}"], [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"], [f"1{digits(1)}:{digits(2)}"],
            ["token", "=", f'"{hexed(40)}"'], ["secret:", hexed(32)], [f"password={hexed(12)}"], ["AKIA" + digits(4) + "QRSTUVWX" + digits(4)], ["page", digits(2)], [f"{digits(2)}%"], [f"${digits(1)}.{digits(2)}"], [f"#{digits(3)}"], [f"v{digits(1)}.{digits(1)}.{digits(1)}"],
            [f"https://www.{ascii_word()}.com/{ascii_word()}{digits(2)}?x={digits(1)}"], [f"www.{ascii_word()}.org"], [digits(rng.randint(5, 8))], [large()] * rng.randint(2, 8), [small().upper() for _ in range(rng.randint(2, 6))], [f"{ascii_word()}@{ascii_word()}"], ["at", "the", "dot"], ["No.", digits(5)],
            [pick(titles)], [pick(titles), small()], [large() + pick(["", "", ".", ","]) for _ in range(rng.randint(2, 40))], [large() + pick(["", ".", ","])] * rng.randint(4, 40), [large() + ".", large()], [f"{ascii_word()}_{digits(2)}"], [f"({digits(1)})"], [f"({small()})"], [f"[{digits(2)}]"], [f"{digits(4)}/{digits(2)}"], [f"{small()}{digits(2)}"], [f"-{digits(2)}"], ["+" + digits(1)], ["a", "+", "b"], [f"{digits(2)}.{digits(2)}.20{digits(2)}"], [f"{small()}-{small()}"],
        ])

    marks = ["", "", "", "", "", ".", ",", "%%%", "###", "***", "&&&", "$$$", "!!"]
    rows = []
    for _ in range(n):
        words, tags = [], []

        def say(said: list[str], tag: str = "") -> None:
            parts = [x for s in said for x in s.split()]
            words.extend(parts)
            tags.extend(["name+" if tag == "name" and k else tag for k in range(len(parts))])

        for _ in range(rng.randint(1, 3)):
            say([large() if rng.random() < 0.2 else small() for _ in range(rng.randint(0, 6))])
            if words and rng.random() < 0.3:
                words[-1] += pick(".,")
            turn = rng.random()
            if turn < 0.5:
                tag = pick(TAGS[1:-1])
                before, make = data[tag]
                say([pick(before)])
                if tag == "name" and not words:
                    say([pick(titles)])
                say(make(), tag)
            elif turn < 0.85:
                say(other())
            words[-1:] = [w + pick(marks) for w in words[-1:]]
        say([small() for _ in range(rng.randint(0, 4))])
        if rng.random() < 0.1:
            mark = pick(marks)
            words = [w + mark for w in words]
        if words:
            rows.append((words, tags))
    return rows


# Texts


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of neighbouring words of one tag without the marks around them, but for those that overlap ``base``."""
    held, at = np.flatnonzero(tags), [m.span() for m in WORD.finditer(text)]
    tags = np.where(tags == len(TAGS) - 1, len(TAGS) - 2, tags)
    out: list[Span] = []
    for part in np.split(held, np.flatnonzero((np.diff(held) > 1) | (np.diff(tags[held]) != 0)) + 1):
        start, end = at[part[0]][0], at[part[-1]][1]
        while start < end and text[start] in MARKS:
            start += 1
        while start < end and text[end - 1] in MARKS:
            end -= 1
        if start < end:
            out.append((start, len(BASE) + int(tags[part[0]]) - 1, end))
    starts = np.array([a for a, _, _ in base], np.int64)
    furthest = np.maximum.accumulate(np.array([e for _, _, e in base], np.int64)) if base else starts
    before = np.searchsorted(starts, [e for _, _, e in out], "left")
    return [s for s, k in zip(out, before.tolist()) if not k or furthest[k - 1] <= s[0]]


def spans_of(texts: list[str], words: Words) -> list[list[Span]]:
    parts = [x.encode().split() for x in texts]  # at ASCII white space only
    tags, at, out = tags_of(words, parts), 1, []
    for text, w in zip(texts, parts):
        base, own = base_spans(text), tags[at : at + len(w)]
        out.append(sorted(base + added_spans(text, own, base)) if own.any() else base)
        at += len(w) + 1
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``, an array of (kind, start, end) by start, then by the kinds' order."""
    kind = dict(df.dtypes)[id_col]
    sent = df.sparkSession.sparkContext.broadcast(model)
    made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        words = words_of(sent.value)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in x] for x in spans_of(b.column("text").to_pylist(), words)]
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, made)], names=[id_col, "spans"])

        return f

    return per_batch(with_text(df, text_col, (id_col, "id")), make, f"`{id_col}` {kind}, spans {SPANS}")


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the patterns' kinds, their digest, and all spans joined."""
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    only = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return spans.select(id_col, *map(only, BASE), F.sha2(said(of_base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
