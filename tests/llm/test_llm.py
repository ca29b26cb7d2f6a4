"""The text operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridgauge.llm import bpe, decontaminate, html, media, quality, queries, secrets, sharding, simhash, toolcalls, toxicity

ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, spans string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns whose names clash."""
    rows = [(1, None), (2, ""), (3, "word " * 200_000), (4, "same text of a few words here"), (5, "same text of a few words here"), (5, "same text of a few words here"), (None, "no id"), (7, "\n\t  "), (8, "ünï © 日本 <|endoftext|> 🙂")]
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 0, 0, "x") for i, t in rows], ODD)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- 1 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b &amp; c&lt;", "a\n\nb & c<"), ("<nav>x</nav>", ""),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a>m</a></nav><article><h1>H</h1><p>one<br>two</p></article><footer>f</footer>", "H\n\none two"),
        ("<div class='side-bar'>x</div><main><p>a</p><div class='comments'><p>no</p></div><p>b</p></main>", "a\n\nb"),
        ("<div id=content><h2>T</h2><p>long text of the page</p><div class=\"ad banner\">buy</div><p>more text</p></div><div class=cookie-notice><p>ok?</p></div><form><p>mail</p></form>", "T\n\nlong text of the page\n\nmore text"),
        ("<article><p>cut in the mid", "cut in the mid"), ("<article><p>x <!-- gone --> y</p><script>var a='</p>';</script></article>", "x y"),
    ],
)
def test_html(page, want):
    assert html.main_text(page) == want


def test_html_articles(spark, sf_dir):
    got = queries.op1_html_extraction(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages)
    from html import unescape

    for r in got:
        own = pages[r.page_id].partition("<article>")[2].partition("</article>")[0].partition("<footer>")[0]
        blocks = [" ".join(unescape(x).split()) for x in re.split("<[^>]*>", re.sub("<br>", " ", re.sub("</?b>", "", own)))]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a</p>", "x"), (None, "u", "<p>" + "b " * 100_000, "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html.extract(df).collect()) == [0, 1, 199_999]
    assert html.extract(df.limit(0)).count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------


def brute_spans(text):
    found = []
    for k, r in enumerate(secrets.RULES):
        for m in re.finditer("[0-9a-f]+" if r.kind == "hex" else r.pattern, text, r.flags):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), k, m.end()))
    return [f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(found)]


def test_secrets_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op2_secret_scan(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = brute_spans(t)
        assert got[i].spans == ",".join(want)
        base = [x for x in want if x.split(":")[0] in ("assign", "access", "hex")]
        assert got[i].base_sha256 == sha(",".join(base))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))


def test_secrets_random(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", '"', "'", " ", ": ", "=", "AKIA", "QWERTY0123456789", "deadbeef" * 4, "DEAD", "gh", "p_", "a" * 40, "é", "xoxb-", "sk_live_", "eyJabcdefghij.", "api_key", "apikey", "toKen", "ſecret"]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    import pyarrow as pa

    got = secrets.scanner(secrets.RULES).scan(pa.array(raw))
    for t, spans in zip(raw, got):
        assert [f"{secrets.RULES[k].kind}:{a}:{b}" for k, a, b in spans] == brute_spans(t)


def test_trigram_queries():
    said = secrets.trigram_query("(password|token)=[a-z]+", re.I)
    assert len(said) == 1 and frozenset({b"tok", b"oke", b"ken", b"en="}) in said[0]
    assert secrets.trigram_query("[0-9a-f]{32,}") == ()
    assert secrets.trigram_query("ab(cd)?ef") == (frozenset({frozenset({b"abe", b"bef"}), frozenset({b"abc", b"bcd", b"cde", b"def"})}),)


def test_redact(spark, odd):
    df = spark.createDataFrame([(1, "x password=abcdefgh1 y", 22), (2, "plain", 5), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secrets.redact(df, "text", "n_chars").collect()}
    assert got[1].text == "x [assign] y" and got[1].n_chars == 12 and got[2].text == "plain" and got[3].text is None
    assert secrets.redact(odd, "text", "n_chars").columns == odd.columns
    assert secrets.redact(odd, "text", "n_chars").count() == odd.count() == secrets.find_secrets(odd).count()


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0
    model = toxicity.train(docs, labels.where(half))
    assert list(model.cuts) == sorted(model.cuts)
    got = toxicity.grade(docs, model).join(labels.where(~half).select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    assert np.mean([r.toxic == r.label for r in got]) > 0.95
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3 for r in got)
    kept = toxicity.keep_civil(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.grade(docs, model).where("toxic = 0").count()


def test_toxicity_odd(spark, odd, labels):
    none = toxicity.train(odd, labels.limit(0))
    assert toxicity.grade(odd, none).where("toxic = 1").count() == 0
    assert toxicity.grade(odd, none).count() == odd.count() == toxicity.keep_civil(odd, none).count()
    assert toxicity.grade(odd.limit(0), none).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------


def brute_fp(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    s = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_brute_force(spark, sf_dir, texts):
    fps = {i: brute_fp(t) for i, t in texts.items()}
    want = brute_components(fps)
    for r in queries.op4_simhash(spark, sf_dir).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize(("shard", "masks"), [(65_536, 5), (1 << 4, 5), (1, 5), (1 / 64, 15)])
def test_simhash_links_of_random_fingerprints(spark, monkeypatch, shard, masks):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "SHARD", shard)
    assert len(simhash.choices(800, 4)) == masks
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
    chain = np.cumsum(np.concatenate(([0], np.full(15, 1)))).astype(np.uint64)
    chain = np.array([(1 << 4 * k) - 1 for k in range(16)], np.uint64) ^ np.uint64(chain[0])
    x = np.unique(np.concatenate((base, near, chain)))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = simhash.components(simhash.links_between(df), "fp", "to")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in found.collect()}
    want = brute_components({int(v): int(v) for v in x})
    group, mine = defaultdict(set), defaultdict(set)
    for v in x.tolist():
        group[want[v]].add(v)
        mine[got.get(v, v)].add(v)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, mine.values()))


def test_replication_is_bounded():
    """Rows that are shuffled for each fingerprint, at 10 and 100 million."""
    rng = np.random.default_rng(1)
    sample, x = np.sort(rng.integers(0, 1 << 64, simhash.SAMPLE, np.uint64)), rng.integers(0, 1 << 64, 20_000, np.uint64)
    for n, most in ((10**7, 5.5), (10**8, 6.5)):
        leaf = int(len(sample) * simhash.SHARD / n)
        sent = sum(len(h) + len(v) for m in simhash.choices(n, 4) for _, h, v in simhash.Tree(sample, m, 4, leaf).route(x))
        assert 5 * len(x) <= sent < most * len(x)


def linked_pairs(x, links):
    """(fingerprint, root) of all of ``x`` after ``links``, as sets of what is joined."""
    up = {int(v): int(v) for v in x}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(int(a)), root(int(b))))
        up[b] = a
    groups = defaultdict(set)
    for v in up:
        groups[root(v)].add(v)
    return sorted(map(sorted, groups.values()))


def brute_pairs(x, radius=4):
    for k, v in enumerate(x):
        yield from ((v, u) for u in x[:k][np.bitwise_count(x[:k] ^ v) <= radius])


def test_visitors_carry_links_over_boundaries(monkeypatch):
    """A tree whose nodes all measure 64 bits: links between shards are found by visitors, and without them they are lost."""
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
    x = np.unique(np.concatenate((base, near)))
    tree = simhash.Tree(x, 0, 4, 40)
    assert tree.shards >= 8 and all(r == 4 and mask == simhash.FULL for mask, r, *_ in tree.nodes)
    routed = list(tree.route(x))
    assert sorted(np.concatenate([h for _, h, _ in routed]).tolist()) == x.tolist()
    want = linked_pairs(x, brute_pairs(x))
    got = [pair for _, h, v in routed for pair in zip(*simhash.shard_links(h, v, 4))]
    alone = [pair for _, h, v in routed for pair in zip(*simhash.shard_links(h, v[:0], 4))]
    assert linked_pairs(x, got) == want != linked_pairs(x, alone)


@pytest.mark.parametrize("flips", [1, 2, 4, 7, 12])
def test_masses_inside_a_shard(flips, monkeypatch):
    """Many distinct fingerprints around one, from a mass that one vantage point links to one with few links."""
    monkeypatch.setattr(simhash, "LEAF", 32)
    rng = np.random.default_rng(flips)
    x = np.full(900, rng.integers(0, 1 << 64, dtype=np.uint64))
    for _ in range(flips):
        x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    x = np.unique(x)
    home, visiting = x[::2], x[1::2]
    want = linked_pairs(x, ((a, b) for a, b in brute_pairs(x) if a in home or b in home))
    assert linked_pairs(x, zip(*simhash.shard_links(home, visiting, 4))) == want
    assert not len(simhash.shard_links(home[:0], visiting, 4)[0])
    assert linked_pairs(x, zip(*simhash.shard_links(np.repeat(home, 3), visiting, 4))) == want


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert simhash.components(edges.limit(0), "a", "b").count() == 0


def test_simhash_odd(spark, odd, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 1)
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[7] == 1 and comp[4] == comp[5] == 4 and comp[3] == 3
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 8]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_quality_odd(spark, odd, labels):
    model = quality.train(odd, labels.limit(0))
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5}
    risk = quality.fit(np.array([[1.0], [2.0]]), np.array([[1.0], [9.0]]), 0.5)
    assert risk.score(np.array([[1.5]]))[0] > risk.score(np.array([[9.0]]))[0]


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_sharding(spark, sf_dir, texts):
    got = queries.op6_sharding(spark, sf_dir).collect()
    assert len(got) == len(texts)
    slots, loads, of_text = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        t = texts[r.doc_id].encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t) and r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        of_text[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 16
    # A plain heap with one entry a group gives each shard as many groups of each size.
    want = plain_schedule(groups.values(), 40)
    had = Counter((groups[t.decode()], *s) for t, s in of_text.items())
    assert had == Counter(want)


def plain_schedule(sizes, shards):
    import heapq

    heap, out = [(0, k) for k in range(shards)], []
    for size in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        out.append((size, k))
        heapq.heappush(heap, (load + size, k))
    return out


def test_schedule():
    rng = random.Random(7)
    assert sharding.schedule([], 3) == []
    for _ in range(300):
        sizes = Counter(rng.choice((1, 2, 3, 5, 8, rng.randint(1, 400))) for _ in range(rng.choice((3, 30, 900))))
        shards = rng.randint(1, 9)
        got = Counter()
        for size, ends, order in sharding.schedule(list(sizes.items()), shards):
            for k in range(shards):
                got[size, k] += (np.diff([0, *ends])[k] if ends else 0) + order.count(k)
        assert +got == Counter(plain_schedule(sizes.elements(), shards))


def test_sharding_odd(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 1)
    got = sharding.shard(odd, 2).collect()
    assert len(got) == odd.count()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(odd.limit(0), 2).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------


def brute_hits(texts, items):
    from test_benchmark_scores import brute

    return set(brute(texts, items))


def test_decontamination_brute_force(spark, sf_dir, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, sf_dir).collect()}
    assert got == brute_hits(texts, items) and got


def test_decontamination_planted_and_parts(spark, sf_dir, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rng = random.Random(4)
    filler = [t for t in texts.values() if len(t) > 500]
    planted = {10_000 + k: f"{(f := rng.choice(filler))[:300]} {items[k % len(items)].upper() if k % 3 else items[k % len(items)]} {f[300:]}" for k in range(40)}
    df = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {(i, (i - 10_000) % len(items)) for i in planted} <= got
    kept = decontaminate.keep_clean(df.unionByName(spark.createDataFrame([(1, "a clean text of other words"), (None, "no id")], df.schema)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {r.doc_id for r in kept.collect()} == {1, None}


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "same text of a few words here"), (2, None), (3, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect())
    assert got == [(4, 1), (5, 1), (5, 1)]
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0


# --- 8 ------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, sf_dir, texts):
    for r in queries.op8_media_columns(spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))


def test_media_lengths_and_damage():
    rng = random.Random(6)
    for n in [*range(192, 4000, 192), media.UNIT, media.UNIT + 192, 3 * media.UNIT + 960]:
        p = rng.randbytes(n)
        m = media.mux(p)
        got, units = media.demux(m)
        assert got == p and len(m) % 188 == 0 and [u["offset"] for u in units] == list(range(0, n, media.UNIT)) and all(u["random_access"] for u in units)
        assert [u["pts"] for u in units] == [k * media.TICKS for k in range(len(units))]
        assert all(m[u["packet"]] == 0x47 for u in units)
    for bad in (m[:-188], m[188 * 5 :], m[: 188 * 6] + m[188 * 7 :], m[:100], b""):
        with pytest.raises((ValueError, IndexError)):
            media.demux(bad)


def test_media_odd(spark, odd):
    got = media.from_media(media.to_media(odd)).collect()
    assert len(got) == odd.count() and len({r.media_sha256 for r in got if r.doc_id in (4, 5)}) == 1
    assert all(bytes(r.payload).rstrip(b" ") == (t or "").encode().rstrip(b" ") for r, t in zip(sorted(got, key=lambda r: (r.n_bytes, r.payload_sha256))[-1:], ["word " * 200_000]))


# --- 9 ------------------------------------------------------------------------------------------------------------

TOOLS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x", "y"]}}, "additionalProperties": False}, "reply": toolcalls.REPLY}


def test_tool_calls(spark):
    call = '{"tool_calls":[{"id":"c2","name":"add","arguments":{"b":"x","a":2},"after":["c1"]},{"id":"c1","function":{"name":"add","arguments":"{\\"a\\": 1}"}}]}'
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"c1","content":{"v":[1, 2.5],"k":null}}'), (1, 3, "tool", '<tool_response>{"tool_call_id":"c1","content":"again"}</tool_response>'), (1, 4, "tool", '{"tool_call_id":"zz","content":1}'), (2, 0, "user", None), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
            (3, 0, "assistant", '{"tool_calls":[{"id":"p","name":"add","arguments":{"a":-1,"c":1},"after":["q"]},{"id":"q","name":"none","arguments":{},"after":["p"]},{"id":"r","name":"add","arguments":"{bad","after":["nowhere"]}]}')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(df, TOOLS).collect()}
    assert len(got) == 9
    assert got[1, "c1"].json == '{"arguments":{"a":1},"id":"c1","name":"add","result":{"k":null,"v":[1,2.5]}}' and (got[1, "c1"].level, got[1, "c1"].n_results, got[1, "c1"].valid) == (0, 2, True)
    assert (got[1, "c2"].level, got[1, "c2"].linked, got[1, "c2"].valid) == (1, False, True) and '"arguments":{"a":2,"b":"x"}' in got[1, "c2"].json
    assert got[1, "zz"].name is None and got[1, "zz"].faults == "no call" and not got[1, "turn-0"].linked
    assert got[2, "turn-0"].faults == "$.text: length" and got[None, "turn-0"].linked
    assert got[3, "p"].level is None and got[3, "p"].faults == "$.a: bounds; $.c: unknown" and got[3, "q"].faults == "no tool none" and got[3, "r"].faults == "$: not JSON" and got[3, "r"].level is None
    assert toolcalls.link(df.limit(0)).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_same_as_library(spark, sf_dir, texts, tokenizer):
    got = {r.doc_id: r for r in queries.op10_bpe(spark, sf_dir).collect()}
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i].decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_bpe_random_text(tokenizer):
    rng = random.Random(8)
    parts = [*"abcdefgst ABC'\n\t01é日🙂 ­՘", "<|endoftext|>", "the", " ing", "'ll", "aaaa", "\r\n", "_-" * 40, "x" * 90]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    e = bpe.Encoder(bpe.Vocabulary(bpe.default_path()), most_words=2000, most_pairs=1000)
    for t, (ids, said) in zip(raw, e.encode_all(raw)):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and said == ",".join(map(str, want)) and e.v.decode(ids) == t.encode()
    assert 0 < e.failed < e.proposed


def test_bpe_exact_forms_agree():
    v = bpe.Vocabulary(bpe.default_path())
    rng = random.Random(5)
    words = ["".join(rng.choice("aabcdeérst") for _ in range(rng.randint(1, 30))).encode()[:64] for _ in range(500)]
    assert v.exact(words) == [v.exact_long([v.single[x] for x in w]) for w in words]
    words += [b"", "日本".encode(), b" " * 90, b"-" * 64]
    assert v.propose(words) == [v.greedy(w) for w in words] and v.propose([]) == []


def test_bpe_odd(spark, odd):
    got = bpe.encode_decode(odd).collect()
    assert len(got) == odd.count()
    back = {r.doc_id: r for r in got}
    assert back[1].n_tokens == 0 and back[2].decoded == "" and back[3].decoded == "word " * 200_000 and back[8].decoded == "ünï © 日本 <|endoftext|> 🙂" and 50256 in back[8].ids


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_brute_force(spark, sf_dir, docs, labels, tokenizer):
    import corpus_pipeline
    from test_nearcopies import brute_kept

    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, labels)
    toxic = {r.doc_id for r in toxicity.grade(docs, model).where("toxic = 1").collect()}
    civil = {i: t for i, t in rows.items() if i not in toxic}
    unique = {i: civil[i] for i in brute_kept(civil)}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    leaks = {i for i, _ in brute_hits(unique, items)}
    clean = {i: t for i, t in unique.items() if i not in leaks}

    def redacted(t):
        out, at = "", 0
        for s in brute_spans(t):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        return out + t[at:]

    want = {i: tokenizer.encode(redacted(t), add_special_tokens=False).ids for i, t in clean.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].ids == ids and got[i].ids_sha256 == sha(",".join(map(str, ids))) for i, ids in want.items())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_pipeline_stages_by_row(spark, sf_dir):
    """Repeated and null ids through each stage: what goes is decided by a row's own text."""
    import corpus_pipeline

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    clean = "an unrelated clean text of other words that nobody has marked"
    rows = [(5, item), (5, clean), (None, item), (7, "password=abcdefgh12 in a text of its own"), (None, clean), (8, None), (9, ""), (7, "password=abcdefgh12 in a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, sf_dir).collect()), key=repr)
    same = sorted(rows, key=repr)
    assert left("toxicity") == same
    assert left("benchmark_decontamination") == [r for r in same if r[1] != item]
    assert left("secret_scan") == sorted(((i, t.replace("password=abcdefgh12", "[assign]") if t else t) for i, t in rows), key=repr)
    near = left("simhash_near_dedup")
    assert [r for r in near if r[0] is None] == [r for r in same if r[0] is None] and near.count((5, item)) == near.count((5, clean)) == 1 and sum(i == 7 for i, _ in near) == 1
    assert stages["bpe"](spark, docs, sf_dir).count() == len(rows)
    for name in stages:
        assert stages[name](spark, docs.limit(0), sf_dir).count() == 0
