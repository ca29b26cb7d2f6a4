"""Foreign transport streams, and benchmark items of which only a part stands in a text."""

import random

import pytest

from gridgauge.llm import decontaminate, media


def packet(pid, counter, data, start=False, adaptation=None):
    """One packet; short data is preceded by stuffing."""
    room = 184 - len(data)
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
    if adaptation is None and not room:
        return head + bytes([0x10 | counter & 15]) + data
    field = (adaptation or b"\x00") if room > 1 else b""
    return head + bytes([0x30 | counter & 15, room - 1]) + field.ljust(room - 1, b"\xff") + data


def tables(pid, data, counter=0):
    """A table in as many packets as it needs."""
    raw = b"\x00" + data
    parts = [raw[k : k + 184] for k in range(0, len(raw), 184)]
    return [packet(pid, counter + k, x.ljust(184, b"\xff"), k == 0) for k, x in enumerate(parts)]


def foreign(rng):
    """Two programs of two streams, a map over several packets, packets of all streams dealt together, one of them twice, open lengths."""
    pat = media.section(0, 1, b"".join(bytes([0, n, 0xE0 | p >> 8, p & 255]) for n, p in ((0, 0x10), (1, 0x100), (2, 0x200))))
    out, want = tables(0, pat), []
    for program, pmt_pid in ((1, 0x100), (2, 0x200)):
        descriptors = bytes([5, 100]) + b"d" * 100
        own = [(0x1B, pmt_pid + 1), (0x0F, pmt_pid + 2)]
        body = bytes([0xE0 | own[0][1] >> 8, own[0][1] & 255, 0xF0, 0]) + b"".join(bytes([t, 0xE0 | p >> 8, p & 255, 0xF0, len(descriptors)]) + descriptors for t, p in own)
        out += tables(pmt_pid, media.section(2, program, body))
        for t, p in own:
            want.append({"program": program, "pid": p, "type": t, "payload": b"", "units": []})
    queues = []
    for s in want:
        made, counter = [], rng.randrange(16)
        for k in range(3):
            part = rng.randbytes(rng.randint(1, 900))
            stamped, open_ = rng.random() < 0.7, rng.random() < 0.5
            head = media.stamp(2, 1000 * k) if stamped else b""
            body = b"\x00\x00\x01\xe0" + (0 if open_ else len(part) + 3 + len(head)).to_bytes(2, "big") + bytes([0x80, 0x80 if stamped else 0, len(head)]) + head + part
            access = rng.random() < 0.5
            s["units"].append({"pts": 1000 * k if stamped else None, "offset": len(s["payload"]), "random_access": access})
            s["payload"] += part
            first = body[:100]
            made.append(packet(s["pid"], counter, first, True, b"\x40" if access else b"\x00"))
            counter += 1
            for at in range(100, len(body), 184):
                made.append(packet(s["pid"], counter, body[at : at + 184]))
                counter += 1
        queues.append(made)
    while any(queues):
        q = rng.choice([q for q in queues if q])
        out.append(q.pop(0))
        if rng.random() < 0.05:
            out.append(out[-1])
        if rng.random() < 0.1:
            out.append(packet(0x1FFF, rng.randrange(16), b"\xff" * 184))
    return out, want


def test_foreign_streams():
    rng = random.Random(8)
    for _ in range(30):
        packets, want = foreign(rng)
        got = media.streams(b"".join(packets))
        assert [{**s, "units": [{k: u[k] for k in ("pts", "offset", "random_access")} for u in s["units"]]} for s in got] == want
        k = rng.choice([k for k, x in enumerate(packets) if x[1:3] != b"\x1f\xff" and x not in packets[:k] and packets[k + 1 : k + 2] != [x] and k > 6])
        pid = packets[k][1:3]
        later = [x for x in packets[k + 1 :] if x[1] & 31 == pid[0] & 31 and x[2] == pid[1]]
        if later:
            with pytest.raises(ValueError):
                media.streams(b"".join(packets[:k] + packets[k + 1 :]))


def test_question_and_answer_each(spark):
    question, answer = "what do seven grey herons carry over the wide river at first light in the spring?", "they carry small stones and reeds to the islands below the old mill"
    bench = spark.createDataFrame([(1, f"{question} {answer}"), (2, "single sentence item without any question in it at all")], "item_id long, text string")
    filler = " ".join(f"w{k}" for k in range(300))
    rows = [(1, f"{filler} {question} {answer} {filler}"), (2, f"{filler} {question} {filler}"), (3, f"{answer} {filler}"), (4, f"{filler} single sentence item without any question in it at all {filler}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 1), (4, 2)]


def test_work_is_skipped():
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    items = [(k, " ".join(word() for _ in range(30))) for k in range(200)]
    df = {}
    for _, t in items:
        for w in set(decontaminate.words(t)):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(items, df, 200, 30.0, 0.5)
    texts = [" ".join(word() for _ in range(rng.randint(0, 600))) for _ in range(200)] + [t for _, t in items]
    found = {(k, i) for k, i, *_ in index.search(texts, 0.5)}
    assert {(200 + k, k) for k in range(200)} <= found
    w = index.work
    assert w["pivots"] < w["passages"] and w["scored"] < w["items"] and w["open_blocks"] < w["blocks"]
