import gzip
import hashlib
import random

import pytest

from quillon.llm import warc as W
from quillon.llm.common import scratch_path


def pages(spark):
    html = ["<p>" + "é" * 60 + str(i) for i in range(6)]
    rows = [(i, f"http://x/{i}", html[i % 6]) for i in range(20)]
    rows += [(30, "u\r\nInjected: 1", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 9), (31, None, None), (32, "z", ""), (33, "s", "short"), (34, "s", "short"), (3, "http://x/3", html[3]), (None, "n", html[0]), (40, "x", "y" * 99), (41, "x", "y" * 99), (42, "x", "z" * 100), (43, "x", "z" * 100)]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    rows, df = pages(spark)
    path = scratch_path(spark, "warc-test")
    W.write(df.repartition(3), path)
    out = W.read(spark, path).collect()
    assert all(r["gap_length"] is None for r in out)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min(p for p, _, h in rows if h == html and p is not None)
        again = len(raw) >= 100 and page is not None and page != first
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    number = lambda urn: int(urn[12:-1]) if urn and urn != "<urn:x-page:>" else None
    got = [(number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = scratch_path(spark, "warc-empty")
    W.write(df.limit(0), empty)
    assert W.read(spark, empty).collect() == []


def record(i, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_salvage(zipped, seed):
    rng = random.Random(seed)
    parts = [record(i, rng.randbytes(rng.randint(0, 300)) + b"WARC/1.1\r\n junk") for i in range(12)]
    parts = [gzip.compress(p) if zipped else p for p in parts]
    hurt = {i: bytearray(p) for i, p in enumerate(parts) if rng.random() < 0.3}
    for b in hurt.values():
        kind = rng.randrange(3)
        if kind == 0:
            del b[rng.randrange(1, len(b)) :]
        elif kind == 1:
            b[len(b) // 2] ^= 0x55
        else:
            b[0:3] = b"???"
    data = [bytes(hurt.get(i, p)) for i, p in enumerate(parts)]
    found = list(W.salvage(b"".join(data)))
    ids = [int(x.headers["warc-record-id"][12:-1]) for x in found if isinstance(x, W.Record)]
    assert set(ids) >= set(range(12)) - set(hurt) and len(ids) == len(set(ids))
    gaps = sum(x.length for x in found if isinstance(x, W.Gap))
    assert gaps == sum(len(data[i]) for i in range(12) if i not in ids)
    assert list(W.salvage(b"")) == [] and [x.length for x in W.salvage(b"none of it")] == [10]
