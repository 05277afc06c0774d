import base64
import gzip
import hashlib
import random

import pyarrow.fs as pafs

from kgspark.llm import warc

SCHEMA = "page_id long, url string, html string, text string, n int"


def test_keys():
    assert warc.reversed_url("http://www.News.example.com:80/a/b?x=1#f") == "com,example,news)/a/b?x=1"
    assert warc.reversed_url("https://10.0.0.1:8080/") == "10.0.0.1:8080)/"
    assert warc.reversed_url(None) == "" and warc.reversed_url("http://[bad") == "http://[bad"


def brute(rows):
    first = {}
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        first[p] = min((x for x in (first.get(p), i) if x is not None), default=None)
    out = []
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(1)
    bodies = ["<p>same</p>", None, "", "ünï\r\n\r\ncode"] + [f"<p>{i}</p>" * rng.randint(1, 50) for i in range(40)] + ["x" * 3_000_000]
    rows = [(i, rng.choice([None, "", "http://a.example.com/x y\n", f"http://h{i % 9}.example.com/p?q={i}"]), bodies[0] if i % 3 == 0 else rng.choice(bodies), "t", 1) for i in range(1500)]
    rows += [(None, "http://a.example.com/", "only without id", "t", 1), (None, "http://b.example.com/", bodies[0], "t", 1)]
    pages = spark.createDataFrame(rows, SCHEMA)
    index = warc.write(pages)
    out = warc.read(pages, index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(rows)
    one = warc.read(pages.where("page_id = 7"), index, payload=True).collect()
    assert len(one) == 1 and (one[0].payload is None) == (one[0].record_type == "revisit")
    assert warc.read(spark.createDataFrame([(99_999, "http://nowhere.example.com/", "", "", 0)], SCHEMA), index).count() == 0
    fs, base = pafs.FileSystem.from_uri(index.root)
    found = sum(gzip.decompress(fs.open_input_file(f.path).read()).count(b"WARC/1.1\r\nWARC-Type") for f in fs.get_file_info(pafs.FileSelector(f"{base}/archive")))
    assert found == len(rows)


def test_equal_keys_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(5, "http://a.example.com/", f"v{i}", "", 0) for i in range(20)] + [(i, "http://a.example.com/", "z", "", 0) for i in range(6, 30)]
    pages = spark.createDataFrame(rows, SCHEMA)
    out = warc.read(pages, warc.write(pages)).collect()
    assert len(out) == len(rows) and sum(r.page_id == 5 for r in out) == 20
    assert warc.read(pages.limit(0), warc.write(pages.limit(0))).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(i, "u", "ab" if i % 2 else "a longer one", "", 0) for i in range(10)], SCHEMA)
    kinds = {r.page_id: r.record_type for r in warc.read(pages, warc.write(pages, min_bytes=5)).collect()}
    assert [i for i, k in kinds.items() if k == "response" and i % 2 == 0] == [0] and all(kinds[i] == "response" for i in range(1, 10, 2))
