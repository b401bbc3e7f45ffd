import base64
import gzip
import hashlib
import random
import zlib

from lociflow.llm import common, warc


def record(i, payload):
    return warc.encode_record(i, f"http://x/{i}", payload, warc.sha1_base32(payload), None)


def ids(found):
    return [f.headers["warc-record-id"] for _, _, f in found if not isinstance(f, str)]


def test_salvage_recovers_after_damage():
    members = [gzip.compress(record(i, b"payload WARC/1.1\r\n" + bytes([i]) * 400)) for i in range(5)]
    whole = b"".join(members)
    assert len(ids(warc.salvage(whole))) == 5
    bad = bytearray(whole)
    bad[len(members[0]) + 40] ^= 255
    found = list(warc.salvage(bytes(bad)))
    assert ids(found) == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)]
    (gap,) = [(o, n) for o, n, f in found if isinstance(f, str)]
    assert gap == (len(members[0]), len(members[1]))
    cut = list(warc.salvage(whole[: -len(members[4]) // 2]))
    assert len(ids(cut)) == 4 and isinstance(cut[-1][2], str)
    plain = b"junk" + record(1, b"abc") + b"\x00\x01" + record(2, b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    found = list(warc.salvage(plain))
    assert ids(found) == ["<urn:page:1>", "<urn:page:2>"]
    assert sum(n for _, n, _ in found) == len(plain) and [o for o, _, _ in found][0] == 0
    broken = record(1, b"abc").replace(b"abc", b"abd")
    assert list(warc.salvage(broken))[0][2] == "block digest differs"
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"\x1f\x8b\x08"))[0][1] == 3
    assert zlib.crc32(b"") == 0


def test_round_trip_with_revisits(spark):
    rows = [(1, "u", "same", "x"), (2, "u", "same", "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "a\r\nb", "é\r\n\r\n", "x"), (None, "u", "same", "x"), (2, "u", "same", "x"), (None, "u", "other", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    folder = common.shared_dir(spark)
    warc.write(pages, f"{folder}/warc", archive_bytes=300)
    records = warc.read(spark, f"{folder}/warc")
    assert records.where("kind = 'gap'").count() == 0
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve(records, folder).collect())
    assert got == sorted([("1", "revisit", 2, 4), ("2", "response", None, 4), ("2", "response", None, 4), ("3", "revisit", 4, 0), ("4", "response", None, 0), ("5", "response", None, 6), ("None", "response", None, 4), ("None", "response", None, 5)])
    digests = {r.page_id: r.payload_digest for r in warc.resolve(records, folder).collect()}
    assert digests[5] == base64.b32encode(hashlib.sha1("é\r\n\r\n".encode()).digest()).decode()


def test_least_bytes_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.plan_revisits(pages, 3).collect()} == {1: None, 2: None, 3: 4, 4: None}
    folder = common.shared_dir(spark)
    warc.write(pages.limit(0), f"{folder}/warc")
    assert warc.read(spark, f"{folder}/warc").collect() == [] and warc.resolve(warc.read(spark, f"{folder}/warc"), folder).collect() == []


def test_random_pages_equal_a_plan_by_hand(spark):
    """Equal payloads in groups of any size, a payload of many kilobytes, nulls: every row of the contract."""
    rng = random.Random(6)
    payloads = [None, "", "a", "é" * 50, "<p>x</p>" * 4000, *[f"page {i}" for i in range(30)]]
    rows = [(i, f"http://x/{i}", rng.choice(payloads)) for i in rng.sample(range(10_000), 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    folder = common.shared_dir(spark)
    warc.write(pages, f"{folder}/warc", archive_bytes=20_000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(warc.read(spark, f"{folder}/warc"), folder).collect()}
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(i, last.get(t or "", -1))
    want = {}
    for i, _, t in rows:
        body = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[i] = (len(body), digest, "response", None) if last[t or ""] == i else (len(body), digest, "revisit", last[t or ""])
    assert got == want
