import hashlib
import io
from collections import Counter, defaultdict

import pytest

from newsloom.llm import warc


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 100)
    for records in ([b"one"], [b"a" * n + bytes(range(256)) for n in range(500)], [b"", b"x" * 10**6]):
        sink = io.BytesIO()
        assert warc.write_file(sink, iter(records)) == len(records)
        raw = sink.getvalue()
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
        assert list(warc.read_records(io.BytesIO(raw))) == records
    assert warc.write_file(io.BytesIO(), iter(())) == 0


def test_a_record_can_be_read_by_itself():
    import zstandard

    sink = io.BytesIO()
    warc.write_file(sink, iter([b"first record " * 20, b"second record " * 20]))
    raw = sink.getvalue()
    size = int.from_bytes(raw[4:8], "little")
    held = zstandard.ZstdCompressionDict(raw[8:8 + size])
    last = raw.rindex(bytes.fromhex("28b52ffd"))
    assert zstandard.ZstdDecompressor(dict_data=held).decompress(raw[last:]) == b"second record " * 20


@pytest.mark.parametrize("plain", [True, False])
def test_pages(spark, monkeypatch, plain):
    """With the broadcast of a small side, and with a shuffled join in which payloads come in parts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not plain:
        monkeypatch.setattr(warc, "PART_PAGES", 2)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        check_pages(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_short_pages_pass_by_the_join(spark):
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "'same' AS html")
    plan = warc.with_revisits(pages)
    assert {(r["kind"], r["refers_to"]) for r in plan.collect()} == {("response", None)}
    kinds = plan._jdf.queryExecution().analyzed().toString()
    assert kinds.index("Union") < kinds.index("Join")


def check_pages(spark):
    long_ = "é" * 600
    rows = [(1, "u", long_), (2, None, long_), (3, "a\nb", "short"), (4, "u", "short"), (None, "u", long_), (5, "u", None),
            (6, "u", ""), (7, "u", "x" * 300_000), (2, None, long_), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "z" * 999), (11, "u", "z" * 999)]
    pages = spark.createDataFrame([(*r, "no", 0) for r in rows], "page_id long, url string, html string, kind string, size long")
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                   None if r["payload"] is None else bytes(r["payload"])) for r in warc.archive(pages).collect())
    groups, want = defaultdict(list), Counter()
    for i, u, t in rows:
        groups[(t or "").encode()].append((i, u))
    for payload, members in groups.items():
        top = max(i for i, _ in members if i is not None)
        for i, u in members:
            again = len(payload) >= 1000 and i != top
            want[(i, u and u.replace("\n", "%0A"), len(payload), hashlib.sha1(payload).hexdigest(),
                  "revisit" if again else "response", top if again else None, None if again else payload)] += 1
    assert got == want
    assert warc.archive(pages.where("false")).collect() == []
