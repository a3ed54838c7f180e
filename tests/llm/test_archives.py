import gzip
import io
import json
import zipfile

import pytest

from siltstone.llm import archives as A


def package(members, comment=b"", **how):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            with z.open(name, "w", **how) as f:
                f.write(data)
        z.comment = comment
    data = raw.getvalue()
    return A.Package(lambda at, n: data[at : at + n], len(data))


def records(ids):
    made = [A.write_record(i, f"http://a/{i}", (i or "none").encode() * 9, 9 * len(i or "none"), b"\0" * 20, None) for i in ids]
    places, at = [], 0
    for r in made:
        places.append({"offset": str(at), "length": len(r)})
        at += len(r)
    return b"".join(made), places


@pytest.mark.parametrize("how", [{}, {"force_zip64": True}])
def test_any_archives_and_indexes(how):
    one, at = records(["1", "2", None])
    two, to = records(["null", "a b/>\n"])
    three, _ = records(["6"])
    plain, _ = records(["7", "8"])
    plain = gzip.decompress(plain)
    lines = [json.dumps(p | {"filename": "one.warc.gz"}) for p in at]
    cdx = ["com,a)/ 20240101 " + json.dumps(p | {"filename": "two.warc.gz"}) for p in to] + ["!meta 0 {\"format\": \"x\"}"]
    members = {"archive/one.warc.gz": one, "archive/two.warc.gz": two, "archive/three.warc.gz": three, "archive/plain.warc": plain, "indexes/a.jsonl": "\n".join(lines).encode(), "indexes/b.cdxj.gz": gzip.compress("\n".join(cdx).encode()), "pages/pages.jsonl": b"{}"}
    found = package(members, b"a comment with PK\5\6 in it" + b"\0" * 30, **how)
    for read_bytes in (1, 4 << 20):
        got = list(A.read_records(found, read_bytes))
        assert [A.page_of(f["WARC-Record-ID"]) for f, _, _ in got] == ["1", "2", None, "null", "a b/>\n", "6", "7", "8"]
        assert [p for _, _, p in got] == [(A.page_of(f["WARC-Record-ID"]) or "none").encode() * 9 for f, _, _ in got]


def test_text_ids_long_payloads_and_clashing_columns(spark):
    rows = [("null", "u", "x" * 3_000_000, "k", 0)] * 2 + [("zz", None, "x" * 3_000_000, "k", 0), (None, "u", "x" * 3_000_000, "k", 0), ("b>\r\n", "u", "", "k", 0)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, keeper string, payload_bytes int")
    got = sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to) for r in A.archive_round_trip(spark, pages).collect())
    assert got == [("", 3_000_000, "revisit", "zz"), ("b>\r\n", 0, "response", None), ("null", 3_000_000, "revisit", "zz"), ("null", 3_000_000, "revisit", "zz"), ("zz", 3_000_000, "response", None)]
    same = {tuple(r) for r in A.decide_records(pages, broadcast_groups=0).drop("html").collect()}
    assert same == {tuple(r) for r in A.decide_records(pages).drop("html").collect()}


def test_a_task_for_each_package(spark):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(200)], "page_id long, url string, html string").repartition(4)
    manifest = A.write_packages(A.decide_records(pages), A.work_path(spark, "packages"), package_bytes=2000)
    assert manifest.count() > 4 and A.read_packages(manifest).rdd.getNumPartitions() == manifest.count()
