import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from docloom.llm import warc
from docloom.llm.warc import HEADERS, RECORDS, Inflow, archived, member, op12_warc, read_archives, record, records, write_archives

SCHEMA = "page_id bigint, url string, html string, record_type string, digest string, first string, n string"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)

    return make


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        html = html or ""
        if page is not None and len(html.encode()) >= least:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        other = first.get(html or "")
        again = other is not None and other != page
        out.append((page, len((html or "").encode()), sha(html), "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/é\r\nX: y", ""), (5, " http://b ", "größe 😀 " * 9000), (6, "http://c", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"),
    (None, "http://d", "<p>same</p>"), (None, "http://e", "alone"), (None, "http://e", "alone"), (2, "http://a/2", "<p>same</p>"), (7, "http://f", "twice"), (7, "http://f", "twice"), (0, "http://a/0", "<p>same</p>"),
]


def test_query_equals_brute_force(pages):
    assert sorted((tuple(r) for r in op12_warc(pages(ROWS)).collect()), key=str) == brute(ROWS)
    assert op12_warc(pages([])).collect() == []


def test_shuffled_repeats_and_a_least_size(pages):
    for options in ({"broadcast_rows": 0}, {"least_bytes": 6}):
        made = archived(pages(ROWS), **options)
        found = [(r.record_id.rpartition(":")[2] or None, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and r.refers_to.rpartition(":")[2]) for r in made.collect()]
        wanted = [tuple(str(v) if k in (0, 4) and v is not None else v for k, v in enumerate(r)) for r in brute(ROWS, options.get("least_bytes", 0))]
        assert sorted(found, key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"file_bytes": "1"}])
def test_round_trip(spark, pages, tmp_path, options):
    path = str(tmp_path / "archives")
    write_archives(archived(pages(ROWS)), path, **options)
    back = read_archives(spark, path)
    assert back.columns == [c.split()[0] for c in RECORDS.split(", ")]
    payloads = sorted(bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect())
    assert payloads == sorted(r[2] or "" for r, b in zip(ROWS, [x for x in map(lambda row: next(y for y in brute(ROWS) if y[0] == row[0] and y[2] == sha(row[2])), ROWS)], strict=True) if b[3] == "response")
    assert {r.target_uri for r in back.collect()} >= {"http://a/é%0D%0AX: y", "%20http://b%20", None}
    names = os.listdir(path)
    assert not [n for n in names if n.startswith("_")]
    assert len([n for n in names if n.endswith(".warc" if options.get("compression") else ".warc.gz")]) >= (len(ROWS) if "file_bytes" in options else 1)


def test_modes(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        write_archives(archived(pages(ROWS[:1])), path, mode)
        assert read_archives(spark, path, HEADERS).count() == n


def test_predicates_are_pushed_down(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    write_archives(archived(pages(ROWS)), path)
    plan = read_archives(spark, path, where="record_type = 'revisit' AND payload_bytes > 5")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    back = read_archives(spark, path)
    everything = [r.asDict() for r in back.collect()]
    for condition, test in {
        "record_type = 'revisit'": lambda r: r["record_type"] == "revisit",
        "record_type IN ('response', 'metadata')": lambda r: r["record_type"] == "response",
        "payload_bytes >= 11 AND target_uri LIKE 'http://a/%'": lambda r: r["payload_bytes"] >= 11 and (r["target_uri"] or "").startswith("http://a/"),
        "refers_to IS NULL": lambda r: r["refers_to"] is None,
        "NOT (refers_to = 'urn:docloom:page:0')": lambda r: r["refers_to"] not in (None, "urn:docloom:page:0"),
        "octet_length(payload) = 5": lambda r: r["payload"] is not None and len(r["payload"]) == 5,
    }.items():
        expected = sum(map(test, everything))
        assert read_archives(spark, path, where=condition).count() == expected, condition
        assert back.where(condition).count() == expected and back.count() == len(ROWS), condition


def archive(rows, sl=True, whole=False):
    made = [record(r, "2020-01-01T00:00:00Z") for r in rows]
    return gzip.compress(b"".join(made)) if whole else b"".join(member(m, 6) if sl else gzip.compress(m) for m in made)


ONE = {"record_type": "response", "record_id": "urn:a", "payload": b"x" * 300_000}
TWO = {"record_type": "revisit", "record_id": "urn:b", "refers_to": "urn:a", "payload_digest": "D", "payload_bytes": 300_000}


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("kind", [{}, {"sl": False}, {"whole": True}])
def test_archives_of_other_writers(kind):
    rows = list(records(io.BytesIO(archive([ONE, TWO, ONE], **kind)), "f", ["payload", "payload_bytes"], []))
    assert [r["payload_bytes"] for r in rows] == [300_000] * 3 and [len(r["payload"] or b"") for r in rows] == [300_000, 0, 300_000]
    heads = list(records(io.BytesIO(archive([ONE, TWO, ONE], **kind)), "f", ["record_id"], []))
    assert [r["record_id"] for r in heads] == ["urn:a", "urn:b", "urn:a"]


def test_unwanted_payloads_are_not_decoded(monkeypatch):
    noise = os.urandom(2_000_000)
    data = archive([{**ONE, "payload": noise}] * 5 + [TWO])
    file = Counted(data)
    assert [r["record_type"] for r in records(file, "f", ["record_type"], [])][-1] == "revisit"
    assert file.taken < len(data) / 10
    monkeypatch.setattr(Inflow, "take", lambda self, n: pytest.fail("a payload was decoded"))
    rows = list(records(io.BytesIO(data), "f", ["record_id", "payload"], [warc.EqualTo(("record_type",), "metadata")]))
    assert rows == []


def test_broken_archives():
    for data in (b"no archive at all" * 9, archive([ONE])[:-50], b"WARC/1.1\r\nContent-Length: 90\r\n\r\nshort"):
        with pytest.raises(ValueError):
            list(records(io.BytesIO(data), "f", ["payload"], []))
    assert list(records(io.BytesIO(b""), "f", ["payload"], [])) == []


def test_planning_packs_files_by_bytes(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    write_archives(archived(pages([(k, "u", os.urandom(500).hex()) for k in range(12)])), path, file_bytes="1")
    (tmp_path / "archives" / "_writing-x").mkdir()
    (tmp_path / "archives" / "_writing-x" / "part-1.warc.gz").write_bytes(b"half")
    reader = warc.WarcReader({"path": path, "split_bytes": "2000"}, spark.createDataFrame([], RECORDS).schema)
    parts = reader.partitions()
    assert 4 <= len(parts) <= 12 and sum(len(p.names) for p in parts) == 12
    assert read_archives(spark, path).agg(F.count("*")).first()[0] == 12
    with pytest.raises(Exception, match="have no"):
        read_archives(spark, path, "other string").collect()
