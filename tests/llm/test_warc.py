import base64
import gzip
import hashlib
import random

from veilstone.llm import warc_index as w

PAGES = "page_id long, url string, html string, captured string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a.com/x", "same"), (2, "http://a.com/x", "same"), (3, "http://b.org/", None), (4, None, ""), (5, "http://a.com/\r\nEvil: 1", "é\r\n\r\nWARC/1.1\r\n\r\n"), (None, "", "same"), (6, "http://c.net/", "z" * 300_000), (2, "http://a.com/x", "same")]
    pages = spark.createDataFrame([(*r, "2020") for r in rows], PAGES)
    got = w.capture_index(pages, str(tmp_path / "archives")).collect()
    assert len(got) == len(rows)
    told = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got}
    size = lambda h: len((h or "").encode())
    keep = {"same": 2, None: 4, "": 4}
    assert told == {(p, size(h), digest(h), "revisit" if keep.get(h, p) != p else "response", keep[h] if keep.get(h, p) != p else None) for p, _, h in rows}
    keys = [(r.url_key, r.captured, w.work.NO_ID if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)


def test_archives_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.com/{i}", f"<p>{i}</p>", "x") for i in range(30)], PAGES)
    w.write_archives(pages, str(tmp_path / "a"))
    names = list((tmp_path / "a").glob("part-*"))
    records = [r for n in names for r in w.parse_archive(gzip.decompress(n.read_bytes()))]
    assert sorted(r[0] for r in records) == list(range(30))
    assert gzip.decompress(names[0].read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_least_bytes_and_timestamps(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/", "ab", "2021-05-01 00:00:00"), (2, "http://a.com/", "ab", "2020-05-01 00:00:00")], PAGES)
    got = w.capture_index(pages, str(tmp_path / "a"), least_bytes=3, captured="captured").collect()
    assert [(r.page_id, r.record_type, r.captured) for r in got] == [(2, "response", "2020-05-01T00:00:00Z"), (1, "response", "2021-05-01T00:00:00Z")]
    assert w.capture_index(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_loser_tree():
    r = random.Random(8)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 9))) for _ in range(k)]
        got = [runs[a][b] for a, b in w.LoserTree(runs)]
        assert got == sorted(x for run in runs for x in run)
