"""Archives written and read back through the index, against plain Python."""

import hashlib

from sievework.llm import queries, warc

PAGES = "page_id long, url string, html string, key string"


def brute(rows):
    first, out = {}, []
    for i, _, h in rows:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        first[d] = min(first.get(d, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and first[d] != i
        out.append((i, len(b), d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out)


def test_edges(spark, tmp_path):
    big = "<p>é😀" * 5000
    rows = [
        (1, "http://a.org/x", None), (2, "https://WWW.a.org:443/x?q=1#f", ""), (3, None, "short"),
        (4, "bad://[x", "short"), (9, "http://a.org/x", big), (7, "http://b.org:8080", big),
        (8, "http://b.org\r\nX: 1", big), (8, "http://b.org/2", big), (7, "http://b.org:8080", big),
        (11, "http://a.org/x", "z" * 100), (10, "u", "y" * 99), (12, "u", "y" * 99)
    ]
    spark.createDataFrame([(*r, "clash") for r in rows], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.op7_warc(spark, str(tmp_path)).collect())
    assert got == brute(rows)
    empty = spark.createDataFrame([], PAGES)
    written = warc.write(empty)
    assert written.read(written.find(empty, page="page_id")).count() == 0 and written.lookup(["http://a.org/x"]) == []


def test_null_ids_and_frequent_payloads(spark, tmp_path):
    """A payload of a third of all pages, rare repeats, and pages without an id."""
    rows = [(i, f"http://h{i % 3}.org/{i}", "<a>" * 50 if i % 3 == 0 else f"<b>{i // 4}" + "x" * 100) for i in range(4, 3000)]
    rows += [
        (None, "http://a.org/", "<a>" * 50), (None, None, "only" * 30), (None, "http://z.org/", "only" * 30),
        (5000, "http://a.org/", "w " * 400_000)
    ]
    spark.createDataFrame(
        [(*r, "clash") for r in rows], "page_id long, url string, html string, first string"
    ).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op7_warc(spark, str(tmp_path)).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute([r for r in rows if r[0] is not None])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r[1:] for r in got if r[0] is None) == sorted(
        [(150, digest("<a>" * 50), "revisit", 6), *[(120, digest("only" * 30), "response", None)] * 2],
        key=str
    )


def test_lookup_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = [(i, f"http://h{i % 5}.example.org/p{i % 20}", f"<html>{i}" + "x" * (i % 3)) for i in range(200)]
    held = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for url in ("http://h0.example.org/p0", "http://H3.example.org/p3", "http://none.org/"):
        want = sorted((i, h) for i, u, h in rows if u.lower() == url.lower())
        assert sorted((r["page_id"], r["payload"].decode()) for r in held.lookup([url])) == want
    index = warc.Index(held.folder, sorted((tuple(r) for r in held.files.collect()), key=lambda r: (r[0], r[1])))
    assert sum(len(index.blocks(f)) for f in range(len(index.files))) >= 200 // 7
    # pages by URL and id: each from the block that holds it, nothing for one that isn't there
    asked = spark.createDataFrame([(u, i) for i, u, _ in rows[::3]] + [("http://none.org/", 1), (rows[0][1], 77)], "url string, page long")
    found = held.find(asked, "url", "page")
    assert sorted(r["page"] for r in found.collect()) == [i for i, _, _ in rows[::3]]
    assert sorted(r["page_id"] for r in held.read(found).collect()) == [i for i, _, _ in rows[::3]]


def test_one_url_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5)
    rows = [(None if i % 50 == 0 else i, "http://a.org/" if i % 10 else f"http://a.org/{i}", f"<p>{i}") for i in range(300)]
    held = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert len(held.lookup(["http://a.org/"])) == sum(u == "http://a.org/" for _, u, _ in rows)
    asked = spark.createDataFrame([(u, i) for i, u, _ in rows], "url string, page long")
    assert held.find(asked, "url", "page").count() == 300


def test_url_key():
    assert warc.url_key("http://www.a.org:80/x?y#z") == "org,a,www)/x?y"
    assert warc.url_key("https://a.org:81") == "org,a:81)/"
    assert warc.url_key(None) == ")/"
