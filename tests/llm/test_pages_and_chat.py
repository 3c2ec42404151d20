"""WARC, chat formatting and URL filters on small and awkward inputs."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltgraph.llm import chat, urlfilter, warc
from quiltgraph.llm.common import shared_dir

PAGES = "page_id long, url string, html string"


def run_warc(spark, rows, **k):
    path = shared_dir(spark, "warc")
    warc.write_captures(spark.createDataFrame(rows, PAGES), path, **k)
    return path, warc.assemble(spark, path).collect()


def test_warc_round_trip(spark):
    tricky = "WARC/1.1\r\nContent-Length: 9\r\n\r\nx\r\n\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a.b/c?d#e", "same"), (2, None, "same"), (3, "x", None), (4, "http://é/\n", tricky), (5, "u", "x" * 300_000), (6, "u", "same"), (7, "v", "")]
    _, got = run_warc(spark, rows)
    by = {r.page_id: r for r in got}
    assert set(by) == {r[0] for r in rows}
    for i, _, html in rows:
        body = (html or "").encode()
        r = by[i]
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.response.payload_bytes == len(body)
        if r.response.record_type == "response":
            assert bytes(r.response.payload) == body and r.response.actual_digest == r.response.payload_digest
        assert len(r.requests) == 1 and len(r.metadata) == 1
    assert [by[i].response.record_type for i in range(1, 8)] == ["response", "revisit", "response", "response", "response", "revisit", "revisit"]
    assert by[2].response.refers_to == by[1].capture_id and by[7].response.refers_to == by[3].capture_id


def test_warc_least_bytes_repeats_and_nulls(spark):
    _, got = run_warc(spark, [(1, "a", "xx"), (2, "a", "xx"), (3, "a", "yyyyy"), (4, "a", "yyyyy"), (4, "a", "zz"), (None, "a", "yyyyy"), (None, None, None)], min_bytes=5)
    assert len(got) == 7 and len({r.capture_id for r in got}) == 7
    kinds = sorted((str(r.page_id), r.response.record_type) for r in got)
    assert kinds == sorted([("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit"), ("4", "response"), ("None", "revisit"), ("None", "response")])


def test_warc_empty_and_plain_archives(spark, tmp_path):
    assert run_warc(spark, [])[1] == []
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\x00hi"
    rec = warc.record("response", "urn:a", "http://a/", {"WARC-Payload-Digest": "sha1:Q"}, body, "application/http;msgtype=response") + b"\r\n\r\n"
    info = warc.record("warcinfo", "urn:i", "", {}, b"", "application/warc-fields") + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(rec))  # a member each
    (tmp_path / "b.warc").write_bytes(info + rec)
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(r.record_type for r in got) == ["response", "response", "warcinfo", "warcinfo"]
    assert all(bytes(r.payload) == b"\xff\x00hi" for r in got if r.record_type == "response")
    with pytest.raises(ValueError):
        list(warc.parse(rec[:-20]))


def test_warc_links_either_way_and_leftovers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nhi"
    rec = lambda kind, rid, *names: warc.record(kind, rid, f"http://{rid}/", {}, http if kind == "response" else b"x: y\r\n", "application/http" if kind != "metadata" else "application/warc-fields").replace(b"\r\nContent-Type", b"".join(b"\r\nWARC-Concurrent-To: <%s>" % n.encode() for n in names) + b"\r\nContent-Type", 1) + b"\r\n\r\n"
    data = [rec("response", "r1"), rec("request", "q1", "r1"), rec("request", "q2", "r1"), rec("metadata", "m1", "r1", "r2")]  # several, and one for two captures
    data += [rec("response", "r2", "q3"), rec("request", "q3"), rec("metadata", "m2", "q3")]  # named by the response, and by way of the request
    data += [rec("request", "q9", "gone"), rec("metadata", "m9", "gone"), rec("metadata", "lone")]
    data += [rec("response", "r3")]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    got = {r.capture_id: r for r in warc.assemble(spark, str(tmp_path)).collect()}
    ids = lambda xs: [x.record_id for x in xs]
    assert set(got) == {"r1", "r2", "r3", "gone", "lone"}
    assert (ids(got["r1"].requests), ids(got["r1"].metadata)) == (["q1", "q2"], ["m1"])
    assert (ids(got["r2"].requests), ids(got["r2"].metadata)) == (["q3"], ["m1", "m2"])
    assert got["r3"].requests == [] and got["r3"].response is not None
    assert got["gone"].response is None and (ids(got["gone"].requests), ids(got["gone"].metadata)) == (["q9"], ["m9"])
    assert ids(got["lone"].metadata) == ["lone"]


def test_warc_members_rolling_and_targets(spark, monkeypatch):
    """Repeated ids, small archives: every revisit's target exists, every record is a gzip member."""
    import glob
    import zlib

    monkeypatch.setattr(warc, "ROW_BYTES", 2000)
    monkeypatch.setattr(warc, "FILE_ROWS", 3)
    big = "".join(chr(65 + (i * 7919 + i * i) % 60) for i in range(30_000))
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "else"), (2, "u", "same"), (3, "u", "same"), (None, "u", "same"), (None, "u", "same"), (None, "u", None)] + [(i, "w", f"page {i} " * 40) for i in range(10, 60)] + [(90, "big", big)]
    path, got = run_warc(spark, rows)
    assert len(got) == len(rows) == len({r.capture_id for r in got})
    ids = {r.capture_id for r in got if r.response.record_type == "response"}
    visits = [r for r in got if r.response.record_type == "revisit"]
    assert sorted(str(r.page_id) for r in visits) == ["2", "3", "None", "None"] and all(r.response.refers_to in ids for r in visits)
    files = glob.glob(path.removeprefix("file://") + "/part-*")
    assert len(files) > 4
    n = 0
    for f in files:
        data = open(f, "rb").read()
        assert gzip.decompress(data)
        while data:
            d = zlib.decompressobj(31)
            text = d.decompress(data)
            assert d.eof and (not text or (text.count(b"WARC/1.1\r\nWARC-Type") == 1 and text.endswith(b"\r\n\r\n")))
            n += bool(text)
            data = d.unused_data
    assert n == 3 * len(rows)
    plain = shared_dir(spark, "warc")
    warc.write_captures(spark.createDataFrame(rows, PAGES), plain, compression="none")
    assert warc.assemble(spark, plain).count() == len(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=r"<|\im_endstar> a", max_size=40))
def test_escape_is_reversible_and_safe(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and "<|" not in e


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|im_sep|>\n", ""]), st.text(alphabet="<|\\im_end>\né ", max_size=30)), min_size=1, max_size=5))
def test_render_and_parse(turns):
    text, spans, _ = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans.tolist()] == [t for _, t in turns]


def test_mask_against_every_token():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = np.sort(rng.choice(60, 12, replace=False))
        starts, ends = cuts[:-1], cuts[1:]
        keep = rng.random(len(starts)) < 0.8
        starts, ends = starts[keep], ends[keep]
        edge = np.sort(rng.choice(60, 6, replace=False)).reshape(3, 2)
        want = [any(s < b and e > a for a, b in edge) for s, e in zip(starts, ends)]
        assert chat.token_mask(starts, ends, edge).tolist() == want


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, "assistant", "é😀 <|im_end|>"), (2, 0, "assistant", "é😀 <|im_end|>"), (None, 0, None, "x"), (3, 0, "assistant", "w " * 30_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    out = chat.format_conversations(d)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("system\n\nuser\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].n_turns == 3
    assert got[2].loss_sha256 == sha("é😀 <|im_end|>" * 2) and got[2].loss_chars == 26
    assert got[None].loss_chars == 0 and got[None].n_turns == 1
    assert got[3].loss_chars == 60_000
    r = out.where("conv_id = 1").first()
    assert len(r.token_ids) == len(r.token_starts) == len(r.loss_mask) and sum(r.loss_mask) == 1
    assert chat.digests(chat.format_conversations(d.where("false"))).count() == 0


def test_url_rules_and_list(spark):
    urls = ["http://www.example.com/en/1", "https://a.EXAMPLE.com/en/2?x", "http://example.com/de", "http://x.net/es/", "http://netx/es/1", "mailto:x", None, "http://", "http://COM", "ftp://a.org/p/?utm_source=f#z", "ftp://www.a.org/p", "http://a.org?q", "http://net/fr/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    r = {x.page_id: (x.host, x.path, x.rule, x.verdict, x.listed) for x in urlfilter.judge(d, spark.createDataFrame([("a.org/p",), (None,)], "canonical string")).collect()}
    assert r[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow", False)
    assert r[1] == ("a.example.com", "/en/2", "example.com/en/", "block", False)
    assert r[2][2:4] == ("com/", "allow") and r[3][2:4] == ("net/es/", "block") and r[4][2:4] == (None, "allow")
    assert r[5] == r[6] == r[7] == ("", "", None, "allow", False)
    assert r[8] == ("com", "", None, "allow", False)
    assert r[9][3:] == ("block", True) and r[10][3:] == ("block", True) and r[11][3:] == ("allow", False)
    assert r[12][2] == "net/fr/"
    assert urlfilter.judge(d, spark.createDataFrame([], "canonical string")).where("listed").count() == 0
    assert urlfilter.judge(d.where("false"), spark.createDataFrame([("a",)], "canonical string")).count() == 0


def test_bloom_misses_nothing(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    rows = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    for blocks, urls in ((1 << 10, 10_000), (1 << 10, 100), (1, 10_000), (1, 100)):  # beyond the bound of blocks: the exact join alone; beyond that of URLs: by shuffle
        got = urlfilter.match_listed(rows.withColumn("_mine", F.lit(1)).withColumn("w0", F.lit("x")), "key", keys.unionByName(keys), "canonical", max_blocks=blocks, broadcast_urls=urls)
        assert got.columns == ["key", "_mine", "w0", "listed"]
        assert got.where("listed").count() == 3000 and got.count() == 6000


def test_judge_keeps_columns_with_odd_names(spark):
    d = spark.createDataFrame([(1, "http://ads.org/x", "a", "b", "c")], "page_id long, url string, _r string, `a.b` string, host string")
    got = urlfilter.judge(d, spark.createDataFrame([("ads.org/x",)], "canonical string"))
    assert got.columns[:4] == ["page_id", "url", "_r", "a.b"]
    r = got.first()
    assert (r["_r"], r["a.b"], r["host"], r["verdict"]) == ("a", "b", "ads.org", "block")
