"""Operators 4 and 7, and the pipeline."""

import io
import wave

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import audio, warc
from tests.llm.helpers import corpus, empty, frame

PAGE = '<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><script>var x="</p>";</script></head><body><p>One<br>two &lt;3</p><a href="/c">c</a><a href="https://x.org/d">d</a></body></html>'


def test_warc_round_trip():
    data = warc.response("https://e.org/a", PAGE)
    headers, block = warc.parse(data)
    assert headers["warc-type"] == "response" and block.endswith(PAGE.encode())
    found = warc.derivatives(data)
    assert found["digest_ok"] and found["title"] == "A & B" and found["language"] == "en"
    assert found["outlinks"] == ["https://e.org/c", "https://x.org/d"]
    assert found["text"].split("\n") == ["A & B", "One", "two <3", "cd"]
    for name in ("metadata", "conversion"):
        h, b = warc.parse(found[name])
        assert h["warc-type"] == name
        assert h["warc-refers-to"] == headers["warc-record-id"] and h["warc-target-uri"] == "https://e.org/a"
        assert h["warc-refers-to-date"] == headers["warc-date"] and h["warc-source-payload-digest"] == headers["warc-payload-digest"]
        assert h["warc-block-digest"] == warc.digest(b) and int(h["content-length"]) == len(b)
    assert warc.parse(found["conversion"])[1].decode() == found["text"]
    assert warc.response("https://e.org/a", PAGE) == data


def test_warc_odd_records(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://a/\nb", ""), (1, "http://a/", PAGE), (None, "http://[bad", '<a href="http://[x">y</a>')]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = warc.derive(warc.responses(pages)).collect()
    assert len(found) == 5 and all(r.error is None and r.digest_ok for r in found)
    assert len({r.response_id for r in found}) == 4
    good = warc.response("u", PAGE)
    broken = spark.createDataFrame([(1, b"junk"), (2, None), (3, good[:80]), (4, warc.derivatives(good)["metadata"]), (5, good.replace(b"One", b"Two"))], "page_id bigint, record binary")
    rows = {r.page_id: r for r in warc.derive(broken).collect()}
    assert all(rows[i].error and rows[i].metadata is None for i in (1, 2, 3, 4))
    assert rows[5].error is None and not rows[5].digest_ok
    warc.write_files(warc.derive(warc.responses(pages)), str(tmp_path / "w"))
    assert all(warc.parse(bytes(r.record))[0]["warc-type"] == r.kind and bytes(r.record[:2]) == b"\x1f\x8b" for r in spark.read.parquet(str(tmp_path / "w")).collect())
    assert spark.read.parquet(str(tmp_path / "w")).groupBy("kind").count().count() == 2
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def http_record(headers: str, body: bytes, **more):
    block = f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body
    return warc.record([("WARC-Type", "response"), *more.items(), ("WARC-Target-URI", "http://a/"), ("WARC-Block-Digest", warc.digest(block))], block)


def test_warc_bodies_and_headers():
    import gzip
    import zlib

    packed = gzip.compress(PAGE.encode())
    chunks = b"5;x=y\r\n" + packed[:5] + b"\r\n" + f"{len(packed) - 5:x}\r\n".encode() + packed[5:] + b"\r\n0\r\n\r\n"
    for headers, body in [("Content-Encoding: gzip", packed), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX-A: b", chunks), ("Content-Encoding: deflate", zlib.compress(PAGE.encode())), ("Content-Encoding: identity", PAGE.encode())]:
        found = warc.derivatives(http_record(headers, body, **{"WARC-IP-Address": "1.2.3.4"}))
        assert found["title"] == "A & B" and found["text"].startswith("A & B\nOne") and found["digest_ok"]
        meta = warc.parse(found["metadata"])[1].decode()
        assert "source-warc-ip-address: 1.2.3.4\r\n" in meta and "source-http-status: HTTP/1.1 200 OK\r\n" in meta and ("source-http-x-a: b" in meta) == ("X-A" in headers)
        assert warc.parse(found["conversion"])[0]["warc-source-block-digest"].startswith("sha1:")
    for headers, body in [("Content-Encoding: br", b"x"), ("Content-Encoding: gzip", packed[:-9]), ("Content-Encoding: gzip", b"junk"), ("Transfer-Encoding: chunked", b"ff\r\nx")]:
        with pytest.raises((ValueError, zlib.error)):
            warc.derivatives(http_record(headers, body))
    one, two = (warc.derivatives(http_record("A: b", x)) for x in (b"x", b"y"))
    assert one["conversion_id"] != two["conversion_id"]


def test_warc_damaged_records_give_errors(spark):
    import gzip

    good = gzip.compress(warc.response("u", PAGE), mtime=0)
    rows = [(i, good[:i] + bytes([good[i] ^ 255]) + good[i + 1 :]) for i in range(len(good))]
    rows.append((len(good), b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: -5\r\n\r\nabcdefgh"))
    found = warc.derive(spark.createDataFrame(rows, "page_id int, record binary")).collect()
    assert len(found) == len(rows) and sum(r.error is not None for r in found) > len(rows) // 2
    assert all((r.error is None) == (r.text is not None) for r in found)


def test_unclosed_markup_is_read_once():
    import time

    began = time.perf_counter()
    for piece in ("<!-- ", "<script> ", "<title>", "<", "<html ", '<a href="', "<a href='", "</p", "<a " + "href " * 9):
        for end in ("", "-->", ">", "</title>", "</script>"):
            assert isinstance(warc.plain_text(piece * 100_000 + end), str)
    assert time.perf_counter() - began < 20
    assert warc.plain_text("a <b>c <script>x") == "a c x" and warc.plain_text("1 < 2 <i>3") == "1 3" and warc.plain_text("x<!-- y") == "x<!-- y"
    assert warc.plain_text("<SCRIPT>a</Script >b<!-- > -->c<STYLE>d") == "b cd"


def wav(samples, rate=audio.RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.repeat((samples * 12000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def test_alignment(spark):
    rnd = np.random.default_rng(6)
    tune = audio.melody(list(rnd.standard_normal(160)))[0]
    hop = audio.HOP
    rows = [
        (20, wav(tune)),
        (21, wav(tune[hop * 12 :])),
        (22, wav(tune + rnd.standard_normal(len(tune)) * 0.02)),
        (23, wav(audio.melody(list(rnd.standard_normal(160)))[0])),
        (24, wav(tune)),
        (25, None),
        (26, b"no audio"),
        (27, wav(tune[:100])),
        (28, wav(np.zeros(30000))),
        (40, wav(np.zeros(30000))),
        (41, wav(tune, rate=1)),
        (42, wav(tune)[:24] + bytes(4) + wav(tune)[28:]),
        (43, wav(tune)[:22] + bytes(2) + wav(tune)[24:]),
    ]
    found = {r.id: r for r in audio.search(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").collect()}
    assert found[24].class_id == 20 and found[20].class_size == 2
    matches = {m.class_id: m for m in found[20].matches}
    assert set(matches) == {21, 22}
    assert matches[21].offset == -12 and matches[21].bit_error < 0.05
    assert matches[22].offset == 0
    assert [found[i].class_id for i in (25, 26, 27, 41, 42, 43)] == [None] * 6
    assert found[40].class_id == 28 and found[40].matches == []
    assert audio.search(spark.createDataFrame([], "id bigint, media binary"), "id", "media").count() == 0


def test_warc_headers_and_members_against_plain_parsing():
    """Every header of the record and the response, repeated and folded ones too, and bodies of several members, against the lists they were made of."""
    import gzip
    import random
    import zlib

    rnd = random.Random(6)
    for _ in range(60):
        names = ["X-A", "Set-Cookie", "Link", "via", "X-A"]
        http = [(rnd.choice(names), [rnd.choice(["a=b", "c: d", "e, f", ""]) for _ in range(rnd.randint(1, 3))]) for _ in range(rnd.randint(0, 6))]
        warc_headers = [("WARC-Concurrent-To", f"<urn:{k}>") for k in range(rnd.randint(0, 3))]
        parts = [f"<p>part{k} {'x' * rnd.randint(0, 50)}</p>" for k in range(rnd.randint(1, 4))]
        body, packed = "".join(parts).encode(), rnd.random() < 0.7
        if packed:
            body = b"".join(gzip.compress(p.encode()) for p in parts) + b"\0" * rnd.randint(0, 3)
        lines = "".join(f"{k}: {v[0]}\r\n" + "".join(f"{rnd.choice([' ', chr(9)])}{x}\r\n" for x in v[1:]) for k, v in http)
        block = ("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + ("Content-Encoding: gzip\r\n" if packed else "") + lines + "\r\n").encode() + body
        data = warc.record([("WARC-Type", "response"), ("WARC-Target-URI", "http://a/"), *warc_headers], block)
        data = gzip.compress(data) if rnd.random() < 0.5 else data
        found = warc.derivatives(data)
        assert found["text"] == "\n".join(p[3:-4].strip() for p in parts)
        fields = [x.partition(": ")[::2] for x in warc.parse(found["metadata"])[1].decode().split("\r\n") if x]
        wanted = [(f"source-http-{k.lower()}", " ".join(" ".join(v).split())) for k, v in http if "".join(v)]
        assert [x for x in fields if x[0].startswith("source-http-") and x[0] not in ("source-http-status", "source-http-content-type", "source-http-content-encoding")] == wanted
        assert [v for k, v in fields if k == "source-warc-concurrent-to"] == [v for _, v in warc_headers]
    for bad in (gzip.compress(b"a") + b"junk", gzip.compress(b"abc")[:-9]):
        with pytest.raises(ValueError):
            warc.unpacked(bad, zlib.MAX_WBITS | 32)


def test_warc_charsets():
    for name, wanted in (("undefined", "é"), ("idna", "é"), ("punycode", "é"), ("unicode_escape", "é"), ("hex", "é"), ("rot13", "é"), ("nothing", "é"), ("UTF-8", "é"), ("'utf-8'", "é")):
        assert warc.derivatives(http_record(f"Content-Type: text/html; charset={name}", "<p>é</p>".encode()))["text"] == wanted
    assert warc.derivatives(http_record("Content-Type: text/html; charset=latin-1", "<p>é</p>".encode("latin-1")))["text"] == "é"


def plain_matches(a, b):
    """Every offset by itself."""
    found = []
    for d in range(-len(a) + 1, len(b)):
        p, q = a[max(0, -d) :], b[max(0, d) :]
        n = min(len(p), len(q))
        loud = int((~((p[:n] == audio.SILENT) & (q[:n] == audio.SILENT))).sum())
        wrong = int(np.bitwise_count(p[:n] ^ q[:n]).sum())
        if loud >= audio.MIN_OVERLAP and wrong <= 32 * audio.MAX_ERROR * loud:
            found.append((wrong / (32 * n), -n, d))
    return min(found) if found else None


def test_alignment_equals_brute_force():
    rnd = np.random.default_rng(8)
    steady, tone = np.full(60, 0x1234ABCD, np.uint32), np.full(45, 0x0F0F3355, np.uint32)
    left = [rnd.integers(0, 1 << 32, n, np.uint32) for n in (42,) * 30 + (16, 90, 300)] + [steady, np.r_[steady[:20], tone], np.full(50, audio.SILENT), np.full(15, 7, np.uint32)]
    right, planted = [], 0
    for i, x in enumerate(left):
        for share in (0.03, 0.1, 0.2, 0.24):
            cut = x[int(rnd.integers(0, max(1, len(x) - 40))) :]
            noise = (rnd.random((len(cut), 32)) < share) @ (1 << np.arange(32, dtype=np.uint64))
            right.append(np.r_[rnd.integers(0, 1 << 32, i % 7, np.uint32), cut ^ noise.astype(np.uint32)])
            planted += i < 30
    right += [steady[:33], tone[:20], np.full(70, audio.SILENT), np.r_[left[0], np.full(30, audio.SILENT)]]
    wanted = {(i, j): m for i, a in enumerate(left) for j, b in enumerate(right) if (m := plain_matches(a, b))}
    found = {(i, j): (e, -n, d) for i, j, d, _, n, e in audio.compare(left, right)}
    assert found == wanted
    assert sum((i, 4 * i + k) in found for i in range(30) for k in range(4)) >= 0.9 * planted


def test_groups_of_one_length_equal_brute_force_without_sums_for_each_pair(monkeypatch):
    """Groups of one length, of which two recordings share a number and of which they don't, groups of two lengths, and recordings in no group."""
    monkeypatch.setattr(audio, "GROUP", 5)
    rnd = np.random.default_rng(13)
    noisy = lambda x, share: x ^ ((rnd.random((len(x), 32)) < share) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32)
    left = [rnd.integers(0, 1 << 32, n, np.uint32) for n in (42,) * 9 + (60,) * 6 + (16,) * 6]
    left[3], left[4], left[12] = np.full(42, audio.SILENT), np.full(42, 0x1234ABCD, np.uint32), np.r_[left[0], np.full(18, audio.SILENT)]
    right = []
    for x in left:
        for share in (0.0, 0.2, 0.24, 0.26):
            moved = np.r_[rnd.integers(0, 1 << 32, 60, np.uint32), noisy(x, share), rnd.integers(0, 1 << 32, 60, np.uint32)]
            at = int(rnd.integers(60 - 26, 60 + max(1, len(x) - 15)))
            right.append(moved[at:][: (42, 60, 16)[len(right) % 3]])
    right += [np.full(42, audio.SILENT), np.full(60, 0x1234ABCD, np.uint32), ~left[0], ~left[16], left[5], noisy(left[17], 0.1)]
    wanted = {(i, j): m for i, a in enumerate(left) for j, b in enumerate(right) if (m := plain_matches(a, b))}
    votes = lambda i, j, d, n: int((left[i][max(0, -d) :][:n] == right[j][max(0, d) :][:n]).sum())
    with monkeypatch.context() as without:
        without.delattr(audio, "spectra")
        found = list(audio.compare(left, right))
    assert {(i, j): (e, -n, d) for i, j, d, _, n, e in found} == wanted and len(found) == len(wanted) > 40
    assert {len(left[i]) for i, _ in wanted} == {16, 42, 60} and len({(len(left[i]), len(right[j])) for i, j in wanted}) == 9
    assert all(v == votes(i, j, d, n) for i, j, d, v, n, _ in found)
    left, right = [*left, rnd.integers(0, 1 << 32, 50, np.uint32), np.full(9, 5, np.uint32)], [*right, rnd.integers(0, 1 << 32, 200, np.uint32)]
    right += [left[-2][:30], np.r_[left[-2], left[1]], np.full(300, audio.SILENT)]
    wanted = {(i, j): m for i, a in enumerate(left) for j, b in enumerate(right) if (m := plain_matches(a, b))}
    found = list(audio.compare(left, right))
    assert {(i, j): (e, -n, d) for i, j, d, _, n, e in found} == wanted and len(found) == len(wanted)


def test_fingerprints_of_several_recordings_equal_those_of_each():
    rnd = np.random.default_rng(14)
    frames = rnd.random((5, 40, 12))
    assert all((a == audio.fingerprint(x)).all() for a, x in zip(audio.fingerprints_of(frames), frames, strict=True))
    assert audio.fingerprints_of(frames[:, :15]).shape == (5, 0)
    assert (audio.fingerprints_of(np.zeros((2, 20, 12))) == audio.SILENT).all()


def test_near_vectors_sound_alike(spark):
    """Vectors, queries among them, with copies under noise of a twentieth and a tenth of their size: nothing that a plain comparison of all
    queries with all rows at every offset finds is missed, near copies match, and unrelated vectors do not."""
    rnd = np.random.default_rng(12)
    base = rnd.standard_normal((60, 64))
    rows = [(20 * i, v.tolist()) for i, v in enumerate(base)]
    rows += [(20 * i + 1, (v + rnd.standard_normal(64) * 0.05).tolist()) for i, v in enumerate(base)]
    rows += [(20 * i + 2, (v * 3 + rnd.standard_normal(64) * 0.3).tolist()) for i, v in enumerate(base)]
    rows += [(3, None), (4, []), (5, [float("nan"), float("inf"), None] * 30), (6, [0.0] * 64), (7, [1e308] * 64)]
    found = {r.id: r for r in audio.search(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v", audio.melody).collect()}
    prints = {i: audio.fingerprint(audio.chroma(*audio.melody(v))) for i, v in rows if v}
    wanted = {(i, j): m for i in prints if i % 20 == 0 for j in prints if j != i and (m := plain_matches(prints[i], prints[j]))}
    got = {(i, m.class_id): (round(m.bit_error, 6), m.offset) for i, r in found.items() if i % 20 == 0 for m in r.matches}
    assert got == {k: (round(e, 6), d) for k, (e, _, d) in wanted.items()}
    assert sum((20 * i, 20 * i + 1) in got for i in range(60)) >= 57
    assert sum((20 * i, 20 * i + 2) in got for i in range(60)) >= 45
    assert sum(i // 20 != j // 20 for i, j in got) <= 6
    assert found[3].class_id is None and found[4].n_prints == 0
    assert found[5].class_id == 5 and found[6].class_size >= 1 and found[7].n_prints == 42


def test_noisy_and_sustained_recordings_match(spark):
    rnd = np.random.default_rng(9)
    rows = []
    for i in range(20):
        x = rnd.integers(0, 1 << 32, 42, np.uint32)
        noise = (rnd.random((42, 32)) < 0.2) @ (1 << np.arange(32, dtype=np.uint64))
        rows += [(f"a{i}", True, x.astype(np.int64).tolist()), (f"b{i}", False, (x ^ noise.astype(np.uint32)).astype(np.int64).tolist())]
    rows += [("tone", True, [77] * 40), ("longer tone", False, [77] * 50)]
    found = {(r.query, r.other) for r in audio.align(spark.createDataFrame(rows, "class string, is_query boolean, prints array<bigint>")).collect()}
    assert found == {(f"a{i}", f"b{i}") for i in range(20)} | {("tone", "longer tone")}


def test_integral_image_filters_equal_plain_sums():
    frames = np.random.default_rng(7).random((40, 12))
    found = audio.fingerprint(frames)
    assert len(found) == 40 - audio.WIDTH + 1
    kind, low, high, time = next(f for f in audio.FILTERS if f[0] == 2)
    place = audio.FILTERS.index((kind, low, high, time))
    for at in range(5):
        p, q, half = low, min(12, low + high), time // 2
        value = frames[at : at + half, p:q].mean() - frames[at + half : at + time, p:q].mean()
        code = int(audio.GRAY[np.digitize(value, audio.LEVELS)])
        assert int(found[at]) >> 2 * (15 - place) & 3 == code


def test_stereo_and_other_rates():
    tune = audio.melody([0.1, 0.5, 0.9] * 20)[0]
    a = audio.fingerprint(audio.chroma(*audio.samples(wav(tune))))
    b = audio.fingerprint(audio.chroma(*audio.samples(wav(tune, channels=2))))
    assert len(a) and (a == b).mean() > 0.9


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    long = " ".join(f"wort{k % 97}x{k % 89}" for k in range(4000))
    rows = [*corpus(11, 20), (9001, "12 34 !"), (9002, "write to bob@site.org now, the on ing al"), (9003, "write  to bob@site.org now, the on ing al"), (9004, long), (9005, long.replace("wort1x", "other"))]
    # Different texts under one id, and a near copy without an id: each stage works on rows.
    rows += [(9005, "a twin of the text above, öre al thing on and on"), (9004, "and one of this, xal thon ingre al"), (None, long.replace("wort2x", "thing"))]
    table, full = frame(spark, rows, path)
    table.select("doc_id", "text", "lang", "source", "n_chars", "digest", "_row").write.parquet(str(path / "documents.parquet"))
    return str(path), full


def test_pipeline(spark, tables):
    """Every stage against plain Python on its own input."""
    from lodestone.io import written
    from tests.llm.test_dedup import by_row

    path, full = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, path), name)
        after = docs.collect()
        if name == "sequences":
            break
        assert docs.columns == columns
        kept = sorted(((r.doc_id, r.text) for r in after), key=repr)
        if name == "language":
            assert kept == sorted(((i, t) for i, t in before if t and any(map(str.isalpha, t))), key=repr)
        elif name == "exact_copies":
            plain = {}
            for i, t in sorted(before, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)):
                plain.setdefault("".join(t.split()), (i, t))
            assert kept == sorted(plain.values(), key=repr) and len(kept) < len(before)
        elif name == "near_copies":
            classes = by_row(before)
            assert kept == sorted((before[k] for k, (n, _, best) in classes.items() if not n or best == k), key=repr) and len(kept) < len(before)
        else:
            assert sorted(str(i) for i, _ in kept) == sorted(str(i) for i, _ in before)
            texts = {}
            for i, t in before:
                texts.setdefault(i, []).append(t)
            for r in after:
                assert r.n_chars == len(r.text) and "bob@" not in r.text
                assert any((r.text != t) == any(c in t for c in ("@", "abababab")) for t in texts[r.doc_id])
    last = {r.doc_id for r in after}
    assert last == {i for i, _ in before}
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect()) == sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in after)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    empty(spark, tmp_path).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
