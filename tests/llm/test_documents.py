"""Operators on documents: brute force, round trips, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, media_jpeg, minhash, mixing, packing, token_sst

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id long, pattern int, bucket string, score string"


def frame(spark, rows):
    """Documents with extra columns of names that operators use themselves."""
    rows = [(i, t, lang, s, len(t or ""), "x", 7, 1, "b", "s") for i, t, lang, s in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for k, t in enumerate(base[:6]):  # near and exact copies
        w = t.split(" ")
        w[5] = "changed"
        rows += [(100 + k, " ".join(w), "en", None), (200 + k, t, None, "s0")]
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, " \t\n", "en", "s1"), (303, "one", "en", "s2"), (304, "one", "en", "s2"), (305, "two words", "fr", "s2"), (305, "two words", "fr", "s2"), (None, "no identifier here", "en", "s0"), (306, "word " * 60_000, "en", "s9")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return frame(spark, odd).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# ------------------------------------------------------------------- op 1


def test_media_round_trip(docs, odd):
    got = media_jpeg.media_digests(docs).collect()
    assert len(got) == len(odd)
    texts = {i: t for i, t, *_ in odd if i is not None}
    for r in got:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        want = media_jpeg.padded(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want)) and len(want) % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        assert r.tensor_bytes == 3 * r.height * r.width
    by_text = {}
    for r in got:
        by_text.setdefault(texts.get(r.doc_id), set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for k, v in by_text.items() if k)


def test_media_empty(empty):
    assert media_jpeg.media_digests(empty).count() == 0


@pytest.mark.parametrize("n", [1, 191, 192, 193, 5000, 192 * 400])
def test_jpeg_symbols_and_arrays_agree(n, monkeypatch):
    data = media_jpeg.padded(random.Random(n).randbytes(n))
    image = media_jpeg.decode(media_jpeg.encode(data))
    assert media_jpeg.payload_of(image) == data
    monkeypatch.setattr(media_jpeg._Table, "known", {})
    made = media_jpeg._Table.of

    def by_symbol(counts, symbols):
        table = made(counts, symbols)
        table.only = None
        return table

    monkeypatch.setattr(media_jpeg._Table, "of", by_symbol)
    slow = media_jpeg.decode(media_jpeg.encode(data))
    for a, b in zip(image.components, slow.components, strict=True):
        assert (a.coefs == b.coefs).all()


def test_jpeg_inverse_transform_and_colour():
    image = media_jpeg.decode(media_jpeg.encode(media_jpeg.padded(b"q" * 3000)))
    c = image.components[0]
    block = np.zeros(64)
    block[media_jpeg.ZIGZAG] = c.coefs[0]
    k = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    want = np.clip(np.floor(k.T @ block.reshape(8, 8) @ k + 128.5), 0, 255)
    assert np.abs(image.planes()[0][:8, :8].astype(int) - want).max() <= 1
    y, cb, cr = (p.astype(float) for p in image.planes())
    rgb = image.rgb()
    assert rgb.shape == (image.height, image.width, 3)
    assert abs(int(rgb[3, 5, 0]) - np.clip(y[3, 5] + 1.402 * (cr[1, 2] - 128), 0, 255)) <= 1


def test_jpeg_refuses_broken_files():
    data = media_jpeg.encode(media_jpeg.padded(b"x" * 900))
    for bad in (b"", b"no image", data[: len(data) // 2], data.replace(b"\xff\xc2", b"\xff\xc0", 1)):
        with pytest.raises((ValueError, IndexError, KeyError)):
            media_jpeg.payload_of(media_jpeg.decode(bad))


class Progressive:
    """A plain encoder of progressive images, by the standard's procedures, to test the decoder:
    codes of several lengths, runs of ended blocks, restart intervals, any sampling and size."""

    def __init__(self, height, width, sampling, interval, r):
        self.h, self.w, self.interval, self.r = height, width, interval, r
        self.hs, self.vs = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.comps = []
        for h, v in sampling:
            rows, cols = -(-height // (8 * self.vs)) * v, -(-width // (8 * self.hs)) * h
            real = (-(-(-(-height * v // self.vs)) // 8), -(-(-(-width * h // self.hs)) // 8))
            coefs = np.zeros((rows, cols, 64), int)
            for y in range(rows):
                for x in range(cols):
                    coefs[y, x, 0] = r.randint(-500, 500)
                    if y < real[0] and x < real[1]:
                        for k in r.sample(range(1, 64), r.choice([0, 0, 1, 3, 20])):
                            coefs[y, x, k] = r.choice([-1, 1]) * r.choice([1, 1, 2, 3, 5, 17, 100])
            self.comps.append((h, v, rows, cols, real, coefs))
        self.out = b"\xff\xd8" + self.segment(0xDB, b"\x00" + bytes(r.randint(1, 20) for _ in range(64)))
        self.out += self.segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
        if interval:
            self.out += self.segment(0xDD, interval.to_bytes(2, "big"))

    @staticmethod
    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    def units(self, which):
        """Blocks of each MCU of a scan."""
        if len(which) == 1:
            *_, real, _ = self.comps[which[0]]
            return [[(which[0], y, x)] for y in range(real[0]) for x in range(real[1])]
        h0, v0, rows, cols, *_ = self.comps[which[0]]
        out = []
        for my in range(rows // v0):
            for mx in range(cols // h0):
                out.append([(c, my * self.comps[c][1] + j, mx * self.comps[c][0] + i) for c in which for j in range(self.comps[c][1]) for i in range(self.comps[c][0])])
        return out

    @staticmethod
    def bits_of(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def scan(self, which, lo, hi, high, low, emit):
        """``emit(chunk)`` gives (symbol or None, bits) of a restart interval's MCUs."""
        mcus = self.units(which)
        n = self.interval or len(mcus)
        chunks = [emit(mcus[i : i + n]) for i in range(0, len(mcus), n)]
        symbols = sorted({s for c in chunks for s, _ in c if s is not None}, key=lambda s: self.r.random())
        code = {}
        if symbols:
            for i, s in enumerate(symbols):  # three short codes, then long ones
                code[s] = format(i, "02b") if i < 3 else "11" + format(i - 3, "08b")
            counts = bytearray(16)
            counts[1], counts[9] = min(3, len(symbols)), max(0, len(symbols) - 3)
            if len(symbols) < 4:
                code = {s: format(i, "02b") for i, s in enumerate(symbols)}
            self.out += self.segment(0xC4, bytes([(0 if lo == 0 else 0x10)]) + bytes(counts) + bytes(symbols))
        self.out += self.segment(0xDA, bytes([len(which)]) + b"".join(bytes([c + 1, 0]) for c in which) + bytes([lo, hi, high << 4 | low]))
        for i, chunk in enumerate(chunks):
            bits = "".join((code[s] if s is not None else "") + b for s, b in chunk)
            bits += "1" * (-len(bits) % 8)
            raw = int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
            self.out += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + raw.replace(b"\xff", b"\xff\x00")

    def coef(self, c, y, x, k):
        return int(self.comps[c][5][y, x, k])

    def dc_first(self, which, low):
        def emit(mcus):
            last, out = {}, []
            for m in mcus:
                for c, y, x in m:
                    v = self.coef(c, y, x, 0) >> low
                    n, b = self.bits_of(v - last.get(c, 0))
                    last[c] = v
                    out.append((n, b))
            return out

        self.scan(which, 0, 0, 0, low, emit)

    def dc_refine(self, which, low):
        self.scan(which, 0, 0, low + 1, low, lambda mcus: [(None, str(self.coef(c, y, x, 0) >> low & 1)) for m in mcus for c, y, x in m])

    @staticmethod
    def ended(run, more=""):
        n = run.bit_length() - 1
        return (n << 4, (format(run - (1 << n), f"0{n}b") if n else "") + more)

    def ac_first(self, c, lo, hi, low):
        cut = lambda v: (abs(v) >> low) * (1 if v > 0 else -1)

        def emit(mcus):
            out, run = [], 0
            for ((_, y, x),) in mcus:
                zeros = 0
                for k in range(lo, hi + 1):
                    v = cut(self.coef(c, y, x, k))
                    if not v:
                        zeros += 1
                        continue
                    if run:
                        out.append(self.ended(run))
                        run = 0
                    while zeros > 15:
                        out.append((0xF0, ""))
                        zeros -= 16
                    n, b = self.bits_of(v)
                    out.append((zeros << 4 | n, b))
                    zeros = 0
                run += zeros > 0
            if run:
                out.append(self.ended(run))
            return out

        self.scan([c], lo, hi, 0, low, emit)

    def ac_refine(self, c, lo, hi, low):
        def emit(mcus):
            out, run, held = [], 0, ""
            for ((_, y, x),) in mcus:
                size = [abs(self.coef(c, y, x, k)) >> low for k in range(64)]
                last = max((k for k in range(lo, hi + 1) if size[k] == 1), default=0)
                zeros, bits = 0, ""
                for k in range(lo, hi + 1):
                    if not size[k]:
                        zeros += 1
                        continue
                    while zeros > 15 and k <= last:
                        if run:
                            out.append(self.ended(run, held))
                            run, held = 0, ""
                        out.append((0xF0, bits))
                        zeros, bits = zeros - 16, ""
                    if size[k] > 1:
                        bits += str(size[k] & 1)
                        continue
                    if run:
                        out.append(self.ended(run, held))
                        run, held = 0, ""
                    out.append((zeros << 4 | 1, ("1" if self.coef(c, y, x, k) > 0 else "0") + bits))
                    zeros, bits = 0, ""
                if zeros or bits:
                    run, held = run + 1, held + bits
            if run:
                out.append(self.ended(run, held))
            return out

        self.scan([c], lo, hi, low + 1, low, emit)


@pytest.mark.parametrize(("size", "sampling", "interval"), [((45, 61), [(2, 2), (1, 1), (1, 1)], 3), ((17, 70), [(2, 1), (1, 1), (1, 1)], 0), ((40, 33), [(1, 1)], 2), ((8, 8), [(1, 2), (1, 1), (1, 1)], 1)])
def test_jpeg_of_another_encoder(size, sampling, interval):
    """Spectral selection and successive approximation with mixed codes, restarts and odd sizes."""
    e = Progressive(*size, sampling, interval, random.Random(size[0]))
    n = len(sampling)
    e.dc_first(list(range(n)), 1)
    e.ac_first(0, 1, 5, 2)
    for c in range(1, n):
        e.ac_first(c, 1, 63, 1)
    e.ac_first(0, 6, 63, 2)
    e.ac_refine(0, 1, 63, 1)
    e.dc_refine(list(range(n)), 0)
    for c in range(1, n):
        e.ac_refine(c, 1, 63, 0)
    e.ac_refine(0, 1, 63, 0)
    image = media_jpeg.decode(e.out + b"\xff\xd9")
    assert (image.height, image.width) == size
    for got, (*_, coefs) in zip(image.components, e.comps, strict=True):
        assert (got.coefs == coefs.reshape(-1, 64)).all()
    assert image.rgb().shape == (*size, 3)


def test_jpeg_zigzag():
    assert media_jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media_jpeg.ZIGZAG) == list(range(64))


# ------------------------------------------------------------------- op 2


def tokenizer_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_tables(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tables = token_sst.write_tables(docs, f"{tmp_path}/t", tokenizer_path())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_sst.read_tables(tables).collect())
    at, want = 0, []
    for i, t, *_ in sorted(odd, key=lambda r: -1 if r[0] is None else r[0]):  # the only repeated rows are equal
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((-1 if i is None else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    hits = 0
    for r in tables.collect():
        reader = token_sst.TableReader(r.uri)
        for i in (0, 303, None):
            found = reader.get(i)
            hits += len(found)
            assert all(f[-1] == 2 for f in found)
        assert reader.get(-5) == [] and len(reader.get(305)) in (0, 2)
        reader.close()
    assert hits == 3


def test_token_tables_empty(empty, tmp_path):
    tables = token_sst.write_tables(empty, f"{tmp_path}/t", tokenizer_path())
    assert tables.count() == 0 and token_sst.read_tables(tables).count() == 0


def test_encoder_matches_whole_texts():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    enc, r = token_sst.Encoder(tokenizer_path()), random.Random(5)
    texts = ["", " ", "  a  b", "a\n b ", "x\x1c y", "it's 12,3 \n\n z", "é 日本 😀 x", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "a <|endoftext| > b"]
    texts += ["".join(r.choice(["a", "B", " ", " ", "\n", ",", "'s", "é", "1", "Ġ", "\x85", "​", *(["<|endoftext|>"] if k % 4 == 0 else [])]) for _ in range(40)) for k in range(400)]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    assert enc.encode(texts) == want and enc.encode(texts) == want
    assert np.frombuffer(enc.encode(["a <|endoftext|> b"])[0], enc.dtype).tolist() == [64, 220, 50256, 275]


def test_one_identifier_over_several_tables(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text number {i}") for i in range(200)] + [(9, "last"), (1, None)], "doc_id long, text string")
    tables = token_sst.write_tables(docs, f"{tmp_path}/t", tokenizer_path(), partitions=4)
    assert tables.where("entries > 20").count() > 1
    got = sorted(token_sst.read_tables(tables).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1] + [7] * 200 + [9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    readers = [token_sst.TableReader(r.uri) for r in tables.collect()]
    assert sum(len(x.get(7)) for x in readers) == 200
    for x in readers:
        x.close()


def test_table_blocks_and_filter(tmp_path):
    w = token_sst.TableWriter(2)
    items = [(token_sst.key_of(i * 3), np.arange(i % 500, dtype="<u2").tobytes()) for i in range(-1000, 1000)]
    from quillgraph.llm.shared import put_file

    put_file(f"{tmp_path}/t", w.chunks(items))
    t = token_sst.TableReader(f"{tmp_path}/t")
    assert len(t.index) > 5 and t.entries == 2000
    assert [k for k, _ in t.scan()] == [i * 3 for i in range(-1000, 1000)]
    assert all(len(t.get(i * 3)[0]) == i % 500 for i in range(-1000, 1000, 37))
    wrong = sum(t.may_hold(i * 3 + 1) for i in range(-1000, 1000))
    assert wrong < 100 and not any(t.get(i * 3 + 1) for i in range(-1000, 1000, 41))
    t.close()
    with pytest.raises(ValueError):
        list(token_sst.TableWriter(2).chunks([(b"b", b""), (b"a", b"")]))


# ------------------------------------------------------------------- op 3


def brute(rows, size, percent):
    sets, ids = [], []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
        ids.append(i)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if None not in (ids[a], ids[b]) and inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(root(i))) for i, s in zip(ids, sets, strict=True))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, odd, size):
    got = minhash.near_duplicates(docs, size=size).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(odd, size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group far larger than what is compared as pairs, without a common centre."""
    made = minhash.in_blocks
    used = []
    monkeypatch.setattr(minhash, "in_blocks", lambda *a: used.append(1) or made(*a))
    r = random.Random(9)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([4, 9, 14])):
            w[r.randrange(len(w))] = f"n{i}x{r.randrange(1000)}"
        rows.append((i, " ".join(w), "en", "s"))
    monkeypatch.setattr(minhash, "FEW", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = minhash.near_duplicates(frame(spark, rows), size=2).collect()
    assert used
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 2, 80)


def test_passages_in_common_do_not_meet_in_blocks(spark, monkeypatch):
    """Members of one band that share half of their words: none is linked, each is a few rows, no blocks are made."""
    r = random.Random(10)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"o{i}x{k}" for k in range(50)]), "en", "s") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s") for i in range(20)]
    monkeypatch.setattr(minhash, "FEW", 8)
    monkeypatch.setattr(minhash, "in_blocks", lambda *a: pytest.fail("no group is large"))
    got = minhash.near_duplicates(frame(spark, r.sample(rows, len(rows))), size=2).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 2, 80)


def test_prefixes_lose_no_pair(spark):
    """Candidates by prefix hold all pairs of enough similarity, whatever the order of the shingles."""
    r = random.Random(11)
    sets = [sorted({r.randrange(60) for _ in range(r.randint(1, 25))}) for _ in range(120)]
    sets += [sorted({*s[1:], 70 + k}) for k, s in enumerate(sets[:60]) if len(s) > 3]
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "id long, n long, shingles array<long>")
    left = df.selectExpr("id", "id as component", "n", "0L as s1", "0L as s2")
    pairs, crowds = minhash.by_prefix(left, df, 80)
    got = {tuple(x) for x in pairs.collect()}
    for same in {x.band: None for x in crowds.collect()}:
        own = sorted(x.id for x in crowds.collect() if x.band == same)
        got |= {(a, b) for a in own for b in own if a < b}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(i := set(sets[a]) & set(sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(i))}
    assert len(want) > 20 and want <= got


def test_shingles_in_common_are_counted_once(spark):
    """Members that lie in many files: what they have in common makes a row of ``count`` once, not once a file."""
    sets = [sorted({*range(400), *range(1000 + 5 * i, 1005 + 5 * i)}) for i in range(96)]
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "id long, n long, shingles array<long>")
    left = df.selectExpr("id", "id as component", "n", "0L as s1", "0L as s2")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        minhash.by_prefix(left, df, 80)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = 0
    for x in range(before, store.executionsCount()):
        run = store.executionsList(x, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "MapInArrow" and "count(" in node.desc():
                rows = [m.accumulatorId() for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows"]
                made += sum(int(values.apply(r).replace(",", "")) for r in rows if values.contains(r))
    assert 0 < made <= 400 + 96 * 5, made


def test_one_identifier_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (7, b, "en", "s")]
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {3}


def test_near_duplicates_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:800], r.integers(0, 1 << 63, 200, dtype=np.uint64)))
    share = (minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).mean()
    assert abs(share - 800 / 1200) < 0.15


# ------------------------------------------------------------------- op 5


def fill(sizes, weights, total, most):
    """Water filling by bisection, another way than the operator's."""
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(most * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total:
            lo = mid
        else:
            hi = mid
    return [min(most * s, w * hi) for s, w in zip(sizes, weights, strict=True)]


def test_mixing(docs, odd):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(odd)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for *_, s in odd if s is not None}) + [None]
    sizes = [sum(words(t) for _, t, _, s in odd if s == n) for n in names]
    want = fill(sizes, [1 + i % 3 for i in range(len(names))], sum(sizes), 3)
    for n, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in got if r.source == n]
        assert all(r.source_size == size and abs(r.target - target) < 1e-3 for r in own)
        assert all(r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    key = lambda rs: sorted((str(r.doc_id), r.taken) for r in rs)
    assert key(got) == key(mixing.mix_report(docs).collect())


def test_mixing_empty(empty):
    assert mixing.mix_report(empty).count() == 0


def test_flow_prefers_fewer_repeats():
    # pattern 0 is in both sources, 1 and 2 in one each
    flow = mixing.min_cost_flow([100, 50, 10], [[0, 1], [0], [1]], [120, 60])
    sent = [sum(f.values()) for f in flow]
    assert sum(f.get(0, 0) for f in flow) == 120 and sum(f.get(1, 0) for f in flow) == 60
    # 160 words are there once; the other 20 are second uses
    assert sum(max(0, x - s) for x, s in zip(sent, [100, 50, 10], strict=True)) == 20
    assert mixing.min_cost_flow([10], [[0]], [100]) == [{0: 30}]


def brute_flow(supply, members, quota, repeats=3):
    """Size and cost of a least-cost largest flow, word by word along cheapest paths."""
    left, room, use, sent = [], list(quota), [0] * len(supply), [[0] * len(quota) for _ in supply]
    while True:
        best = None
        for p in range(len(supply)):
            if use[p] == supply[p] * repeats:
                continue
            seen, queue = {("p", p): None}, [("p", p)]
            while queue:
                kind, x = queue.pop(0)
                near = [("s", y) for y in members[x]] if kind == "p" else [("p", q) for q in range(len(supply)) if sent[q][x]]
                for y in near:
                    if y not in seen:
                        seen[y] = (kind, x)
                        queue.append(y)
            ends = [s for s in range(len(quota)) if ("s", s) in seen and room[s]]
            cost = use[p] // supply[p]
            if ends and (best is None or cost < best[0]):
                best = (cost, p, ends[0], seen)
        if best is None:
            return sum(use), left
        cost, p, s, seen = best
        left.append(cost)
        room[s] -= 1
        use[p] += 1
        at = ("s", s)
        while seen[at] is not None:
            up = seen[at]
            if at[0] == "s":
                sent[up[1]][at[1]] += 1
            else:
                sent[at[1]][up[1]] -= 1
            at = up


def test_flow_by_brute_force():
    r = random.Random(12)
    for _ in range(60):
        n_p, n_s = r.randint(1, 5), r.randint(1, 4)
        supply = [r.randint(1, 6) for _ in range(n_p)]
        members = [sorted(r.sample(range(n_s), r.randint(1, n_s))) for _ in range(n_p)]
        quota = [r.randint(0, 15) for _ in range(n_s)]
        flow = mixing.min_cost_flow(supply, members, quota)
        size, costs = brute_flow(supply, members, quota)
        sent = [sum(f.values()) for f in flow]
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quota))
        assert all(set(f) <= set(m) for f, m in zip(flow, members, strict=True))
        assert sum(sent) == size
        assert sum(sum(min(k, x // w) for k in [0]) + sum(max(0, min(x - k * w, w)) * k for k in range(3)) for x, w in zip(sent, supply, strict=True)) == sum(costs)


def test_flow_over_many_patterns():
    import time

    r, n = random.Random(3), 20_000
    supply = [r.randint(1, 1000) for _ in range(n)]
    members = [sorted({r.randrange(n // 4), r.randrange(n // 4), r.randrange(n // 4)}) for _ in range(n)]
    quota = [r.randint(0, 6000) for _ in range(n // 4)]
    began = time.time()
    flow = mixing.min_cost_flow(supply, members, quota)
    assert time.time() - began < 120 and all(sum(f.values()) <= 3 * w for f, w in zip(flow, supply, strict=True))


def test_mixing_of_rows_that_share_an_identifier(spark):
    for ids in ([None] * 600, [7] * 600):
        rows = [(i, "ten words " * 5, "en", "a") for i in ids] + [(1000 + k, "w " * 20, "en", "b") for k in range(100)]
        got = mixing.mix_report(frame(spark, rows).repartition(5, "doc_id")).collect()
        assert len(got) == 700
        own = [r for r in got if r.source == "a"]
        assert len({r.taken for r in own}) == 2 and abs(sum(r.taken for r in own) - own[0].target) <= 10
        assert abs(sum(r.taken for r in got) - 8000) <= 30


def test_mixing_of_many_sources(spark):
    rows = spark.range(30_000).selectExpr("id as doc_id", "1 + id % 7 as words", "array('s' || pmod(hash(id), 25000), 's' || id % 5) as sources")
    got, sources = mixing.mixed(rows, F.col("words"), F.col("sources"))
    assert len(sources) > 15_000 and got.count() == 30_000 and got.agg(F.max("repeats")).first()[0] <= 3


def test_overlapping_sources(spark):
    rows = spark.createDataFrame([(i, 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None]) for i in range(300)], "doc_id long, words long, sources array<string>")
    got, sources = mixing.mixed(rows, F.col("words"), F.col("sources"))
    assert set(sources) == {(False, "a"), (False, "b"), (True, "")}
    odd = rows.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(("part", "at", "h_", "some", "all_", "cut", "last", "times", "a.b"))])
    assert mixing.mixed(odd, F.col("words"), F.col("sources"))[0].columns == [*odd.columns, "size", "pattern", "repeats"]
    assert got.agg(F.max("repeats")).first()[0] <= 3 and got.count() == 300


# ------------------------------------------------------------------- op 8


def test_language(spark):
    r = random.Random(2)
    words = {"en": "the and of with tion ing that from".split(), "fr": "le la des eaux que pour dans une".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang, "s") for i in range(200) for lang in [("en", "fr")[i % 2]]]
    rows += [(900, None, "en", "s"), (901, "12 34 !!", "fr", "s"), (902, "", None, None), (None, "the and of", "en", "s"), (903, "THE AND OF " * 20_000, None, "s")]
    got = langid.identify(frame(spark, rows)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == lang for i, t, lang, _ in rows[:200])
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "en" and by[None].lang_pred == "en" and not by[None].held_out
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    assert all(0 <= x.score <= 1 for x in got)
    shuffled = langid.identify(frame(spark, [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "xx", s) for i, t, lang, s in rows]))
    assert {(x.doc_id, x.lang_pred) for x in shuffled.collect()} == {(x.doc_id, x.lang_pred) for x in got}


def test_language_by_brute_force(spark):
    """Profiles, out-of-place distances and predictions by their definition."""
    r = random.Random(8)
    alphabets = {"aa": "abcde fgh", "bb": "cdefg hij", "cc": "xyzab cde"}
    rows = [(i, "".join(r.choice(alphabets[lang]) for _ in range(r.randint(1, 120))), lang, "s") for i in range(150) for lang in [("aa", "bb", "cc")[i % 3]]]
    got = {x.doc_id: x for x in langid.identify(frame(spark, rows)).collect()}

    def grams(text):
        out = {}
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = f"\x01{w}\x01"
            for g in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]:
                out[g] = out.get(g, 0) + 1
        return out

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    ranked = lambda counts: sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.LENGTH]
    profiles = {}
    for lang in alphabets:
        total = {}
        for i, t, own, _ in rows:
            if own == lang and zlib.crc32(str(i).encode()) % 4 != 2:
                for g, n in grams(t).items():
                    total[g] = total.get(g, 0) + n
        profiles[lang] = {g: k for k, g in enumerate(ranked(total))}
    for i, t, *_ in rows:
        own = ranked(grams(t))
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        apart = {lang: sum(abs(p[g] - k) if g in p else langid.LENGTH for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=lambda x: apart[x])
        assert got[i].lang_pred == best and abs(got[i].score - (1 - apart[best] / (len(own) * langid.LENGTH))) < 1e-12


def test_language_empty(empty):
    assert langid.identify(empty).count() == 0


def test_ngrams_by_brute_force():
    import pyarrow as pa

    texts = ["Ab a!", None, "éa  b2c", "", "123", "x"]

    def want(t):
        words, out = re.findall(r"[^\W\d_]+", (t or "").lower()), {}
        for w in words:
            p = f"\x01{w}\x01"
            for g in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]:
                k = 0
                for c in g:
                    k = k << 21 | ord(c)
                out[k] = out.get(k, 0) + 1
        return out

    for t, (keys, counts) in zip(texts, langid.ngram_runs(pa.array(texts)), strict=True):
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want(t)


# ------------------------------------------------------------------ op 10


def test_boundaries_by_brute_force():
    from itertools import combinations

    r = random.Random(4)
    for _ in range(30):
        n = r.randint(1, 9)
        lengths = np.array(sorted(r.sample(range(1, 60), n)))
        counts = np.array([r.randint(1, 9) for _ in range(n)])
        k = r.randint(1, 4)

        def cost(ends, lengths=lengths, counts=counts):
            return sum(min(e for e in ends if e >= x) * c for x, c in zip(lengths, counts, strict=True))

        ends = packing.boundaries(lengths, counts, k)
        best = min(cost([*c, lengths[-1]]) for j in range(min(k, n)) for c in combinations(lengths[:-1].tolist(), j))
        assert len(ends) <= k and cost(ends) == best


def test_packing(docs, odd):
    rows = docs.select("doc_id", "size", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("words"))
    got = packing.packed(rows, F.col("words"), n_buckets=4, budget=2000).collect()
    assert len(got) == len(odd)
    seats = [(r.bucket, r.batch, r.slot) for r in got]
    assert len(set(seats)) == len(seats)
    for r in got:
        assert r.length <= r.bucket_length
        assert r.slot < max(1, 2000 // max(1, r.bucket_length))
    for b in {r.bucket for r in got}:
        batches = {r.batch for r in got if r.bucket == b}
        assert batches == set(range(len(batches)))


def test_packing_empty(empty):
    assert packing.pack_report(empty).count() == 0


def test_long_histogram(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") * 1000).alias("words"))
    lengths, counts = packing.histogram(rows.select(F.col("words").alias("length")), 100)
    assert len(lengths) <= 101 and counts.sum() == 1000 and lengths[-1] >= 999_000


def test_a_very_long_document_leaves_the_other_buckets_exact(spark):
    sizes = [*range(1, 200), 1_000_000]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, words long")
    got = packing.packed(rows, F.col("words"), n_buckets=4).collect()
    want = packing.boundaries(np.array(sizes), np.ones(len(sizes), np.int64), 4)
    assert sorted({r.bucket_length for r in got}) == want and want[-1] == 1_000_000
    for b in {r.bucket for r in got}:
        assert max(r.length for r in got if r.bucket == b) == next(r.bucket_length for r in got if r.bucket == b)


def test_all_distinct_lengths_are_kept(spark):
    lengths, counts = packing.histogram(spark.range(70_000).select(F.col("id").alias("length")))
    assert len(lengths) == 70_000 and counts.sum() == 70_000 and lengths[-1] == 69_999
