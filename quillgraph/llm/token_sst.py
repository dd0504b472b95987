"""Operator 2: token ids in sorted-string-table shards.

Documents are range-partitioned by identifier, encoded and written as one
immutable table a partition.  Layout of a table, integers little-endian::

    data block *     zstd-compressed entries, each
                       varint shared   bytes of the key shared with the entry before
                       varint rest     further bytes of the key
                       varint size     bytes of the value
                       key bytes, value bytes (ids as u16 or u32)
    Bloom filter     bits of all keys
    index            per data block: u16 size of its last key, the key,
                       u64 offset, u32 stored size, u32 entries
    footer (64 B)    u64 offsets and sizes of filter and index, u64 entries,
                       u64 ids, u32 hashes of the filter, u32 bytes an id, 8 B magic

Keys are 8 bytes, big-endian with the sign bit flipped, so that byte order is
numeric order; the key of a null identifier is empty and sorts first.  A lookup
asks the filter, bisects the index and scans one block.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, open_file, put_file, slices, written

MAGIC = b"QSSTABL2"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 64 << 10
BITS_PER_KEY = 10
N_HASHES = 7
#: Words whose ids a Python worker remembers at most; then it keeps the half that it
#: met first, among them nearly all frequent ones.
CACHE_WORDS = 1_000_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, n_bits: int, n_hashes: int) -> list[int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    a, b = struct.unpack("<QQ", h)
    return [(a + i * (b | 1)) % n_bits for i in range(n_hashes)]


class TableWriter:
    """Byte chunks of a table from entries in ascending key order."""

    def __init__(self, id_bytes: int):
        self.id_bytes, self.entries, self.ids, self.at = id_bytes, 0, 0, 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []

    def chunks(self, items: Iterable[tuple[bytes, bytes]]) -> Iterator[bytes]:
        block, last, n = bytearray(), b"", 0
        for key, value in items:
            if self.keys and key < self.keys[-1]:
                raise ValueError("keys must ascend")
            shared = 0
            if n:
                most = min(len(key), len(last))
                while shared < most and key[shared] == last[shared]:
                    shared += 1
            block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
            last, n = key, n + 1
            self.keys.append(key)
            self.entries += 1
            self.ids += len(value) // self.id_bytes
            if len(block) >= BLOCK_BYTES:
                yield self._block(block, last, n)
                block, n = bytearray(), 0
        if n:
            yield self._block(block, last, n)
        n_bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        bits = np.zeros(n_bits, np.uint8)
        for key in self.keys:
            bits[_probes(key, n_bits, N_HASHES)] = 1
        bloom = np.packbits(bits, bitorder="little").tobytes()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QII", *x) for k, *x in self.index)
        yield bloom
        yield index
        yield FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.entries, self.ids, N_HASHES, self.id_bytes, MAGIC)

    def _block(self, block: bytearray, last: bytes, n: int) -> bytes:
        stored = self.pack.compress(bytes(block))
        self.index.append((last, self.at, len(stored), n))
        self.at += len(stored)
        return stored


class TableReader:
    """Point lookups and ordered scans of one table."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        self.unpack = zstandard.ZstdDecompressor()
        self.file.seek(0, 2)
        self.file.seek(self.file.tell() - FOOTER.size)
        b_at, b_size, i_at, i_size, self.entries, self.ids, self.n_hashes, self.id_bytes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token table")
        self.dtype = np.dtype("<u2" if self.id_bytes == 2 else "<u4")
        self.file.seek(b_at)
        self.bloom = self.file.read(b_size)
        self.file.seek(i_at)
        raw, at, self.index = self.file.read(i_size), 0, []
        while at < len(raw):
            (k,) = struct.unpack_from("<H", raw, at)
            self.index.append((raw[at + 2 : at + 2 + k], *struct.unpack_from("<QII", raw, at + 2 + k)))
            at += 18 + k
        self.last_keys = [x[0] for x in self.index]

    def close(self) -> None:
        self.file.close()

    def _entries(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size, n = self.index[i]
        self.file.seek(offset)
        raw, at, key = self.unpack.decompress(self.file.read(size)), 0, b""
        for _ in range(n):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), 8 * len(self.bloom), self.n_hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry of that identifier."""
        key, out = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return out
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.index)):
            for k, v in self._entries(i):
                if k == key:
                    out.append(np.frombuffer(v, self.dtype))
                elif k > key:
                    return out
        return out

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for k, v in self._entries(i):
                yield id_of(k), np.frombuffer(v, self.dtype)


class Encoder:
    """``Tokenizer.encode`` of whole texts, with the ids of words remembered.

    The byte-level pre-tokenizer always breaks before a single space that
    stands between two other characters, on both sides of a single line feed
    between such, and between letters and whatever else: so the pieces between
    them can be encoded one by one, each distinct one once.  Texts that hold an
    added token, such as the end of a text, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # does not look for added tokens, for texts that hold none
        self.plain.encode_special_tokens = True
        pre = self.tok.pre_tokenizer
        self.by_word = self.tok.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        self.id_bytes = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.id_bytes == 2 else "<u4")
        #: Ids of pieces, and of the single characters that end them.
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if self.by_word:
            self.letters = Tokenizer.from_file(path)  # for words of letters alone, which need no pattern
            self.letters.encode_special_tokens = True
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.after_space = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.after_space[[i for w, i in vocab.items() if w.startswith("\u0120")]] = True  # how byte-level vocabularies write a space
        self.line_feeds = np.zeros(len(self.after_space), bool)
        self.line_feeds[[i for w, i in vocab.items() if w == "\u010a"]] = True  # and a line feed

    def _ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, tokenizer, words: list[str], starts: np.ndarray, glue: str) -> None:
        """Remembers the ids of words that hold no white space but their line feed.

        Many are encoded at once as one text and cut at the tokens that start a
        word: with a space, or with the line feed.
        """
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            ids = np.array(tokenizer.encode_batch_fast([glue + glue.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(starts[ids])
            if len(cuts) == len(part):
                raw, ends = ids.tobytes(), [*(cuts * self.id_bytes).tolist(), len(ids) * self.id_bytes]
                self.known.update(zip(part, [raw[a:b] for a, b in pairwise(ends)], strict=True))
            else:
                self.known.update(zip(part, self._ids(self.plain, [glue + w for w in part]), strict=True))

    def learn(self, new: set[str]) -> None:
        """Remembers the ids of pieces as they are in a text."""
        known, bare = self.known, self.bare
        letters = [w for w in new if w.isalpha()]
        first, lines, ended, others = [], [], [], []
        for w in new.difference(letters):
            if w[0] == FIRST:
                first.append(w)
            elif w[0] == "\n":
                lines.append(w)
            elif w[:-1].isalpha():
                ended.append(w)
            else:
                others.append(w)
        stems = {w[:-1] for w in ended}.difference(known, letters)
        self._learn(self.letters, letters + list(stems), self.after_space, " ")
        self._learn(self.plain, others, self.after_space, " ")
        self._learn(self.plain, lines, self.line_feeds, "")
        known.update(zip(first, self._ids(self.plain, [w[1:] for w in first]), strict=True))
        ends = list({w[-1] for w in ended}.difference(bare))
        bare.update(zip(ends, self._ids(self.plain, ends), strict=True))
        known.update((w, known[w[:-1]] + bare[w[-1]]) for w in ended)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD) if self.by_word else pa.array([True] * len(texts), pa.bool_())
        for x in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(odd.tolist(), self._ids(self.tok, texts.take(pa.array(odd)).to_pylist()), strict=True):
            out[i] = ids
        rest = np.setdiff1d(np.arange(len(texts)), odd)
        if not len(rest):
            return out
        mark, none = (pa.scalar(x, pa.large_string()) for x in (FIRST, ""))
        some = pc.binary_join_element_wise(mark, texts.take(pa.array(rest)), none)
        parts = pc.split_pattern(pc.replace_substring(some, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, words))
        new = {w for w, x in zip(words, ids, strict=True) if x is None}
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))
            self.learn(new)
            known = self.known
            ids = [known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        _, ends, data = flat.buffers()
        ends = np.frombuffer(ends, np.int64, len(flat) + 1, flat.offset * 8)[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        data = memoryview(data) if data is not None else b""
        for i, a, b in zip(rest.tolist(), ends[:-1], ends[1:], strict=True):
            out[i] = bytes(data[a:b])
        return out


#: Stands before the first piece of a text, before which no space stood.
FIRST = "\x01"
_OTHERS = r"\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with white space other than single spaces and line feeds between other
#: characters, or with the mark above, are encoded whole.
ODD = rf"[{_OTHERS} \n][{_OTHERS} \n]|^[ \n]|[ \n]$|[{_OTHERS}]|\x01"
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tables(docs: DataFrame, to: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, partitions: int | None = None) -> DataFrame:
    """Encodes documents and writes them as tables in ascending order of identifier.

    ``end_id`` is appended to each document.  Returns one row a table: shard
    (its place in the order), uri, entries, ids, bytes.  Null text counts as
    empty; null identifiers come first; rows that share an identifier are kept
    side by side, in the order of a hash of their text, by which a very common
    identifier is also dealt over several tables; a text of any length is one
    entry; further columns, whatever their names, are ignored; an empty input
    gives no table.  File names hold the attempt, and only those
    named in the returned (written) rows count, so that a task that runs twice
    after the loss of an executor does no harm.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.col("h")]
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        shard, enc, count = ctx.partitionId(), encoder(tokenizer), [0]
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()

        def items() -> Iterator[tuple[bytes, bytes]]:
            for b in batches:
                for part in slices(b, "t", 8 << 20):
                    for k, v in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                        count[0] += 1
                        yield key_of(k), v + end

        it = items()
        head = next(it, None)
        if head is None:
            return
        table = TableWriter(enc.id_bytes)
        uri = f"{to}/tokens-{shard:06d}-{ctx.taskAttemptId()}.qsst"
        size = put_file(uri, table.chunks(x for part in ([head], it) for x in part))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, "entries": table.entries, "ids": table.ids, "bytes": size}], schema=_SUMMARY)

    return written(rows.mapInArrow(write, "shard int, uri string, entries long, ids long, bytes long"), "token-tables")


_SUMMARY = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def starts(tables: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all tables before.  One small row a table is
    sorted here, not the documents."""
    from pyspark.sql import Window

    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return tables.withColumn("start", F.coalesce(F.sum("ids").over(w), F.lit(0)))


def read_tables(tables: DataFrame) -> DataFrame:
    """Reads tables back, a task a table: doc_id, start, n_tokens, ids_crc32."""
    n = tables.sparkSession.sparkContext.defaultParallelism

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at, t = row["start"], TableReader(row["uri"])
                for some in batched(t.scan(), 5000):
                    n = np.array([len(ids) for _, ids in some], np.int64)
                    start = at + np.cumsum(n) - n
                    at += int(n.sum())
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in some]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], schema=_DIGEST)
                t.close()

    spread = starts(tables).repartition(max(n, 4 * n), "uri")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    to = new_path(spark, "token-sst")
    return read_tables(write_tables(docs, to, public_tokenizers.path("byte_bpe_50k.json")))
