"""Token-ID output as length-delimited binary records with masked checksums and an offset index.

A record is: length (u64), masked CRC-32C of the length (u32), payload, masked CRC-32C of the
payload (u32), all little-endian. The payload is the document's id (i64) followed by its token
ids, two bytes each where the vocabulary allows it, else four. Each shard ``part-N.rec`` has an
index ``part-N.idx`` of (document id i64, offset u64, tokens before it in the shard u64, tokens u32).
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.shared import slices

#: Fixed values of the record format.
MASK_DELTA = 0xA282EAD8
CRC32C_POLY = 0x82F63B78

BLOCK = 64
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("start", "<u8"), ("n_tokens", "<u4")])


def _byte_table() -> np.ndarray:
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, reg >> 1 ^ np.uint32(CRC32C_POLY), reg >> 1)
    return reg


TABLE = _byte_table()


def _apply(op: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given as four tables by byte."""
    return op[0][crc & 0xFF] ^ op[1][crc >> 8 & 0xFF] ^ op[2][crc >> 16 & 0xFF] ^ op[3][crc >> 24]


def _advances() -> list[np.ndarray]:
    """Maps that advance a register by 2**i zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    one = np.stack([TABLE, byte << 0, byte << 8, byte << 16])  # a zero byte: table of the low byte, the rest moves down
    ops = [one]
    for _ in range(39):
        ops.append(np.stack([_apply(ops[-1], t) for t in ops[-1]]))
    return ops


ADVANCE = _advances()


def crc32c_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of spans of a byte array, all side by side: blocks of 64 bytes first, then their sums."""
    n = len(lengths)
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    # Each span is filled up with zeros in front, which leave a zero register as it is.
    padded = np.zeros(total * BLOCK, np.uint8)
    to = first * BLOCK + blocks * BLOCK - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded[np.repeat(to, lengths) + at] = data[np.repeat(starts, lengths) + at]
    columns = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    crc = np.zeros(total, np.uint32)
    for row in columns:
        crc = TABLE[(crc ^ row) & 0xFF] ^ crc >> 8
    # A block's register advances by the bytes after it; then the blocks of a span are added up.
    owner = np.repeat(np.arange(n), blocks)
    left = (blocks[owner] - 1 - (np.arange(total) - first[owner])) * BLOCK
    out = np.zeros(n, np.uint32)
    seed = np.full(n, 0xFFFFFFFF, np.uint32)
    for i, op in enumerate(ADVANCE):
        if (left >> i).any():
            some = np.flatnonzero(left >> i & 1)
            crc[some] = _apply(op, crc[some])
        if (lengths >> i).any():
            some = np.flatnonzero(lengths >> i & 1)
            seed[some] = _apply(op, seed[some])
    full = np.flatnonzero(blocks > 0)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(crc, first[full])
    return out ^ seed ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15 | crc << 17) + np.uint32(MASK_DELTA)).astype(np.uint32)


def frame_records(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Framed records one after another, and each record's offset."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    heads = lengths.astype("<u8").view(np.uint8)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    head_crc = masked(crc32c_many(heads, np.arange(len(lengths)) * 8, np.full(len(lengths), 8)))
    crc = masked(crc32c_many(data, np.cumsum(lengths) - lengths, lengths))
    heads, h, c = heads.tobytes(), head_crc.astype("<u4").tobytes(), crc.astype("<u4").tobytes()
    parts = [x for i, p in enumerate(payloads) for x in (heads[8 * i : 8 * i + 8], h[4 * i : 4 * i + 4], p, c[4 * i : 4 * i + 4])]
    return b"".join(parts), np.cumsum(lengths + 16) - lengths - 16


def read_records(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """Payloads of the records at ``offsets``; both checksums of each are verified."""
    flat = np.frombuffer(data, np.uint8)
    at = offsets.astype(np.int64)
    heads = np.ascontiguousarray(flat[at[:, None] + np.arange(12)])
    lengths = heads[:, :8].copy().view("<u8")[:, 0].astype(np.int64)
    if (masked(crc32c_many(flat, at, np.full(len(at), 8))) != heads[:, 8:].copy().view("<u4")[:, 0]).any():
        raise ValueError("a record's length does not match its checksum")
    stored = np.ascontiguousarray(flat[(at + 12 + lengths)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    if (masked(crc32c_many(flat, at + 12, lengths)) != stored).any():
        raise ValueError("a record does not match its checksum")
    return [data[a + 12 : a + 12 + n] for a, n in zip(at.tolist(), lengths.tolist())]


#: Letters that Unicode composition leaves alone and that lower-case to one letter.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN_WORD = re.compile(rf"[{LETTERS}]+")
#: A letter and a mark other than the apostrophe: the tokenizer always cuts between them.
CLOSING = rf"([{LETTERS}])([!-&(-/:-@\[-`{{-~])"


class Encoder:
    """Token ids of whole texts; every different word of a batch is encoded once.

    Words end at ASCII white space, and between a letter and a mark; the tokenizer's own pieces
    never reach across either. Words of plain letters go through it many at a time; its word-end
    tokens give the borders back. All other words go through it one by one, and texts that hold
    an added token's string go through it whole. A tokenizer that does not lower-case, or has no
    word-end tokens, gets whole texts only.
    """

    def __init__(self, path: str, known: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        sample = ["Don", "DER", "it"]
        self.by_word = bool(suffix) and self._joint(sample) is not None and self._joint(sample) == self._joint([w.lower() for w in sample])
        self.words: dict[str, bytes] = {}
        self.known = known

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joint(self, words: list[str]) -> list[bytes] | None:
        """Ids of words of letters from one call; None if the word ends do not add up."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            return None
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, words: list[str]) -> None:
        stems = [w for w in words if PLAIN_WORD.fullmatch(w)]
        for at in range(0, len(stems), 1000):
            some = stems[at : at + 1000]
            self.words |= zip(some, self._joint(some) or self._each(some))
        odd = [w for w in words if w not in self.words]
        self.words |= zip(odd, self._each(odd))

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.plain(words)]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(x, np.uint32) for x in self.plain(texts)]
        lower = pc.ascii_lower(pa.array(texts, pa.large_string()))
        odd = {i for a in self.added for i in np.flatnonzero(pc.match_substring(lower, a, ignore_case=True).to_numpy(zero_copy_only=False)).tolist()}
        if odd:
            lower = pa.array(["" if i in odd else t for i, t in enumerate(lower.to_pylist())], pa.large_string())
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, CLOSING, r"\1 \2"))
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        unique = coded.dictionary.to_pylist()
        if len(self.words) > self.known:
            self.words = {}
        self._learn([w for w in unique if w not in self.words])
        ids = [self.words[w] for w in unique]
        sizes = np.array([len(x) for x in ids], np.int64) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(sizes) - sizes
        own = sizes[index]
        ends = np.cumsum(own)
        tokens = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[index] - (ends - own), own)]
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        out = [tokens[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in odd:
            out[i] = np.array(self.plain([texts[i]])[0], np.uint32)
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The tokenizer of this worker, with the words that it has met in earlier tasks."""
    return Encoder(path)


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Tokenise whole texts and write record shards in ascending id order below ``folder``.

    Returns the manifest (shard, docs, tokens, bytes), one row per shard file, which is itself
    written there as Parquet. Files get a temporary name and are renamed when whole, and a task
    that runs again writes the same bytes under the same name. Null texts are empty, rows
    without an id are left out, and rows that repeat an id are all written. ``folder`` can be
    any address that ``pyarrow.fs`` opens and that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        temp, tokens, index, out = f"{root}/.{uuid.uuid4().hex}", encoder(tokenizer), [], None
        done, size = 0, 0
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                if out is None:
                    out = store.open_output_stream(temp)
                texts = piece.column("text").fill_null("").to_pylist()
                ids, keys = [np.append(x, np.uint32(end_id)) for x in tokens.batch(texts)], piece.column("id").to_pylist()
                kind = "<u2" if tokens.narrow else "<u4"
                data, offsets = frame_records([int(k).to_bytes(8, "little", signed=True) + x.astype(kind).tobytes() for k, x in zip(keys, ids)])
                counts = np.array([len(x) for x in ids], np.int64)
                rows = np.zeros(len(keys), INDEX)
                rows["doc_id"], rows["offset"], rows["n_tokens"] = keys, offsets + size, counts
                rows["start"] = done + np.cumsum(counts) - counts
                out.write(data)
                index.append(rows.tobytes())
                done, size = done + int(counts.sum()), size + len(data)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{temp}.idx") as to:
            to.write(b"".join(index))
        store.move(f"{temp}.idx", f"{root}/part-{shard:06d}.idx")
        store.move(temp, f"{root}/part-{shard:06d}.rec")
        n = sum(map(len, index)) // INDEX.itemsize
        width = 2 if tokens.narrow else 4
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [n], "tokens": [done], "bytes": [size], "width": [width]}, schema=pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("width", pa.int64())]))

    given = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = (given.repartitionByRange(shards, "id") if shards else given.repartitionByRange("id")).sortWithinPartitions("id", F.xxhash64("text"))
    manifest = dealt.mapInArrow(run, "shard bigint, docs bigint, tokens bigint, bytes bigint, width bigint")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema("shard bigint, docs bigint, tokens bigint, bytes bigint, width bigint").parquet(f"{folder}/manifest")


def read_token_records(spark: SparkSession, folder: str, batch_records: int = 1000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the shards.

    ``start`` counts the tokens of all records before it over all shards. Only the manifest,
    one small row per shard, passes the driver. Records are read by their index, a block at a time.
    """
    shards = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()
    before, base = 0, []
    for s in shards:
        base.append((s["shard"], before, s["width"]))
        before += s["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, first, width in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "width"))):
                with store.open_input_file(f"{root}/part-{shard:06d}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with store.open_input_file(f"{root}/part-{shard:06d}.rec") as f:
                    for at in range(0, len(index), batch_records):
                        rows = index[at : at + batch_records]
                        begin = int(rows["offset"][0])
                        end = int(index["offset"][at + batch_records]) if at + batch_records < len(index) else f.size()
                        f.seek(begin)
                        payloads = read_records(f.read(end - begin), rows["offset"].astype(np.int64) - begin)
                        keys = [int.from_bytes(p[:8], "little", signed=True) for p in payloads]
                        tokens = [np.frombuffer(p, f"<u{width}", offset=8).astype("<u4") for p in payloads]
                        if keys != rows["doc_id"].tolist() or [len(t) for t in tokens] != rows["n_tokens"].tolist():
                            raise ValueError(f"shard {shard} does not match its index")
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows["start"].astype(np.int64) + first), pa.array(rows["n_tokens"].astype(np.int64)), pa.array([zlib.crc32(t.tobytes()) for t in tokens], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    plan = spark.createDataFrame(base, "shard bigint, first bigint, width bigint").repartition(max(1, len(base)))
    return plan.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
