"""Token ids as length-delimited binary records.

A record is: payload length (8 bytes, little-endian), its masked CRC-32 (4), the payload, the payload's
masked CRC-32 (4). The payload is a flag byte (1: there is a doc_id; 2: all ids are below 65,536), the
doc_id (8) and the ids (2 bytes each with flag 2, else 4). Beside each data file lies an index of (offset, length) pairs of 8 bytes each, so a reader can
seek to any record in any order.

Texts are encoded where they lie; only ids are shuffled. Spark deals them out by ranges of doc_id and
sorts each range, so files in the order of (part, seq) hold ascending doc_ids. Files are written under the
name of the attempt and then moved, so a task that is run again replaces its file as a whole."""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.bpe import SPACE
from lexiscope.llm.common import open_fs, slices
from lexiscope.session import materialise, prepare, shared_dir, whole_uri

END = 1
FILE_BYTES = 512 << 20
#: Bytes of ids in a range: the least and the most; between them a range holds one in RANGES of all.
LEAST, MOST, RANGES = 16 << 20, 512 << 20, 2000
CHUNK = re.compile(f"[^{SPACE}]+")
#: What str.split() takes for white space and Unicode doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
TAIL = ".,;:!?%&*#$@()=+-/"
KEPT = 400_000
#: How the public tokenizer cuts text, on which the memo of chunks rests.
CUTS = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
GAP, GAP_ID = "<|endoftext|>", 49407


def cuts_of(path: str) -> tuple[list[str], str]:
    """The kinds of a tokenizer file's normalizers and its first split pattern."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    steps = (whole.get("normalizer") or {}).get("normalizers", [])
    split = next(iter((whole.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    return [x["type"] for x in steps], (split.get("pattern") or {}).get("Regex", "")


class Memo(dict):
    """Chunk -> ids. What is in the older half moves over when it is asked for; what is in neither is noted in `fresh`."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.fresh: set[str] = set()

    def __missing__(self, chunk: str) -> bytes | None:
        x = self.older.get(chunk)
        if x is None:
            self.fresh.add(chunk)
        else:
            self[chunk] = x
        return x

    def turn(self) -> None:
        """Let the older half go, and make this one the older."""
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()


class WordCoder:
    """The tokenizers library behind a memo of white-space chunks.

    The public tokenizer's merges never cross white space, so a text's ids are those of its chunks in turn. A
    chunk is lower-cased in ASCII, as the tokenizer does anyway, and one that ends in a letter and then
    marks is looked up in two parts, as a run of marks is always a word of its own. Chunks not met
    before are encoded together, with the tokenizer's own mark for an end between them, or, if they are one
    word of ASCII letters, by the tokenizer's model alone. A tokenizer
    that cuts text in another way gets whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = cuts_of(path) == CUTS and self.tokenizer.token_to_id(GAP) == GAP_ID
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = "<u4" if self.wide else "<u2"
        self.memo = Memo()

    def raw(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, self.type)

    def learn(self, fresh: set[str]) -> None:
        """Put the ids of chunks into the memo."""
        memo, halves, new = self.memo, [], set()
        for c in fresh:
            core = c.rstrip(TAIL)
            if core != c and core and core[-1].lower().isalpha():
                tail = c[len(core) :]
                halves.append((c, core, tail))
                for part in (core, tail):
                    if memo[part] is None:
                        new.add(part)
            else:
                new.add(c)
        # a run of ASCII letters is one word to the tokenizer, so its merges can be asked for as they are
        word, code = self.tokenizer.model.tokenize, "I" if self.wide else "H"
        for c in [c for c in new if c.isascii() and c.isalpha()]:
            new.discard(c)
            memo[c] = array(code, [x.id for x in word(c)]).tobytes()
        alone = [c for c in new if GAP in c]
        for c, ids in zip(alone, self.raw(alone), strict=True):
            memo[c] = ids.tobytes()
        rest = list(new.difference(alone))
        groups = [rest[i : i + 1000] for i in range(0, len(rest), 1000)]
        for group, ids in zip(groups, self.raw([GAP.join(g) for g in groups]), strict=True):
            data, start, size = ids.tobytes(), 0, ids.itemsize
            for c, end in zip(group, [*(np.flatnonzero(ids == GAP_ID) * size).tolist(), len(data)], strict=True):
                memo[c] = data[start:end]
                start = end + size
        for c, core, tail in halves:
            memo[c] = memo[core] + memo[tail]

    def known(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        memo = self.memo
        memo.turn()
        found = list(map(memo.__getitem__, chunks))
        if memo.fresh:
            fresh, memo.fresh = memo.fresh, set()
            self.learn(fresh)
            memo.fresh = set()
            found = [memo[c] if x is None else x for c, x in zip(chunks, found, strict=True)]
        return found

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.BinaryArray:
        """The ids of each text (null: empty), little-endian, of two bytes each where the vocabulary allows, else four; `end` after each.

        A slice of texts is cut into its distinct chunks by Arrow; only those are looked up one by one."""
        texts = texts.cast(pa.string()).fill_null("")
        low = pc.ascii_lower(texts)
        if not self.chunked:
            parts = [x.tobytes() for x in self.raw(texts.to_pylist())]
            sizes, of, per_text = np.array([len(x) for x in parts], np.int64), np.arange(len(parts)), np.ones(len(parts), np.int64)
        else:
            if pc.any(pc.match_substring_regex(low, f"[{SEPARATORS}]")).as_py():
                chunks = pa.array([CHUNK.findall(t) for t in low.to_pylist()], pa.list_(pa.string()))
            else:
                chunks = pc.utf8_split_whitespace(low)  # empty strings at the ends have no ids
            coded = chunks.flatten().dictionary_encode()
            parts = self.known(coded.dictionary.to_pylist())
            sizes, of, per_text = np.fromiter(map(len, parts), np.int64, len(parts)), coded.indices.to_numpy(zero_copy_only=False), chunks.value_lengths().to_numpy(zero_copy_only=False)
        kind = np.dtype(self.type)
        sizes = sizes // kind.itemsize
        blob = np.frombuffer(b"".join(parts), kind)
        n = sizes[of]  # ids of each chunk of the slice in turn
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = blob[np.repeat((np.cumsum(sizes) - sizes)[of] - upto[:-1], n) + np.arange(upto[-1])]
        lengths = np.diff(upto[np.concatenate([[0], np.cumsum(per_text)])])
        if end is not None:
            lengths = lengths + 1
            last = np.cumsum(lengths) - 1
            out = np.empty(len(ids) + len(last), kind)
            inner = np.ones(len(out), bool)
            inner[last] = False
            out[inner], out[last] = ids, end
            ids = out
        offsets = (np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


@cache
def word_coder(path: str | None = None) -> WordCoder:
    import os

    import public_tokenizers as P

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
    return WordCoder(path or P.path("word_bpe_49k.json"))


# --- the file format -------------------------------------------------------------------------


def masked(data: bytes) -> int:
    """A CRC-32, rotated and offset, so that a checksum of bytes that hold checksums stays telling."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    small = bool(len(ids) == 0 or ids.max() < 1 << 16)
    return struct.pack("<Bq", (doc_id is not None) | small << 1, doc_id or 0) + ids.astype("<u2" if small else "<u4", copy=False).tobytes()


def unpack(payload: bytes) -> tuple[int | None, bytes]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=9)
    return doc_id if flags & 1 else None, ids.astype("<u4").tobytes()


def read_record(data: bytes, offset: int) -> bytes:
    """The payload at an offset; ValueError if a checksum differs."""
    (length,) = struct.unpack_from("<Q", data, offset)
    if struct.unpack_from("<I", data, offset + 8)[0] != masked(data[offset : offset + 8]):
        raise ValueError(f"length at {offset} is damaged")
    payload = data[offset + 12 : offset + 12 + length]
    if struct.unpack_from("<I", data, offset + 12 + length)[0] != masked(payload):
        raise ValueError(f"record at {offset} is damaged")
    return payload


class Writer:
    """One data file and its index, moved into place when whole."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.ends = {kind: (f"{base}/_{attempt}_{name}.{kind}", f"{base}/{name}.{kind}") for kind in ("rec", "idx")}
        self.files = {kind: self.fs.open_output_stream(a) for kind, (a, _) in self.ends.items()}
        self.size = self.records = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = frame(pack(doc_id, ids))
        self.files["idx"].write(struct.pack("<QQ", self.size, len(data)))
        self.files["rec"].write(data)
        self.size, self.records, self.tokens = self.size + len(data), self.records + 1, self.tokens + len(ids)

    def close(self) -> None:
        from pyarrow.fs import FileType

        for kind, (a, b) in self.ends.items():
            self.files[kind].close()
            if self.fs.get_file_info(b).type != FileType.NotFound:  # of an attempt that was lost
                self.fs.delete_file(b)
            self.fs.move(a, b)


def read_file(folder: str, name: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of each record by way of the index, in its order or in that of the given record numbers."""
    fs, base = open_fs(folder)
    with fs.open_input_file(f"{base}/{name}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with fs.open_input_file(f"{base}/{name}.rec") as f:
        for n in range(len(index)) if order is None else order:
            offset, length = map(int, index[n])
            f.seek(offset)
            yield unpack(read_record(f.read(length), 0))


# --- jobs ------------------------------------------------------------------------------------


def splitters(keyed: DataFrame, ranges: int, per_range: int = 20) -> np.ndarray:
    """Boundaries of `ranges` ranges of rows by (doc_id, tie, row), from a sample of about per_range rows for each."""
    n = keyed.count()
    drawn = keyed.filter(F.pmod(F.xxhash64("doc_id", "tie", "row"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, ranges * per_range / max(n, 1))))
    got = drawn.select(F.col("doc_id").isNotNull().cast("long").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", "row").toPandas().to_numpy(np.int64).reshape(-1, 4)
    got = got[np.lexsort(got.T[::-1])]
    return got[[len(got) * i // ranges for i in range(1, ranges)]] if len(got) else got


def write_records(docs: DataFrame, folder: str, path: str | None = None, file_bytes: int = FILE_BYTES, least: int = LEAST) -> DataFrame:
    """Encode docs(doc_id, text), write the files to `folder`, and return what was written: part, seq, name, records, tokens.

    Each document ends with id 1; a null or empty text is that id alone. Null doc_ids come first.
    Repeated rows are written as often as they are there; other columns are ignored. The number of
    ranges follows the bytes of the texts; rows that repeat a doc_id can be cut between ranges. What
    comes to the driver is some rows of (doc_id, hash, number) for each range."""
    from bisect import bisect_right

    spark = prepare(docs.sparkSession)
    folder = whole_uri(spark, folder)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    ranges = int(total // min(max(total / RANGES, least), MOST)) + 1
    cuts = spark.sparkContext.broadcast(splitters(keyed, ranges))

    def encode(batches):
        c = word_coder(path)
        bounds = [tuple(x) for x in cuts.value.tolist()]
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                i, t, tie, row = piece.columns
                part = [bisect_right(bounds, (int(d is not None), d or 0, h, r)) for d, h, r in zip(i.to_pylist(), tie.to_pylist(), row.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([i, pa.array([c.wide] * len(i)), c.encode(t, END), tie, row, pa.array(part, pa.int32())], ["doc_id", "wide", "ids", "tie", "row", "part"])

    def write(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        at, seq, w, rows = None, 0, None, []

        def done():
            w.close()
            rows.append((at, seq, name, w.records, w.tokens))

        for batch in batches:
            for part, doc_id, wide, ids in zip(*(batch.column(n).to_pylist() for n in range(3)), batch.column(3), strict=True):
                if w is not None and (part != at or w.size >= file_bytes):
                    done()
                    seq, w = (seq + 1 if part == at else 0), None
                if w is None:
                    at, name = part, f"part-{part:05d}-{seq:05d}"
                    w = Writer(folder, name, f"{attempt}")
                w.add(doc_id, np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2"))
        if w is not None:
            done()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "name", "records", "tokens"])

    ids = keyed.mapInArrow(encode, "doc_id long, wide boolean, ids binary, tie long, row long, part int")
    dealt = ids.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "doc_id", "tie", "row")
    return materialise(dealt.select("part", "doc_id", "wide", "ids").mapInArrow(write, "part int, seq int, name string, records long, tokens long"))


def read_records(written: DataFrame, folder: str) -> DataFrame:
    """The records of the files: doc_id, start (ids of all documents before), n_tokens, ids (binary, four bytes each); a task for each file."""
    folder = whole_uri(written.sparkSession, folder)

    def read(batches):
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list = []
                held = 0
                for doc_id, ids in read_file(folder, name):
                    rows.append((doc_id, at, len(ids) // 4, ids))
                    at, held = at + len(ids) // 4, held + len(ids)
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    def table(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    # one row for each file of some megabytes: few enough for a running sum
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = written.select("name", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("start"))
    return files.repartition(max(1, written.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs(doc_id, text) to the shared folder and read them back: doc_id, start, n_tokens, ids."""
    folder = shared_dir(docs.sparkSession)
    return read_records(write_records(docs, folder, path), folder)
