"""Token ids in directly addressable codes (DAC).

A shard file holds documents in the order asked for. An id is cut into 8-bit chunks, lowest first;
level k holds the k-th chunks of those ids that have one, and a bitmap that says which go on. A rank
directory over each bitmap (ones before every 512th bit) leads from a position in one level to its
position in the next, so any single token is found with a few reads and nothing around it is decoded.

File layout, all little-endian:
  magic "TDAC1\\0\\0\\0"; u64: documents, tokens, levels
  per level: u64 entries, u64 offset of chunks, u64 offset of bitmap, u64 offset of directory
  u64 offsets of: ids of documents (i64), null flags (u8), token offsets (u64, documents + 1)
  the sections
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import arrow_map
from .common import hold, read_table, release_others, scratch_path, shuffle_parts, written

MAGIC, DIRECTORY_BITS = b"TDAC1\0\0\0", 512
SHARD_TOKENS, CACHED_WORDS = 2 << 20, 400_000
TOKENIZER, END_ID = "word_bpe_49k.json", 2


# --- the codes ---------------------------------------------------------------------------------


def dac_bytes(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, offsets: np.ndarray) -> bytes:
    """A shard file's content."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & np.uint32(255)).astype(np.uint8), rest >> np.uint32(8)
        more = rest != 0
        levels.append((chunk, more))
        if not more.any():
            break
        rest = rest[more]
    head = len(MAGIC) + 24 + 32 * len(levels) + 24
    sections, table, at = [], [], head

    def put(data: bytes) -> int:
        nonlocal at
        start = at
        data += bytes(-len(data) % 8)
        sections.append(data)
        at += len(data)
        return start

    for chunk, more in levels:
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.zeros(len(more) // DIRECTORY_BITS + 1, np.uint64)
        ones[1:] = np.cumsum(np.add.reduceat(more, np.arange(0, len(more), DIRECTORY_BITS), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64))[: len(ones) - 1]
        table.append((len(chunk), put(chunk.tobytes()), put(bits), put(ones.tobytes())))
    docs = (put(doc_ids.astype("<i8").tobytes()), put(nulls.astype(np.uint8).tobytes()), put(offsets.astype("<u8").tobytes()))
    out = [MAGIC, struct.pack("<3Q", len(doc_ids), len(ids), len(levels))]
    out += [struct.pack("<4Q", *row) for row in table]
    return b"".join([*out, struct.pack("<3Q", *docs), *sections])


class DacFile:
    """Reads a shard through a function read_at(offset, length); only the bytes asked for are read."""

    def __init__(self, read_at):
        self._read = read_at
        if read_at(0, 8) != MAGIC:
            raise ValueError("not a TDAC1 file")
        self.n_docs, self.n_tokens, n = struct.unpack("<3Q", read_at(8, 24))
        self.levels = [struct.unpack("<4Q", read_at(32 + 32 * k, 32)) for k in range(n)]
        self._docs = struct.unpack("<3Q", read_at(32 + 32 * n, 24))

    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self._read(self._docs[0], 8 * self.n_docs), "<i8")
        nulls = np.frombuffer(self._read(self._docs[1], self.n_docs), np.uint8)
        return [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]

    def offsets(self) -> np.ndarray:
        return np.frombuffer(self._read(self._docs[2], 8 * (self.n_docs + 1)), "<u8").astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before position i."""
        _, _, bitmap, directory = self.levels[level]
        block = i // DIRECTORY_BITS
        (ones,) = struct.unpack("<Q", self._read(directory + 8 * block, 8))
        if rest := i - block * DIRECTORY_BITS:
            word = int.from_bytes(self._read(bitmap + block * DIRECTORY_BITS // 8, (rest + 7) // 8), "little")
            ones += (word & ((1 << rest) - 1)).bit_count()
        return ones

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            value |= self._read(chunks + i, 1)[0] << (8 * level)
            if not self._read(bitmap + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end (exclusive) as u32: one rank a level, then straight reads."""
        n = end - start
        out = np.zeros(n, np.uint32)
        where = np.arange(n)
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            if not n:
                break
            out[where] |= np.frombuffer(self._read(chunks + start, n), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            bits = np.unpackbits(np.frombuffer(self._read(bitmap + first, (start + n + 7) // 8 - first), np.uint8), bitorder="little")
            more = bits[start - 8 * first :][:n].astype(bool)
            start, n, where = self._rank(level, start), int(more.sum()), where[more]
        return out


# --- encoding ----------------------------------------------------------------------------------


class WordCachedEncoder:
    """The tokenizers library's ids, with the ids of words it has already encoded kept.

    For a tokenizer that splits texts into pieces before BPE, ids of a text are those of its pieces in
    turn. Where every character of a text is of a kind whose lower case and class are plain (ASCII,
    Latin letters up to U+017F), its pieces are found here and only unseen ones go to the library;
    any other text goes to the library whole. Other kinds of tokenizer get whole texts always.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        import json
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["pattern"] == {"Regex": SPLIT} and not spec.get("post_processor")
        if self.by_word:
            # the same model without normalizer and split, which the pieces have had
            bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] != "Split"]}}
            self.pieces_tok = Tokenizer.from_str(json.dumps(bare))
        self.marks = tuple(x["content"] for x in spec.get("added_tokens") or [])
        self.plain = re.compile("[\t-\r\x20-~À-įı-ſ]*").fullmatch
        # letters first, as most pieces are: alternatives that start with different characters may change places
        self.pieces = re.compile("[a-zß-öø-ſ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\sa-z0-9ß-öø-ſ]+").findall
        self.cached_words = cached_words  # of a generation; two are held at most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _need(self, cut: list[tuple[int, list[str]]]) -> None:
        """Puts the ids of all words of cut into known; older is the generation before it."""
        words: set[str] = set()
        for _, own in cut:
            words.update(own)
        unseen = words.difference(self.known)
        if len(self.known) + len(unseen) > self.cached_words:
            self.older, self.known, unseen = self.known, {}, words
        again = {w: x for w in unseen if (x := self.older.get(w)) is not None}
        self.known.update(again)
        self._learn([w for w in unseen if w not in again])

    def _learn(self, words: list[str]) -> None:
        """Encodes pieces by the library's model; what comes before the model is done to them already."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            enc = self.pieces_tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(enc.ids, "<u4").tobytes(), np.array(enc.word_ids, np.int64)
            bounds = (4 * np.searchsorted(of, np.arange(len(part) + 1))).tolist()
            self.known.update(zip(part, [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian u32."""
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if self.by_word and self.plain(text) and not any(m in text for m in self.marks):
                cut.append((i, self.pieces(text.lower())))
            else:
                out[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self._need(cut)
        get = self.known.__getitem__
        for i, words in cut:
            out[i] = b"".join(map(get, words))
        return out


#: Fixed value: the split pattern of the tokenizer that the word cache knows how to follow.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ENCODERS: dict[tuple[str, int], WordCachedEncoder] = {}
hold("token_output", _ENCODERS)


def encoder(path: str, cached_words: int = CACHED_WORDS) -> WordCachedEncoder:
    """The worker's encoder; one of another tokenizer or bound makes room for it."""
    if (path, cached_words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cached_words] = WordCachedEncoder(path, cached_words)
    return _ENCODERS[path, cached_words]


MANIFEST = "origin string, at bigint, file string, n_docs bigint, n_tokens bigint"


def _writer(folder: str, tokenizer_path: str, end_id: int, shard_tokens: int, cached_words: int):
    """Rows: id, text, and for rows in stored order the file and row that they were read from."""

    def run(batches):
        from pyspark import TaskContext

        release_others("token_output")
        enc, part = encoder(tokenizer_path, cached_words), f"{TaskContext.get().partitionId():08d}"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        end, seq = np.array([end_id], "<u4").tobytes(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        sizes, held, where = [], 0, None  # where: the place of the shard's first document, and the next one's

        def flush():
            nonlocal seq, held
            flat = np.frombuffer(b"".join(ids), "<u4")
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            data = dac_bytes(flat, np.array([x or 0 for x in names], np.int64), np.array([x is None for x in names]), offsets)
            # Named for this attempt: what a lost attempt leaves behind is in no manifest.
            file = f"{root}/part-{part}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(file) as out:
                out.write(data)
            origin, at = (part, seq) if where is None else where[:2]
            row = pa.RecordBatch.from_pydict({"origin": [origin], "at": pa.array([at], pa.int64()), "file": [file], "n_docs": [len(names)], "n_tokens": [len(flat)]})
            seq += 1
            ids.clear(), names.clear(), sizes.clear()
            held = 0
            return row

        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
                sizes_of = pc.binary_length(texts).to_pylist()
                places = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if batch.num_columns > 2 else None
                at = 0
                while at < len(doc_ids):
                    upto, size = at, 0
                    while upto < len(doc_ids) and (size < 4 << 20 or upto == at):
                        size += sizes_of[upto] or 0
                        upto += 1
                    for k, code in enumerate(enc.encode([x or "" for x in texts.slice(at, upto - at).to_pylist()]), at):
                        if places:
                            origin, row = places[k]
                            if names and where[::2] != (origin, row):  # another file, or another part of this one
                                yield flush()
                            where = (origin, where[1] if names else row, row + 1)
                        ids.append(code + end)
                        names.append(doc_ids[k])
                        sizes.append(len(code) // 4 + 1)
                        held += sizes[-1]
                        if held >= shard_tokens:
                            yield flush()
                    at = upto
            if names:
                yield flush()
        finally:
            enc.older = {}

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", by_id: bool = True, cached_words: int = CACHED_WORDS) -> tuple[DataFrame, str]:
    """Encodes docs and writes them as DAC shards under folder; the manifest, a row a shard.

    Returns the manifest and the folder. The manifest's columns: origin, at, file, n_docs, n_tokens, first_token (of all documents).
    With by_id, shards hold documents in ascending id order; null ids come first, equal ids in the
    order of their texts. Without it, documents keep the order in which docs is stored (the rows of its files in turn, files
    by name), and texts aren't shuffled; docs that isn't a plain table of files is written as one first.
    cached_words bounds the words whose ids a worker keeps (about 300 bytes each, in two generations): memory for time, with the same ids.
    A null text counts as empty and gives the end id alone. Repeated rows are encoded each. An empty table
    gives an empty manifest. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "dac")
    columns = [F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")]
    if by_id:
        ordered = docs.select(*columns).repartitionByRange(shuffle_parts(spark), "id").sortWithinPartitions("id", "text")
    else:
        places = [F.col("_metadata.file_path").alias("origin"), F.col("_metadata.row_index").alias("at")]
        try:
            ordered = docs.select(*columns, *places)
        except AnalysisException:
            ordered = written(docs.select(*columns), "stored").select("id", "text", *places)
    manifest = written(arrow_map(ordered, _writer(folder, tokenizer_path, end_id, shard_tokens, cached_words), MANIFEST), "manifest")
    # As many rows as partitions or files; within one of them, as many as shards. Longer names have higher numbers.
    origins = manifest.groupBy("origin").agg(F.sum("n_tokens").alias("t"))
    before = origins.select("origin", (F.sum("t").over(Window.orderBy(F.length("origin"), "origin")) - F.col("t")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("origin").orderBy("at")) - F.col("n_tokens")
    return manifest.join(before, "origin").select(*manifest.columns, (F.col("before") + own).alias("first_token")), folder


def _reader(folder: str, with_ids: bool):
    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(file) as source:
                    shard = DacFile(lambda at, n, s=source: s.read_at(n, at))
                    names, offsets = shard.doc_ids(), shard.offsets()
                    group = 2000
                    for a in range(0, len(names), group):
                        spans = [(int(offsets[i]), int(offsets[i + 1])) for i in range(a, min(a + group, len(names)))]
                        flat = shard.tokens(spans[0][0], spans[-1][1])
                        texts = [flat[s - spans[0][0] : e - spans[0][0]] for s, e in spans]
                        cols = {
                            "doc_id": pa.array(names[a : a + group], pa.int64()),
                            "start": pa.array([first + s for s, _ in spans], pa.int64()),
                            "n_tokens": pa.array([e - s for s, e in spans], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in texts], pa.int64()),
                        }
                        if with_ids:
                            cols["ids"] = pa.array([x.astype(np.int32) for x in texts], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(cols)

    return run


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens, ids_crc32, and with with_ids the ids."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    files = manifest.select("file", "first_token").repartition(shuffle_parts(manifest.sparkSession), "file")
    return arrow_map(files, _reader(folder, with_ids), schema)


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file())
    return read_tokens(manifest, folder)
