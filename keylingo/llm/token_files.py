"""Token-id files with Elias-Fano encoded document boundaries.

A shard file holds the ids of its documents one after the other, in ascending
document id, in two bytes an id (four if the vocabulary needs them). Where each
document starts is an Elias-Fano sequence: low bits packed, high bits in unary,
and a 32-bit select sample for every ``SAMPLE`` documents, so a start is found
without a table of 64-bit offsets, in about 2 + log2(ids / documents) bits a
document. Document ids are a second such sequence. The last bytes say where
the parts are.

Shards are written by tasks under temporary names and renamed, so a task that
is run again writes the same file. A manifest of one small row a shard gives
each shard's place among all ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, filesystem, publish, small

MAGIC, SAMPLE = b"EFTOKEN1", 64
#: Rows of a shard, about; a worker remembers the ids of so many chunks of so many characters at most, before it starts anew.
ROWS_A_SHARD, MEMO, LONGEST = 8192, 600_000, 64
#: magic, nulls among the ids, smallest id, documents, ids, bytes an id, lengths of the two sequences
_FOOTER = "<8sQqQQBQQ"
#: Bytes of a shard file that are read at once.
BUFFER = 1 << 20

#: The rules of a tokenizer file under which no token spans white space and which chunks may thus be encoded alone.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters on which Python and the tokenizer surely agree: in normal form in any company of their own, lowered one to one.
_UNSURE = re.compile("[^\x00-\u012f\u0131-\u017f\u2010-\u2027]")
_SPACES = re.compile("[\t\n\x0b\x0c\r\x85\xa0]")
_RUNS = re.compile(r"(?:[^\w ]|_)[.,] ")


class EliasFano:
    """A non-decreasing sequence of unsigned integers with select by place.

    ``low`` has the low bits of each value, ``high`` a one for each value at
    (its high bits + its place), ``samples`` the bit of every ``SAMPLE``-th one.
    """

    _HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (most // max(1, n)).bit_length() - 1)
        wide = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = np.packbits(wide.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def get(self, at: int) -> int:
        """The value at a place: select in the high bits from the nearest sample, and the low bits."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        bit, left = int(self.samples[at // SAMPLE]), at % SAMPLE
        byte = bit >> 3
        word = (int.from_bytes(self.high[byte : byte + 8], "little") >> (bit & 7)) << (bit & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 8
            word = int.from_bytes(self.high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        start = at * self.low_bits
        raw = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3], "little")
        return ((one - at) << self.low_bits) | ((raw >> (start & 7)) & ((1 << self.low_bits) - 1))

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = cls._HEAD.unpack_from(raw)
        at = cls._HEAD.size
        return cls(n, low_bits, raw[at : at + n_low], raw[at + n_low : at + n_low + n_high], np.frombuffer(raw, "<u4", offset=at + n_low + n_high))


class _Encoder:
    """A tokenizer file's ids of whole texts, as the library's plain call gives them.

    Where the file's rules let no token span white space, a text is normalised,
    cut at spaces, and its chunks are encoded without another normalisation and
    remembered. Texts with strings of special tokens, and files with other
    rules, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        vocabulary = self.whole.get_vocab()
        most = max([*vocabulary.values(), 0])
        self.width = np.dtype("<u2" if most < 1 << 16 else "<u4")
        cutter = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = (
            (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and cutter[0].get("pattern") == {"Regex": WORD_PATTERN}
            and [c.get("type") for c in cutter] == ["Split", "ByteLevel"]
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(t.get("normalized") or t.get("single_word") for t in spec.get("added_tokens", ()))
        )
        if self.by_chunk:
            self.parts = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
            self.ends = np.zeros(most + 1, bool)  # the ids that end a word
            self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
            self.memo = {"": b""}

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or any(s in text for s in self.added):
            return self._packed(self.whole.encode(text, add_special_tokens=False).ids)
        chunks = self._chunks(text)
        new = list(set(chunks).difference(self.memo))
        if not new:
            return b"".join(map(self.memo.__getitem__, chunks))
        if len(self.memo) + len(new) > MEMO:
            self.memo = {"": b""}
            new = list(set(chunks) - {""})
        made = self._encoded(new)
        self.memo |= {c: ids for c, ids in made.items() if len(c) <= LONGEST}
        memo = self.memo
        return b"".join([memo[c] if c in memo else made[c] for c in chunks])

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def _chunks(self, text: str) -> list[str]:
        """Parts of the normalised text that no token joins.

        A comma or full stop is parted from the word before it only where no
        other punctuation precedes one.
        """
        if not text.isascii() and _UNSURE.search(text):
            return self.whole.normalizer.normalize_str(text).split(" ")
        text = _SPACES.sub(" ", text.lower())
        if not _RUNS.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        # words of letters alone are one pre-token each: encoded in one call, and told apart by the ids that end a word
        plain, made = [c for c in chunks if c.isalpha()], {}
        ids = np.array(self.parts.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int64)
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist() if len(ids) else []
        if len(cuts) == len(plain):
            raw, size, at = ids.astype(self.width).tobytes(), self.width.itemsize, 0
            for chunk, cut in zip(plain, cuts, strict=True):
                made[chunk] = raw[at * size : cut * size]
                at = cut
        rest = [c for c in chunks if c not in made]
        for chunk, found in zip(rest, self.parts.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            made[chunk] = self._packed(found.ids)
        return made


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode(text: str, path: str) -> bytes:
    """The ids of a whole text, in the file's width."""
    return _encoder(path).encode(text)


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", rows_a_shard: int = ROWS_A_SHARD) -> DataFrame:
    """Writes shard files to ``folder`` and returns the manifest: shard, path, docs, ids, base.

    The folder is one that pyarrow can open and all executors share. Documents
    are in ascending id, null ids first; rows that share an id stay, in the
    order of a hash of their texts, and may be in several shards. Null texts
    count as empty and hold the end id alone. An empty table gives no files;
    other columns are ignored.
    """
    width = _encoder(tokenizer_path).width.itemsize
    end = end_id.to_bytes(width, "little")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # ties by text, then by the partition that a row is read in: so a hot id is split, and alike if a task runs again
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.spark_partition_id().alias("part"))
    shards = max(1, -(-docs.count() // rows_a_shard))

    def run(batches):
        task = TaskContext.get()
        store, root = filesystem(folder)
        path = f"{root}/shard-{task.partitionId():06d}.tok"
        temporary = f"{path}.{task.taskAttemptId()}"
        ids, lengths, out = [], [], None
        for batch in small(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temporary)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                made = encode(text, tokenizer_path) + end
                out.write(made)
                ids.append(doc_id)
                lengths.append(len(made) // width)
        if out is None:
            return
        nulls = sum(i is None for i in ids)
        known = np.array(ids[nulls:], np.int64)
        least = int(known[0]) if len(known) else 0
        names = EliasFano.of(known.view(np.uint64) - np.int64(least).view(np.uint64)).to_bytes()
        starts = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
        out.write(names)
        out.write(starts)
        out.write(struct.pack(_FOOTER, MAGIC, nulls, least, len(ids), sum(lengths), width, len(names), len(starts)))
        out.close()
        publish(store, temporary, path)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([task.partitionId()], pa.int32()), "path": [path], "docs": pa.array([len(ids)], pa.int64()), "ids": pa.array([sum(lengths)], pa.int64())}
        )

    ordered = narrow.repartitionByRange(shards, "doc_id", "tie", "part").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    written = Scratch(docs.sparkSession, "manifest").keep(ordered.mapInArrow(run, "shard int, path string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return written.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_shard(path: str, folder: str):
    """(doc_id, start in the shard, ids) of each document of a shard file.

    Ids and starts come from select in the two stored sequences; the token ids
    are read through a buffer.
    """
    store, _ = filesystem(folder)
    with store.open_input_file(path) as file:
        size, footer = file.size(), struct.calcsize(_FOOTER)
        magic, nulls, least, n, _, width, n_names, n_starts = struct.unpack(_FOOTER, file.read_at(footer, size - footer))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        tail = size - footer - n_starts
        starts = EliasFano.from_bytes(file.read_at(n_starts, tail))
        names = EliasFano.from_bytes(file.read_at(n_names, tail - n_names))
    kind = np.dtype("<u2" if width == 2 else "<u4")
    with store.open_input_stream(path, compression=None, buffer_size=BUFFER) as stream:
        end = starts.get(0)
        for at in range(n):
            start, end = end, starts.get(at + 1)
            yield (None if at < nulls else least + names.get(at - nulls)), start, np.frombuffer(stream.read((end - start) * width), kind)


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start among all ids, n_tokens, ids_crc32 (of little-endian 32-bit ids).

    A row for each row that was written, repeated and null ids included; an
    empty manifest gives none.
    """

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = [(d, base + s, len(i), zlib.crc32(i.astype("<u4").tobytes())) for d, s, i in read_shard(path, folder)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "base").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes token files to the shared folder and returns what ``read_files`` finds in them.

    Nulls, ties, repeated rows, empty tables and other columns: see ``write_files``.
    """
    folder = f"{Scratch(docs.sparkSession, 'token-files').path}/files"
    return read_files(write_files(docs, folder, tokenizer_path, end_id), folder)
