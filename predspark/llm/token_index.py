"""Token ids in raw shard files, and a minimal perfect hash index from document keys to places in them.

Files of a corpus, all in one folder:
  shard-NNNNN.ids   raw ids, little-endian unsigned integers of 2 bytes if every id fits, else 4; documents end to end
  index-NNNNN.mph   one part of the index: a hash function without gaps over the part's keys, and for each slot the
                    key's fingerprint, shard, first id and number of ids
  manifest.json     id width, shard starts (ids before each shard) and the number of index parts
  keys              a Parquet table of all keys (doc_id, ordinal) and their places
A key is looked up in constant time: its hash picks the part, a few bit vectors the slot; the fingerprint tells keys
that were never stored apart but for one in 2**32."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet, slices
from .common import materialize, shared_path

MAGIC = b"MPHIDX01"
MAX_LEVELS = 40
LOAD = 2.0
#: Words that a worker remembers.
REMEMBERED = 600_000


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_whole(uri: str, pieces: Iterator[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so a repeated or lost task leaves no half file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    size = 0
    with fs.open_output_stream(part) as out:
        for p in pieces:
            out.write(p)
            size += len(p)
    fs.move(part, path)
    return size


def mixed64(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mix of 64-bit integers for each seed."""
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def document_keys(ids: np.ndarray, missing: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id or null, how many rows with that doc_id come before)."""
    key = mixed64(np.where(missing, 0, ids).astype(np.int64).view(np.uint64), 1)
    other = (ordinal.astype(np.uint64) << np.uint64(1)) | missing.astype(np.uint64)
    return np.where(other > 0, mixed64(key ^ mixed64(other, 2), 3), key)


class PerfectHash:
    """Keys to 0 .. n-1 without gaps.  Level by level, each key is hashed into a bit vector of LOAD bits a key; keys
    that are alone in their bit stay there, the rest goes on.  A key's slot is the number of set bits before its own."""

    def __init__(self, bits: list[np.ndarray], ranks: list[np.ndarray], left: np.ndarray) -> None:
        self.bits, self.ranks, self.left = bits, ranks, left

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, ranks, base, level = [], [], 0, 0
        while len(keys) and level < MAX_LEVELS:
            m = max(64, int(LOAD * len(keys)) + 63) // 64 * 64
            at = (mixed64(keys, 10 + level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            bits.append(words)
            ranks.append((base + before[:-1]).astype(np.int64))
            base += int(before[-1])
            keys = keys[~alone[at]]
            level += 1
        return cls(bits, ranks, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not there some slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(todo):
                return out
            at = mixed64(keys[todo], 10 + level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[todo[found]] = ranks[word[found]] + np.bitwise_count(below)
            todo = todo[~found]
        if len(self.left) and len(todo):
            base = (int(self.ranks[-1][-1]) + int(np.bitwise_count(self.bits[-1][-1:])[0])) if self.bits else 0
            i = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            out[todo] = np.where(self.left[i] == keys[todo], base + i, -1)
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed64(keys, 7) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """An index part as bytes.  Keys are distinct: of n documents two have one key about once in 2**65 / n**2 tables,
    which is refused rather than indexed wrongly."""
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two documents have one 64-bit key")
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    arrays = [*mph.bits, *mph.ranks, mph.left, fingerprints(keys)[order], shard.astype("<i4")[order], first.astype("<i8")[order], count.astype("<i8")[order]]
    head = json.dumps({"levels": len(mph.bits), "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *[a.tobytes() for a in arrays]])


class IndexPart:
    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not an index part")
        n = int.from_bytes(raw[8:16], "little")
        head, at, arrays = json.loads(raw[16 : 16 + n]), 16 + n, []
        for dtype, size in head["arrays"]:
            arrays.append(np.frombuffer(raw, dtype, size, at))
            at += arrays[-1].nbytes
        k = head["levels"]
        self.mph = PerfectHash(arrays[:k], arrays[k : 2 * k], arrays[2 * k])
        self.prints, self.shard, self.first, self.count = arrays[2 * k + 1 :]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """found, shard, first id in the shard, number of ids."""
        slot = self.mph.slots(keys)
        safe = np.clip(slot, 0, max(0, len(self.prints) - 1))
        if not len(self.prints):
            zero = np.zeros(len(keys), np.int64)
            return zero.astype(bool), zero, zero, zero
        found = (slot >= 0) & (self.prints[safe] == fingerprints(keys))
        return found, self.shard[safe], self.first[safe], self.count[safe]


#: What a pre-tokenizer of lower-cased words has to be for words to be cut here.  Fixed values.
LOWER_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Words below U+0180 whose normal form is str.lower(), and that pattern for them: letters, numbers, others.
_plain = re.compile("[^\u0130\x85\xa0\u0180-\U0010ffff]*\\Z")
_pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")


class WordEncoder:
    """Texts to raw ids by a tokenizers file whose pre-tokenizer drops white space: words between ASCII white space
    are encoded by themselves, each distinct one once while it is remembered.  When too many are, those of the last
    few calls stay.  Where the file normalizes and cuts as LOWER_WORDS has it, plain words are cut here and only the
    library's merges are called; all other words go through the whole library."""

    KEPT_CALLS = 3

    def __init__(self, path: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.direct = all(spec[k] == v for k, v in LOWER_WORDS.items())
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.dtype = dtype
        self.known: dict[bytes, bytes] = {}
        self.recent: list[set[bytes]] = []

    def _learn(self, new: list[bytes]) -> None:
        known, rest, model = self.known, [], self.tokenizer.model
        for w in new:
            word = w.decode("utf-8", "surrogatepass")
            if not self.direct or not _plain.match(word) or any(a in word for a in self.added):
                rest.append((w, word))
                continue
            ids = [t.id for p in _pieces.findall(word.lower()) for t in model.tokenize(p.encode().decode("latin-1").translate(self.alphabet))]
            known[w] = np.array(ids, self.dtype).tobytes()
        if rest:
            for (w, _), e in zip(rest, self.tokenizer.encode_batch_fast([x for _, x in rest], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes.split() knows ASCII white space only
        used = {w for own in cut for w in own}
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for own in self.recent for w in own if w in self.known}
        self.recent = [*self.recent[1 - self.KEPT_CALLS :], used]
        known = self.known
        self._learn([w for w in used if w not in known])
        return [b"".join([known[w] for w in own]) for own in cut]


_encoders: dict[tuple[str, str], WordEncoder] = {}


def write_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, part_keys: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append end_id, write the ids in ascending doc_id order (nulls first) and index them.
    Returns the folder's URI; give one that every executor can write to, else it is a fresh one in the shared folder,
    which goes when the driver ends.

    Texts are range-partitioned by doc_id and place in the table, and sorted; each task streams its documents into one
    shard file, so no task holds more than a batch, and a doc_id (or null) that many rows share spreads over many
    shards.  Rows that share a doc_id lie together in the order they come, told apart by an ordinal.
    Index parts hold about part_keys keys, chosen by hash.  Defined cases: a null or empty text is just end_id; an
    empty table gives a manifest without shards; other columns are ignored."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    top = max(end_id, Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1)
    dtype = "<u2" if top < 1 << 16 else "<u4"
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault((tokenizer_path, dtype), None) or WordEncoder(tokenizer_path, dtype)
        _encoders[tokenizer_path, dtype] = encoder
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        shard, entries = TaskContext.get().partitionId(), []

        def payload() -> Iterator[bytes]:
            at, last, ordinal = 0, object(), 0
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = batch.column("doc_id").to_pylist()
                ordinals, firsts, counts = [], [], []
                for part in slices(texts):
                    for doc_id, raw in zip(ids[part], encoder.encode(texts[part]), strict=True):
                        ordinal = ordinal + 1 if doc_id == last else 0
                        last = doc_id
                        ordinals.append(ordinal)
                        firsts.append(at)
                        counts.append(len(raw) // width + 1)
                        at += counts[-1]
                        yield raw + end
                entries.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ordinals, pa.int64()), pa.array([shard] * len(ids), pa.int32()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "ordinal", "shard", "first", "n"]))

        stream = payload()
        head = next(stream, None)
        if head is None:
            return
        write_whole(f"{folder}/shard-{shard:05d}.ids", (x for g in ([head], stream) for x in g))
        yield from entries

    entries = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").mapInArrow(write_shard, "doc_id long, ordinal long, shard int, first long, n long")
    entries = materialize(entries, "token-entries")
    which = F.struct(F.isnotnull("doc_id"), "doc_id")
    ends = entries.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min(which).alias("low"), F.max(which).alias("high"), F.max_by("ordinal", F.struct(F.isnotnull("doc_id"), "doc_id", "ordinal")).alias("last"))
    sizes = ends.collect()  # one row for each shard file
    parts = max(1, -(-sum(r["docs"] for r in sizes) // part_keys))
    starts, at, earlier, before, done = {}, 0, [], None, 0
    for r in sorted(sizes, key=lambda r: r["shard"]):
        starts[r["shard"]] = at
        at += r["n"]
        # a doc_id that goes on from the shard before counts on
        base = done if r["low"] == before else 0
        if base:
            earlier.append((r["shard"], r["low"][1], base))
        before, done = r["high"], r["last"] + 1 + (base if r["low"] == r["high"] else 0)
    if earlier:
        more = spark.createDataFrame(earlier, "shard int, _first long, _base long")  # one row for a shard at most
        on = entries.join(F.broadcast(more), "shard", "left")
        entries = on.withColumn("ordinal", F.when(F.col("doc_id").eqNullSafe(F.col("_first")) & F.col("_base").isNotNull(), F.col("ordinal") + F.col("_base")).otherwise(F.col("ordinal"))).drop("_first", "_base")
    entries.write.parquet(f"{folder}/keys")
    entries = spark.read.schema("doc_id long, ordinal long, shard int, first long, n long").parquet(f"{folder}/keys")

    def build(pdf):
        key = document_keys(pdf["doc_id"].fillna(0).to_numpy(np.int64), pdf["doc_id"].isna().to_numpy(), pdf["ordinal"].to_numpy())
        part = int(pdf["part"].iloc[0])
        write_whole(f"{folder}/index-{part:05d}.mph", iter([pack_index(key, pdf["shard"].to_numpy(), pdf["first"].to_numpy(), pdf["n"].to_numpy())]))
        return pdf[["part"]].iloc[:1].assign(keys=len(pdf))

    keyed = entries.select("*", part_of(parts).alias("part"))
    keyed.groupBy("part").applyInPandas(build, "part int, keys long").agg(F.sum("keys")).collect()
    manifest = {"dtype": dtype, "end_id": end_id, "parts": parts, "starts": {str(k): v for k, v in starts.items()}, "ids": at}
    write_whole(f"{folder}/manifest.json", iter([json.dumps(manifest).encode()]))
    return folder


def part_of(parts: int):
    return F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(parts)).cast("int")


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def read_documents(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Read documents back by key: keys has doc_id and ordinal.  Returns doc_id, ordinal, start (ids of all documents
    before it) and ids (binary, the raw ids widened to little-endian unsigned 32-bit); a key that is not in the index
    has no row.  Keys are dealt to index parts, looked up, dealt to shards and read in the order they lie there."""
    manifest = json.loads(read_file(f"{folder}/manifest.json"))
    dtype, parts, starts = manifest["dtype"], manifest["parts"], {int(k): v for k, v in manifest["starts"].items()}
    width = np.dtype(dtype).itemsize
    where = keys.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), part_of(parts).alias("part"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for batch in batches:
            of = batch.column("part").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            key = document_keys(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column("ordinal").to_numpy(zero_copy_only=False))
            for p in np.unique(of).tolist():
                if p != at:
                    at, part = p, IndexPart(read_file(f"{folder}/index-{p:05d}.mph"))
                rows = np.flatnonzero(of == p)
                found, shard, first, n = part.find(key[rows])
                rows = rows[found]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([ids.take(take), batch.column("ordinal").take(take), pa.array(shard[found].astype(np.int32)), pa.array(first[found].astype(np.int64)), pa.array(n[found].astype(np.int64))], names=["doc_id", "ordinal", "shard", "first", "n"])

    places = where.repartition("part").sortWithinPartitions("part").mapInArrow(look_up, "doc_id long, ordinal long, shard int, first long, n long")

    def read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "first", "n")]
            start, raw, size, done = [], [], 0, 0
            for i, (shard, first, n) in enumerate(zip(*cols, strict=True)):
                if shard != at:
                    fs, path = open_fs(f"{folder}/shard-{shard:05d}.ids")
                    at, file = shard, fs.open_input_file(path)
                file.seek(first * width)
                raw.append(np.frombuffer(file.read(n * width), dtype).astype("<u4").tobytes())
                start.append(starts[shard] + first)
                size += len(raw[-1])
                if size > 1 << 24 or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[done : i + 1], batch.column("ordinal")[done : i + 1], pa.array(start, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "ordinal", "start", "ids"])
                    start, raw, size, done = [], [], 0, i + 1

    return places.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(read_ids, "doc_id long, ordinal long, start long, ids binary")


def stored_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys (doc_id, ordinal) of all documents that a folder holds."""
    return spark.read.schema("doc_id long, ordinal long").parquet(f"{folder}/keys")
