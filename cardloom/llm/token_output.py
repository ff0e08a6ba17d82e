"""Token ids in binary shards: a zstandard dictionary for all shards, one frame for each document.

A folder holds `dictionary.zdict`, `manifest.json` and shards `shard-NNNNNN.tok`. A shard is

    magic "CLT1", width of an id in bytes (1 byte), SHA-256 of the dictionary (32 bytes)
    one zstandard frame for each document: its ids as little-endian unsigned integers of that width
    index: for each document doc_id (int64), is-null flag (uint8), frame offset (uint64), frame length (uint32), ids (uint64)
    offset of the index (uint64), number of documents (uint64), magic "CLT1"

so that one document costs two small reads and one frame. Documents ascend by doc_id through the shards (null first;
rows of the same doc_id stand together in any order).

Defined results: a null or empty text has only the end id; rows with the same doc_id are each written; an empty table
gives a folder without shards. The dictionary is trained on a bounded sample: SAMPLE_DOCS documents by a hash of their id, of
each SAMPLE_PIECES pieces of SAMPLE_PIECE ids spread over the whole document; every document is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import arrow_schema, hash_share, map_arrow, new_path, prepare, release, utf8

MAGIC = b"CLT1"
HEAD = len(MAGIC) + 1 + 32
TAIL = "<QQ4s"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u8")])
#: Documents in a shard, about; and of the sample that the dictionary is trained on.
SHARD_DOCS, SAMPLE_DOCS, SAMPLE_PIECES, SAMPLE_PIECE, DICTIONARY_BYTES, LEVEL = 8_192, 2_000, 4, 2_048, 65_536, 1
#: Rows of a batch: of more texts at once fewer words are new. Words whose ids a worker remembers.
ROWS = 512
MEMO = 700_000


#: Words of a-z and of the small letters from U+00DF to U+00FF.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
LETTER_STOP = re.compile(rb"([a-z])([.,])")


class Encoder:
    """Serialized ids of texts, word by word.

    The tokenizer's own rules drop white space and never join what stands on both sides of it, so the ids of a text
    are those of its words (split at ASCII white space) one after the other; most words have been seen before. New
    words of a batch go to the tokenizer as one text, and the offsets of its ids tell the words apart.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer, normalizers
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memo: dict[bytes, bytes] = {}
        # words of small Latin letters alone need neither normalizing nor cutting; each ends with its only end-of-word id
        self.plain = Tokenizer.from_file(tokenizer_path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[k for w, k in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        split = [self.words(x or b"") for x in texts]
        new = [w for w in set(chain.from_iterable(split)) if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(set(chain.from_iterable(split)))
        plain = [w for w in new if LETTERS.fullmatch(w)] if self.ends.any() else []
        other = list(set(new).difference(plain))
        for k in range(0, len(plain), 20_000):
            self.learn_plain(plain[k : k + 20_000])
        for k in range(0, len(other), 20_000):
            self.learn(other[k : k + 20_000])
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in split]

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """Cut where the tokenizer cuts in any case: at white space, and between a letter and a full stop or comma.

        It also lower-cases, which makes fewer different words of them; but not where a special token could stand.
        """
        return (text if b"<|" in text else LETTER_STOP.sub(rb"\1 \2", text.lower())).split()

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, f"<u{self.width}")
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        of = np.searchsorted(begins, [a for a, _ in found.offsets], "right") - 1
        self.remember(words, ids, np.searchsorted(of, np.arange(len(words) + 1)))

    def learn_plain(self, words: list[bytes]) -> None:
        found = self.plain.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(found.ids, f"<u{self.width}")
        self.remember(words, ids, np.r_[0, np.flatnonzero(self.ends[ids]) + 1])

    def remember(self, words: list[bytes], ids: np.ndarray, cuts: np.ndarray) -> None:
        data, w, cuts = ids.tobytes(), self.width, cuts.tolist()
        if len(cuts) != len(words) + 1:
            raise ValueError("the tokenizer's ids don't fall apart into words")
        self.memo.update((word, data[a * w : b * w]) for word, a, b in zip(words, cuts, cuts[1:], strict=False))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES; of plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or bytes(8)


def _sample(docs: DataFrame, tokenizer_path: str, width: int) -> list[bytes]:
    n = docs.count()
    rate = min(1.0, SAMPLE_DOCS / max(1, n))
    picked = docs.where(F.coalesce(hash_share("doc_id", "dictionary"), F.lit(0.0)) < rate).limit(2 * SAMPLE_DOCS)

    def pieces(batch: pa.RecordBatch) -> dict:
        out, step = [], SAMPLE_PIECE * width
        for ids in encoder(tokenizer_path)(list(utf8(batch.column(0)))):
            # at most SAMPLE_PIECES pieces, spread over the whole text
            pieces = -(-len(ids) // step)
            out += [ids[k * step : (k + 1) * step] for k in range(0, pieces, -(-pieces // SAMPLE_PIECES) or 1)]
        return {"piece": pa.array(out, pa.binary())}

    return sorted(r[0] for r in map_arrow(picked.select("text"), pieces, "piece binary").collect())


def _bounds(docs: DataFrame) -> list[int]:
    """Upper doc_ids of all shards but the last; from doc_id alone."""
    n = docs.count()
    shards = math.ceil(n / SHARD_DOCS)
    if shards < 2:
        return []
    at = [k / shards for k in range(1, shards)]
    return docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * shards))).first()[0] or []


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1) -> dict:
    """Encode every whole text, write the shards to folder, return the manifest."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    prepare(spark, ROWS)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(_sample(docs, tokenizer_path, width))
    digest = hashlib.sha256(dictionary).digest()
    files.write(f"{folder}/dictionary.zdict", dictionary)
    bounds = np.array(_bounds(docs), np.int64)
    end = b"" if end_id is None else end_id.to_bytes(width, "little")

    def encoded(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
        frames, counts, spread = [], [], []
        for ids in encoder(tokenizer_path)(list(utf8(batch.column(1)))):
            frames.append(pack.compress(ids + end))
            counts.append(len(ids + end) // width)
            spread.append(zlib.crc32(frames[-1]))
        # a doc_id that fills several shards is dealt over all of them
        shard = low + np.array(spread, np.int64) % (high - low + 1)
        return {"shard": shard, "doc_id": batch.column(0), "ids": np.array(counts, np.int64), "frame": pa.array(frames, pa.binary())}

    frames = map_arrow(docs, encoded, "shard int, doc_id bigint, ids bigint, frame binary")
    done_schema = "shard int, path string, docs bigint, ids bigint, bytes bigint"

    def write_shard(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
        shard = table.column("shard")[0].as_py()
        parts = table.column("frame").to_pylist()
        index = np.zeros(len(parts), INDEX)
        index["doc_id"] = table.column("doc_id").fill_null(0).to_numpy()
        index["null"] = table.column("doc_id").is_null().to_numpy()
        index["length"] = [len(x) for x in parts]
        index["offset"] = HEAD + np.cumsum(index["length"], dtype=np.uint64) - index["length"]
        index["ids"] = table.column("ids").to_numpy()
        body = b"".join([MAGIC, bytes([width]), digest, *parts])
        data = body + index.tobytes() + struct.pack(TAIL, len(body), len(parts), MAGIC)
        files.write(path := f"{folder}/shard-{shard:06d}.tok", data)
        release()
        row = [[shard], [path], [len(parts)], [int(index["ids"].sum())], [len(data)]]
        return pa.table(row, schema=arrow_schema(done_schema))

    # this runs before the function returns, so the wider batches are its own
    shards = sorted(map(tuple, frames.groupBy("shard").applyInArrow(write_shard, done_schema).collect()))
    prepare(spark)
    starts = np.cumsum([0, *(s[3] for s in shards)]).tolist()
    manifest = {
        "tokenizer_sha256": hashlib.sha256(open(tokenizer_path, "rb").read()).hexdigest(),
        "dictionary_sha256": digest.hex(),
        "id_bytes": width,
        "end_id": end_id,
        "shards": [dict(zip(("shard", "path", "docs", "ids", "bytes"), s, strict=True), start=a) for s, a in zip(shards, starts, strict=False)],
    }
    files.write(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        self.path = path
        size = files.file_size(path)
        at, n, magic = struct.unpack(TAIL, files.read_range(path, size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
        head = files.read_range(path, 0, HEAD)
        if magic != MAGIC or head[:4] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        if head[5:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = f"<u{head[4]}"
        self.index = np.frombuffer(files.read_range(path, at, n * INDEX.itemsize), INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int, data: bytes | None = None) -> np.ndarray:
        """Ids of the k-th document; data: the whole file, if it has been read."""
        a, n = int(self.index["offset"][k]), int(self.index["length"][k])
        frame = data[a : a + n] if data is not None else files.read_range(self.path, a, n)
        return np.frombuffer(self.unpack.decompress(frame), self.kind)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    manifest = json.loads(files.read(f"{folder}/manifest.json"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    rows = [(s["path"], s["start"]) for s in manifest["shards"]]
    if not rows:
        return spark.createDataFrame([], schema)

    def checked(batch: pa.RecordBatch):
        dictionary = files.read(f"{folder}/dictionary.zdict")
        outs = []
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard, data = Shard(path, dictionary), files.read(path)
            n = len(shard.index)
            crc = np.fromiter((zlib.crc32(shard.ids(k, data).astype("<u4")) for k in range(n)), np.int64, n)
            lengths = shard.index["ids"].astype(np.int64)
            ids = pa.array(shard.index["doc_id"], mask=shard.index["null"].astype(bool))
            outs.append((ids, start + np.cumsum(lengths) - lengths, lengths, crc))
        joined = [np.concatenate(x) for x in list(zip(*outs, strict=True))[1:]]
        return dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), [pa.concat_arrays([o[0] for o in outs]), *joined], strict=True))

    listed = spark.createDataFrame(rows, "path string, start bigint").repartition(len(rows))
    return map_arrow(listed, checked, schema)


def token_report(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write docs to folder (a new one in the shared folder by default) and describe what the files hold."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    write_tokens(docs, folder, tokenizer_path)
    return read_tokens(spark, folder)
