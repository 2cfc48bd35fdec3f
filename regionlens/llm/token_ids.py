"""Token ids in files of fixed-width packed blocks.

A row of the files is a block of whole documents: the ids lie one after another in the fewest bits that
hold the vocabulary, lowest bit first, and the offsets of the documents stand beside them.  Id ``i`` of
a block begins at bit ``i * bits``, so any stretch is unpacked by numpy without reading what
lies before it.  The container is Parquet, because Spark commits and reads it in any shared store.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import zlib
from collections.abc import Iterator
from bisect import bisect_right
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BLOCK = 1 << 16  # ids after which a block is closed, at the end of a document
SLAB_BYTES = 4_000_000
SLAB_TEXTS = 2048
LEARN = 10_000  # words that are Python's objects at once
GATHER = 100_000  # words whose ids are put in order at once
MOST_BYTES = 48 << 20  # of remembered words and their ids, after which a task keeps only those of the latest texts
WORD_BYTES = 120  # more than a remembered word takes besides its letters and ids, while words are looked up
BLOCKS = (
    "shard int, block int, local_start long, bits int, n_ids long, doc_ids array<long>, ends array<long>, payload binary"
)
ARROW = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
ARROW_SCHEMA = pa.schema([(c.split()[0], t) for c, t in zip(BLOCKS.split(", "), ARROW)])


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):  # the same bytes without single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    shifts = np.arange(bits, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(payload: bytes | pa.Buffer, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    first, last = start * bits, stop * bits
    part = np.frombuffer(payload, np.uint8)[first // 8 : -(-last // 8)]
    flat = np.unpackbits(part, bitorder="little")[first % 8 : first % 8 + last - first]
    out = np.zeros(stop - start, np.uint32)
    for i in range(bits):
        out |= flat[i::bits].astype(np.uint32) << np.uint32(i)
    return out


# Letters that normalise to themselves up to case, and marks that may stand behind them.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0139-\u017e]+")
MARKS = ".,;:!?*$%&#|)\""


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and number the others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of whole texts, encoding each different word once while it is remembered.

    The tokenizer drops white space and works on each stretch between blanks and line ends alone:
    normalisation, splitting and special strings never reach over them.  The library encodes each different stretch.
    One of plain letters needs only the library's merges, which it runs over many of them at a time: where the
    library is asked to show at start that it lowers case, maps bytes to letters and ends words
    with a sign of their end.  Marks behind the letters are split off before the merges, by the library too.
    """

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.most_bytes = most_bytes
        self._empty()
        self.letters = byte_letters()
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.between = special[0] if special else None
        self.cut = self.tokenizer.token_to_id(self.between) if special else None
        self.marks: dict[str, np.ndarray] = {}
        probe = pa.array(["probe", "ÉTÉ,", "naïve.", "Żółw", "ß", "It.,"])
        whole = [self._whole(w) for w in probe.to_pylist()]
        try:
            ids, sizes = self._plain(probe, pc.utf8_rtrim(probe, characters=MARKS))
            self.fast = sizes.tolist() == [len(w) for w in whole] and ids.tolist() == np.concatenate(whole).tolist()
        except ValueError:
            self.fast = False

    def _whole(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4")

    def _plain(self, words: pa.Array, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters (the cores) with marks behind them, and their numbers."""
        letters = self.letters | {32: " "}
        texts = [
            " ".join(cores.slice(at, 1000).to_pylist()).lower().encode().decode("latin-1").translate(letters)
            for at in range(0, len(cores), 1000)
        ]
        # A few at a time: the library's results take a hundred bytes per id.
        groups = (self.merges.encode_batch_fast(texts[at : at + 8], add_special_tokens=False) for at in range(0, len(texts), 8))
        ids = np.concatenate([np.array(e.ids, "<u4") for e in chain.from_iterable(groups)])
        sizes = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if len(sizes) != len(cores) or sizes.sum() != len(ids):
            raise ValueError("a word has no sign of its end")
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(words), pc.binary_length(cores)).to_numpy(zero_copy_only=False))
        if not len(marked):
            return ids, sizes
        coded = pc.replace_substring_regex(words.take(pa.array(marked)), f"^{LETTERS.pattern}", "").dictionary_encode()
        marks = [self._mark(m) for m in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, marks), np.int64, len(marks))
        # Two parts a word: the ids of its letters and those of its marks, which all stand behind them.
        starts, parts = np.zeros((2, len(words), 2), np.int64)
        starts[:, 0], parts[:, 0] = np.cumsum(sizes) - sizes, sizes
        own = coded.indices.to_numpy(zero_copy_only=False)
        starts[marked, 1], parts[marked, 1] = (len(ids) + np.cumsum(lengths) - lengths)[own], lengths[own]
        return np.concatenate([ids, *marks])[stretches(starts.ravel(), parts.ravel())], parts.sum(axis=1)

    def _mark(self, mark: str) -> np.ndarray:
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[mark] = self._whole(mark)
        return self.marks[mark]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of other words, many at a time: a special token between them is cut out before anything else happens."""
        found, sizes = [], []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = self._whole(self.between.join(part))
            between = ids == self.cut
            sizes.append(np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1)
            if len(sizes[-1]) != len(part):
                raise ValueError("a word has the special token")
            found.append(ids[~between])
        return np.concatenate(found), np.concatenate(sizes)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and the number of those of each word."""
        cores = pc.utf8_rtrim(words, characters=MARKS)
        # A word with a part of a special string goes alone.
        alone = np.ones(len(words), bool)
        if self.between is not None:
            parts = (pc.match_substring(words, x).to_numpy(zero_copy_only=False) for x in ("<|", self.between))
            alone = np.logical_or(*parts)
        plain = np.zeros(len(words), bool)
        if self.fast:
            plain = pc.match_substring_regex(cores, f"^{LETTERS.pattern}$").to_numpy(zero_copy_only=False)
        places = [np.flatnonzero(x) for x in (plain, ~plain & ~alone, ~plain & alone)]
        letters, others, single = (words.take(pa.array(x)) for x in places)
        got = []
        if len(letters):
            got.append(self._plain(letters, cores.take(pa.array(places[0]))))
        if len(others):
            got.append(self._together(others.to_pylist()))
        got += [(ids, np.array([len(ids)])) for ids in map(self._whole, single.to_pylist())]
        ids, sizes = (np.concatenate(x) for x in zip(*got))
        back = np.argsort(np.concatenate(places))
        return ids[stretches((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def _empty(self) -> None:
        """No words; the arrays of their ids and of the places where those of each word begin have room to grow.

        The words are an Arrow array: many small objects would leave holes that a worker does not give back.
        """
        self.words = pa.array([], pa.string())
        self.ids, self.starts = np.zeros(1 << 16, "<u2" if self.size <= 1 << 16 else "<u4"), np.zeros(1 << 14, np.int64)
        self.held = 0

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember words; what is known stays where it is."""
        known = len(self.words)
        begin, end = int(self.starts[known]), int(self.starts[known]) + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        if known + len(words) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(words) + 1), np.int64)])
        self.ids[begin:end] = ids
        self.starts[known + 1 : known + 1 + len(words)] = begin + np.cumsum(sizes)
        self.words = pa.concat_arrays([self.words, words])
        self.held += words.nbytes + WORD_BYTES * len(words) + ids.nbytes

    def _lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of the ids of each of the different words, after learning those not known."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, ids, sizes = words.take(pa.array(missing)), [], []
            for begin in range(0, len(new), LEARN):
                got, size = self._learn(new.slice(begin, LEARN))
                ids.append(got.astype(self.ids.dtype))
                sizes.append(size)
            at[missing] = len(self.words) + np.arange(len(missing))
            self._add(new, np.concatenate(ids), np.concatenate(sizes))
        return self.starts[at], self.starts[at + 1] - self.starts[at]

    def _forget(self, words: pa.Array, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Keep only the words used last."""
        kept = self.ids[stretches(starts, sizes)]
        self._empty()
        self._add(words, kept, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends. There are no NULLs among them."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        starts, sizes = self._lookup(words)
        # From the ids of each different word to those of the words in their order.
        place = coded.indices.to_numpy(zero_copy_only=False)
        size = sizes[place]
        ends = np.cumsum(size)
        out = np.empty(int(size.sum()), self.ids.dtype)
        for at in range(0, len(place), GATHER):
            part, base = slice(at, at + GATHER), int(ends[at] - size[at])
            flat = np.repeat(starts[place[part]] - (ends[part] - size[part]), size[part])
            flat += np.arange(base, base + len(flat))
            out[base : base + len(flat)] = self.ids[flat]
        if self.held > self.most_bytes:
            self._forget(words, starts, sizes)
        lists = split.offsets.to_numpy()
        return out, np.concatenate([[0], ends])[lists[1:] - lists[0]]


def _give_back() -> None:
    """Return freed memory to the system, that of large arrays at once; by default a worker keeps it while it is idle.

    An executor holds more workers than it has cores, because the next task may start before a worker is free again.
    The batches of a task may hang in a cycle of few objects, so the collector, which counts objects, would not come for them.
    """
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # what a worker keeps for good, that later collections are short
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


def _slabs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are encoded at once: of some thousand, or fewer if they are long."""
    at = held = 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held > SLAB_BYTES or i + 1 - at >= SLAB_TEXTS:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _encoded(path: str, end_id: int, bounds: list[tuple]):
    """Ids of every text where it is read, and the range that its document falls into.

    A task loads its own encoder: the package travels by value, so one kept in the module would be sent with every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        encoder = Encoder(path)
        for batch in batches:
            texts = batch.column("text")
            texts = texts.fill_null("") if texts.null_count else texts
            for at, to in _slabs(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                gc.disable()  # many small objects, none in a cycle
                got, stops = encoder.encode(texts.slice(at, to - at))
                gc.enable()
                got = np.insert(got, stops, end_id)
                ends = stops + np.arange(1, len(stops) + 1)
                names, digests = (batch.column(c).slice(at, to - at) for c in ("doc_id", "digest"))
                keys = zip(names.is_valid().to_pylist(), names.fill_null(0).to_pylist(), digests.to_pylist())
                shards = [bisect_right(bounds, k) for k in keys]
                offsets = pa.py_buffer((np.concatenate([[0], ends]) * got.itemsize).astype("<i4"))
                ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(got)])
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), names, digests, ids], names=["shard", "doc_id", "digest", "ids"])
        # A worker that waits for its next task holds no batches, words or vocabulary.
        batch = texts = names = digests = got = offsets = ids = encoder = None
        _give_back()

    return run


def _blocks(bits: int, width: int):
    """Blocks of whole documents from rows in the order of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        ends: list[int] = []
        shard = done = held = block = 0

        def close() -> pa.RecordBatch:
            payload = pack(np.concatenate(ids), bits)
            row = (shard, block, done, bits, held, names, ends, payload)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW)], schema=ARROW_SCHEMA)

        for batch in batches:
            for own, name, row in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if own != shard:
                    if names:
                        yield close()
                    shard, done, held, block = own, 0, 0, 0
                    ids, names, ends = [], [], []
                ids.append(np.frombuffer(row.as_buffer(), f"<u{width}"))
                held += len(ids[-1])
                names.append(name)
                ends.append(held)
                if held >= BLOCK:
                    yield close()
                    done, block, held = done + held, block + 1, 0
                    ids, names, ends = [], [], []
        if names:
            yield close()
        batch = row = ids = names = ends = None
        _give_back()

    return run


def _bounds(plain: DataFrame, ranges: int) -> list[tuple]:
    """Where ranges of documents of about equal numbers begin, by id and digest, so that rows of one id are dealt as well."""
    key = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("digest").alias("c"))
    rows = (
        plain.select("doc_id", "digest")
        .repartitionByRange(ranges, "doc_id", "digest")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(key).alias("low"))
        .collect()
    )
    return [tuple(r["low"]) for r in sorted(rows, key=lambda r: r["part"])][1:]


def write_ids(
    docs: DataFrame, to: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text, append ``end_id`` and write the blocks below ``to`` in ascending order of the ids.

    NULL texts are empty, so they hold the end id alone; NULL ids come first; rows with equal ids follow a
    digest of their texts.  Other columns are ignored; an empty table writes no blocks.  Texts are encoded where they
    are read, in slabs; only their ids are shuffled, once, to ranges of (id, digest), which split rows of one id too.
    A shard is one range, written block by block and never held as a whole; a very long text is a slab and a block of
    its own.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    size = Encoder(path).size
    bits = max(1, int(size - 1).bit_length())
    if end_id >= 1 << bits:
        raise ValueError("the end id does not fit the vocabulary")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    spark, rows = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(rows)
    # Texts are long; what is on its way between Spark and a worker should stay some megabytes.
    spark.conf.set(rows, str(SLAB_TEXTS))
    try:
        (
            plain.mapInArrow(_encoded(path, end_id, _bounds(plain, ranges)), "shard int, doc_id long, digest long, ids binary")
            .repartitionById(ranges, F.col("shard"))
            .sortWithinPartitions("shard", "doc_id", "digest", "ids")
            .mapInArrow(_blocks(bits, 2 if size <= 1 << 16 else 4), BLOCKS)
            .write.parquet(to)
        )
    finally:
        spark.conf.set(rows, before)


def _starts(spark: SparkSession, at: str) -> DataFrame:
    """``shard, before``: ids in all shards before. One row per task of the job that wrote the files."""
    sizes = spark.read.schema(BLOCKS).parquet(at).groupBy("shard").agg(F.sum("n_ids")).collect()
    rows, total = [], 0
    for shard, n in sorted((r[0], r[1]) for r in sizes):
        rows.append((shard, total))
        total += n
    return spark.createDataFrame(rows, "shard int, before long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            value = {name: batch.column(name)[i] for name in batch.schema.names}
            ids = unpack(value["payload"].as_buffer(), value["bits"].as_py(), 0, value["n_ids"].as_py()).astype("<u4")
            ends = value["ends"].values.to_numpy()
            begins = np.concatenate([[0], ends[:-1]])
            crcs = np.array([zlib.crc32(ids[i:j]) for i, j in zip(begins.tolist(), ends.tolist())], np.int64)
            columns = {
                "doc_id": value["doc_ids"].values,
                "shard": pa.array(np.full(len(ends), value["shard"].as_py(), np.int32)),
                "local": pa.array(begins + value["local_start"].as_py()),
                "n_tokens": pa.array(ends - begins),
                "ids_crc32": pa.array(crcs),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    _give_back()


def digests(spark: SparkSession, at: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, unpacked from the files.

    ``start`` counts the ids of all documents before; the blocks themselves are not shuffled for it.
    """
    blocks = spark.read.schema(BLOCKS).parquet(at).select("shard", "local_start", "bits", "n_ids", "doc_ids", "ends", "payload")
    found = blocks.mapInArrow(_digests, "doc_id long, shard int, local long, n_tokens long, ids_crc32 long")
    return found.join(_starts(spark, at), "shard").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, at: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of a few documents; of their blocks only the wanted bits are unpacked."""
    rows = (
        spark.read.schema(BLOCKS)
        .parquet(at)
        .where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(d)).cast("long") for d in doc_ids])))
        .select("doc_ids", "ends", "bits", "payload")
    )
    wanted, out = set(doc_ids), {}
    for r in rows.toLocalIterator():
        begins = [0, *r.ends[:-1]]
        for name, i, j in zip(r.doc_ids, begins, r.ends):
            if name in wanted:
                out[name] = unpack(bytes(r.payload), r.bits, i, j)
    return out
