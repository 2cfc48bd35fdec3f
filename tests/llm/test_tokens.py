import gc
import random
import sys
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import sentencepiece
from pyspark import cloudpickle
from tokenizers import Tokenizer

from regionlens.functions.materialize import scratch_path
from regionlens.llm import token_counts, token_ids
from regionlens.llm.queries import op6_token_counts, op7_token_ids

from .conftest import odd_rows, order

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer.load(PIECES)


def test_transducer_counts_as_the_library(library, machine):
    rnd = random.Random(2)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(library.get_piece_size())]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    texts += ["".join(rnd.choice("abeinrst \n▁é日①\x00😀\r\t") for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    texts += [c * n for c in " a=-\n▁日" for n in range(1, 40)] + ["<s> </s> <unk>", "x  \n  y", "\n", ""]
    for t in texts:
        want = len(library.encode(t))
        assert machine.count(t) == want, t
        assert machine.count(t, chunk=3) == want, t


def test_small_tables_start_anew(library):
    machine = token_counts.Transducer(token_counts.Transducer.load(PIECES).scores, most_arcs=50)
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice("abcdefghij  ") for _ in range(60))
        assert machine.count(t) == len(library.encode(t))


def test_chunk_maps_compose_in_any_grouping(machine):
    text = "▁one▁two\n▁▁three▁four"
    maps = [machine.chunk_map(c) for c in text]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    flat = lambda m: ("".join(m.head), m.inner, "".join(m.tail), m.cut)
    assert flat(left) == flat(right) == flat(machine.scan(maps)) == flat(machine.chunk_map(text))


def test_a_long_text_without_blanks(machine, library):
    """A state goes from chunk to chunk: no text is held again for each of them."""
    import tracemalloc

    rnd = random.Random(6)
    part = "".join(rnd.choice("abcdefghinorst日本é=") for _ in range(100_000))
    text = part * 10
    assert machine.count(text) == len(library.encode(text))
    assert machine.count("no" * 300_000) == len(library.encode("no" * 300_000))
    small = token_counts.Transducer(machine.scores, most_arcs=3000)
    assert small.count(part) == len(library.encode(part))
    long = part * 80
    tracemalloc.start()
    try:
        machine.count(long)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(long)
    finally:
        tracemalloc.stop()


def test_counts_of_odd_documents(odd, none, library):
    got = token_counts.token_counts(odd).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in odd_rows()]
    assert order(map(tuple, got)) == order(want)
    assert token_counts.token_counts(none).count() == 0


def test_counts_query(spark, sf_dir, library):
    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    got = op6_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(library.encode(v)) for k, v in texts.items()}


@pytest.mark.parametrize("bits", [1, 3, 8, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_ids.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for i, j in [(0, 1001), (0, 0), (7, 8), (500, 1001), (1000, 1001)]:
        assert token_ids.unpack(packed, bits, i, j).tolist() == ids[i:j].tolist()


def digest(text):
    """Spark's xxhash64 as a signed number; NULL has the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def expected(rows):
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1]))):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        yield name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        start += len(ids)


def test_files_hold_all_ids_in_order(spark, odd, none):
    at = scratch_path(spark, "ids")
    token_ids.write_ids(odd, at)
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = list(expected(rows))
    assert order(map(tuple, token_ids.digests(spark, at).collect())) == order([w[:4] for w in want])
    some = token_ids.read_ids(spark, at, [3, 16, 9_007_199_254_740_993])
    assert {k: v.tolist() for k, v in some.items()} == {w[0]: w[4] for w in want if w[0] in (3, 16, 9_007_199_254_740_993)}
    empty = scratch_path(spark, "ids")
    token_ids.write_ids(none, empty)
    assert token_ids.digests(spark, empty).count() == 0


def test_ids_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert order(map(tuple, op7_token_ids(spark, sf_dir).collect())) == order([w[:4] for w in expected(rows)])


def test_rows_without_id_are_dealt_to_many_shards(spark):
    rows = [(None if i % 3 else i, f"text {i}") for i in range(900)]
    at = scratch_path(spark, "ids")
    token_ids.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), at)
    shards = spark.read.parquet(at).where("exists(doc_ids, x -> x IS NULL)").groupBy("shard").agg({"n_ids": "sum"}).collect()
    assert len(shards) >= 4 and max(r[1] for r in shards) < 3 * min(r[1] for r in shards) + 2000
    assert order(map(tuple, token_ids.digests(spark, at).collect())) == order([w[:4] for w in expected(rows)])


def test_words_are_forgotten_and_learned_again():
    tokenizer, mine = Tokenizer.from_file(WORDS), token_ids.Encoder(WORDS, most_bytes=5000)
    rnd = random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 40))) for _ in range(5)]
        ids, ends = mine.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_words_are_no_python_objects():
    tokenizer, mine = Tokenizer.from_file(WORDS), token_ids.Encoder(WORDS)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(40_000)]
    texts = pa.array([" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)])
    mine.encode(pa.array(["warm up"]))
    before = sys.getallocatedblocks()
    ids, ends = mine.encode(texts)
    assert sys.getallocatedblocks() - before < 5000  # two a word would stay in a worker's memory, in holes
    assert mine.held > 40_000 * 9 and mine.held < mine.most_bytes
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    again, _ = mine.encode(texts)
    assert again.tolist() == ids.tolist()


def test_special_strings_and_blanks_encode_alike():
    tokenizer, mine = Tokenizer.from_file(WORDS), token_ids.Encoder(WORDS)
    rnd = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "it's", "I'LL", "é", "é", "ΣΑΣ", "İ", "１２3", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", " ", "日本", "😀", "...", "<|"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    assert mine.fast
    letters = "".join(chr(c) for c in range(1, 0x250))
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    texts += [c * n for c in letters for n in (1, 2)] + ["Σς ΣΑΣ. Dz Ŀ ŉ a,. b.,a ,a a!!! B%%$, c|d e|| f*#& g\"), h)"]
    marks = ".,;:!?*$%&#|)\"'<>(-"
    texts += [rnd.choice(["a", "Bé", "c9"]) + "".join(rnd.choice(marks) for _ in range(rnd.randint(1, 5))) for _ in range(2000)]
    ids, ends = mine.encode(pa.array(texts))
    for t, got in zip(texts, np.split(ids, ends[:-1])):
        assert got.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("task", [lambda: token_ids._encoded(WORDS, 1, []), lambda: token_ids._blocks(16, 2)], ids=["encoded", "blocks"])
def test_batches_in_a_cycle_are_given_back(task):
    held = [pa.array(["some text"])]
    held.append(held)
    ref = weakref.ref(held[0])
    gc.disable()
    try:
        del held
        assert list(task()(iter([]))) == []
        assert ref() is None
    finally:
        gc.enable()


def test_no_encoder_travels_with_a_task(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some text, here.")], "doc_id long, text string")
    token_ids.write_ids(docs, f"{tmp_path}/ids")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None], "text": ["Some text, here.", None], "digest": [5, 6]})
    task = token_ids._encoded(WORDS, 1, [])
    (out,) = task(iter([batch]))
    assert [len(i) // 2 for i in out.column("ids").to_pylist()] == [len(Tokenizer.from_file(WORDS).encode("Some text, here.").ids) + 1, 1]
    assert len(cloudpickle.dumps(task)) < 100_000
