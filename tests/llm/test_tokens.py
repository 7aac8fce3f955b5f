import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridloom.llm import tokenizing
from gridloom.llm.shared import scratch
from gridloom.llm.token_counts import token_counts
from gridloom.llm.token_output import DacReader, dac_bytes, read_token_shards, write_token_shards
from gridloom.llm.tokenizing import Encoder, safe_pieces, tokenizer_file

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", " \n", "\t", "a", "the", "é", "12", "'s", "!", "<|endoftext|>", "\xa0", "　", "\x1c", "中", "😀", "Ġ", ".", ""]


def random_texts(n):
    random.seed(5)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 40))) for _ in range(n)]


TOKENIZER = Tokenizer.from_file(BYTES)


def plain(texts):
    return [TOKENIZER.encode(x, add_special_tokens=False).ids for x in texts]


def test_units_give_the_librarys_ids():
    texts = random_texts(3000)
    enc = Encoder(*tokenizer_file(BYTES))
    assert [x.tolist() for x in enc.run(pa.array(texts), False)] == plain(texts)
    assert enc.run(pa.array(texts), True) == [len(x) for x in plain(texts)]


def test_a_small_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_UNITS", 60)
    monkeypatch.setattr(tokenizing, "BATCH_BYTES", 400)
    texts = random_texts(400) + ["the a é"] * 40
    assert [x.tolist() for x in Encoder(*tokenizer_file(BYTES)).run(pa.array(texts), False)] == plain(texts)


def test_units_cost_no_python_string_and_single_ones_are_forgotten():
    random.seed(6)
    texts = [" ".join("".join(random.choices("abcdefghij", k=9)) for _ in range(500)) + " so it goes so it goes" for _ in range(100)]
    want, texts, enc = plain(texts), pa.array(texts), Encoder(*tokenizer_file(BYTES))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    got = enc.run(texts, False)
    (held, most), arrow = tracemalloc.get_traced_memory(), pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert [x.tolist() for x in got] == want
    assert held + arrow < 3 << 20 and most < 10 << 20  # 9 and 14 MB where each unit is a string in a dictionary


def test_a_remembered_unit_goes_to_the_library_once(monkeypatch):
    enc = Encoder(*tokenizer_file(BYTES))
    texts = pa.array(["x the one", "y the\n one", "z the one"])
    want, whole, sent = plain(texts.to_pylist()), enc.units.whole, []
    monkeypatch.setattr(enc.units, "whole", lambda some: (sent.extend(some), whole(some))[1])
    assert [x.tolist() for x in enc.run(texts, False)] == want and any(" the" in x for x in sent)
    sent.clear()
    assert [x.tolist() for x in enc.run(texts.slice(0, 1), False)] == want[:1] and not any(" the" in x or " one" in x for x in sent)


def test_safe_pieces_keep_the_tokens():
    for text in random_texts(300):
        pieces = safe_pieces(text, 5)
        assert "".join(pieces) == text
        assert [i for p in plain(pieces) for i in p] == plain([text])[0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path = public_tokenizers.path(name)
    texts = [None, "", "one two  three", "x" * 3000, "long text here " * 400_000 if name.startswith("byte") else "short"] + random_texts(50)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "a b", 7), (0, None, 7)], "doc_id long, text string, n_tokens int")
    rows = token_counts(df, path, 10).collect()
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(sp.encode(t or "")) for t in texts]
    else:
        t_ = Tokenizer.from_file(path)
        want = [len(t_.encode(t or "", add_special_tokens=False)) for t in texts]
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2 and [got[i].n_tokens for i in range(len(texts))] == want
    assert all(r.over_limit == (r.n_tokens > 10) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id is not None)
    assert token_counts(df.where("false"), path, 10).count() == 0


def test_unknown_tokenizer(tmp_path):
    (tmp_path / "x.txt").write_bytes(b"")
    with pytest.raises(ValueError):
        Encoder(*tokenizer_file(str(tmp_path / "x.txt")))


def test_codes_are_directly_addressable():
    rng = np.random.default_rng(1)
    lens = [0, 1, 700, 3, 2000]
    ids = np.concatenate([rng.integers(0, 256, 900), rng.integers(0, 50_000, 1000), rng.integers(0, 2**32, 804)]).astype(np.uint32)
    rng.shuffle(ids)
    data = dac_bytes([5, None, -7, 8, 9], lens, ids)
    reads = []
    r = DacReader(lambda a, n: (reads.append(n), data[a : a + n])[1])
    docs, starts = r.documents()
    assert docs == [5, None, -7, 8, 9] and np.diff(starts).tolist() == lens
    assert r.slice(0, len(ids)).tolist() == ids.tolist() and r.slice(100, 1900).tolist() == ids[100:1900].tolist()
    reads.clear()
    assert [r.access(i) for i in range(0, len(ids), 97)] == ids[::97].tolist()
    assert max(reads) <= 64  # a block of bits, a count or a chunk at a time
    assert r.slice(3, 3).tolist() == [] and DacReader(lambda a, n: dac_bytes([], [], ids[:0])[a : a + n]).n_ids == 0


def test_shards_round_trip(spark):
    texts = [None, "", "the same", "the same", "x" * 5000] + random_texts(40)
    rows = [(i * 3 - 20, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s"), (4, "again", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = sorted(read_token_shards(write_token_shards(df, scratch(spark, "t"), BYTES)).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for g, (d, t, _) in zip(got, want, strict=True):
        ids = np.array(plain([t or ""])[0] + [0], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_no_documents_no_shards(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert read_token_shards(write_token_shards(df, scratch(spark, "t"), BYTES)).count() == 0
