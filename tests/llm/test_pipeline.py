import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm import brute
from tests.llm.test_language import prose

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        lang = rng.choice(["xx", "yy"])
        text = prose(rng, lang, rng.randint(8, 50))
        if i % 10 == 3:
            text = rows[-1][1] + " tail"
        if i % 17 == 5:
            text = f"{text} {ITEM} {text}"
        if i % 23 == 7:
            text = rng.choice([None, "12 34 !!", ""])
        rows.append((i, text, lang if i % 5 else None, f"src{i % 4}" if i % 9 else None, len(text or "")))
    rows.append((3, rows[3][1], "xx", "src1", 4))  # repeats a doc_id
    rows.append((None, "kato rimu", "xx", "src1", 4))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "token_output":
            assert docs.columns == list(p.COLUMNS)
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            after[name] = [tuple(r) for r in docs.collect()]

    kept = [r for r in rows if r[0] is not None and any(c.isalpha() for c in r[1] or "")]
    assert sorted(after["language_id"], key=str) == sorted(kept, key=str)
    groups = brute.components([(d, t) for d, t, *_ in dict((r[0], r) for r in kept).values()])
    kept = [r for r in dict((r[0], r) for r in reversed(kept)).values() if groups[r[0]][1] == r[0]]
    assert sorted(r[0] for r in after["jaccard_join"]) == sorted(r[0] for r in kept)
    clean = [r for r in kept if not brute.contamination(r[1], [(1, ITEM)])[1]]
    assert sorted(r[0] for r in after["decontamination"]) == sorted(r[0] for r in clean) and len(clean) < len(kept)
    mixed = after["mixing"]
    assert {r[0] for r in mixed} <= {r[0] for r in clean}
    size = lambda rs: sum(len(brute.WORDS.findall(r[1])) for r in rs)
    assert abs(size(mixed) - size(clean)) < 0.05 * size(clean)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, at = sorted(docs.collect(), key=lambda r: r.start), 0
    for r, (d, text, *_) in zip(got, sorted(mixed, key=lambda r: (r[0], r[1])), strict=True):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_gives_the_last_stages_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_of_one_doc_id_are_decided_alone(spark, tmp_path):
    rng = random.Random(8)
    one, two, three = (prose(rng, "xx", 40) for _ in range(3))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(stage, *pairs):
        rows = [(d, t, "xx", "src", len(t or "")) for d, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        df.write.parquet(path := f"{tmp_path}/{stage.__name__}-{len(pairs)}")
        return sorted((r.doc_id, r.text) for r in stage(spark, spark.read.parquet(path), str(tmp_path)).collect())

    assert after(p.language_stage, (1, one), (1, None), (1, "12 !"), (2, two)) == sorted([(1, one), (2, two)])
    assert after(p.duplicates_stage, (1, one), (1, two), (2, two), (3, three), (3, three)) == sorted([(1, one), (1, two), (3, three)])
    assert after(p.duplicates_stage, (9, one), (9, two), (4, two + " tail")) == sorted([(9, one), (4, two + " tail")])
    assert after(p.contamination_stage, (1, one), (1, f"{two} {ITEM}"), (2, three)) == sorted([(1, one), (2, three)])
    mixed = after(p.mixing_stage, *[(k // 2, f"w{k} " * 20) for k in range(40)])
    assert len(mixed) == 40 and {d for d, _ in mixed} <= set(range(20))


def test_without_labels_texts_with_letters_stay(spark):
    df = spark.createDataFrame([(1, "kato rimu", None, "s", 9), (2, None, None, "s", 0), (3, "12 !", None, "s", 4), (4, "berung", None, "s", 6)], SCHEMA)
    assert sorted(r.doc_id for r in p.language_stage(spark, df, "").collect()) == [1, 4]


def test_workers_remember_little_after_the_token_stage(spark):
    rng = random.Random(8)
    words = lambda: " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(200))
    docs = spark.createDataFrame([(i, f"{words()} so it goes so it goes") for i in range(200)], "doc_id long, text string")
    assert p.tokens_stage(spark, docs, "").count() == 200

    def probe(batches):
        from gridloom.llm import tokenizing

        for _ in batches:
            for enc in tokenizing._loaded.values():
                yield pa.record_batch([pa.array([max(len(x) for x in vars(enc.units).values() if isinstance(x, (dict, pa.Array)))])], ["units"])

    held = [r.units for r in spark.range(64).repartition(16).mapInArrow(probe, "units long").collect()]
    assert held and max(held) < 1000
