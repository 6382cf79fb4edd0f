from concurrent.futures import ThreadPoolExecutor

import numpy as np

import corpus_pipeline
from tests.llm.conftest import long_text
from tidemark.llm import toxicity, warc
from tidemark.llm.near_dedup import near_groups
from tidemark.llm.shingling import word_bounds, word_hashes
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.tokens import WordEncoder


def test_stages_chained_without_writing_between(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0 and docs.count() == docs.select("doc_id").count()


def test_two_runs_at_once(spark, sf_dir):
    with ThreadPoolExecutor(2) as pool:
        one, other = pool.map(lambda _: sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()), range(2))
    assert one == other and one


def test_the_sample_drops_no_long_text(spark):
    kept = range(1, 200)
    texts = [(d, "x" * (400_000 if d % 7 == 0 else 100)) for d in kept]
    docs = spark.createDataFrame([*texts, (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*((d, d % 2) for d in kept), (900, 1)], "doc_id long, toxic int")
    sample = toxicity.training_rows(docs, labels)
    assert (sample["text"].str.len() == 400_000).sum() > 5
    small = toxicity.training_rows(docs, labels, most_bytes=1_000_000)
    assert small["doc_id"].tolist() == sample["doc_id"].tolist() and small["text"].str.len().min() == 100
    assert 900_000 < small.groupby("toxic")["text"].apply(lambda t: t.str.len().sum()).max() <= 1_000_000


def test_long_texts_share_what_there_is():
    assert toxicity.fair_share([5, 100, 100], 105) == 50 and toxicity.fair_share([5, 6], 100) == 6 and toxicity.fair_share([], 9) == 0
    text = " ".join(f"w{k}" for k in range(20_000)).encode()
    part = toxicity.spread(text, 20_000)
    assert 16_000 < len(part) <= 20_000 and part.startswith(b"w0 w1 ") and part.endswith(b" w19999") and any(f" w{k} ".encode() in part for k in range(9_000, 11_000))
    assert toxicity.spread(text, len(text)) == text and len(toxicity.spread(text, 100)) == 100


def test_tokenizers_that_keep_spaces_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Two words, and  more\n\n lines", " x", "", "don't stop"]
    for name, by_words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        coder = WordEncoder(public_tokenizers.path(name))
        assert coder.by_words == by_words
        got = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode([t.encode() for t in texts])]
        assert got == [Tokenizer.from_file(public_tokenizers.path(name)).encode(t, add_special_tokens=False).ids for t in texts]


def test_word_hashes_do_not_depend_on_how_much_is_hashed_at_once(monkeypatch):
    data = np.frombuffer(("  ".join(["ab", "c" * 9000, "d", "ab", "efgh" * 40]) * 3).encode(), np.uint8)
    whole = word_hashes(data, *word_bounds(data))
    monkeypatch.setattr("tidemark.llm.shingling.BLOCK_BYTES", 64)
    assert word_hashes(data, *word_bounds(data)).tolist() == whole.tolist()


def test_a_record_of_many_blocks(spark, tmp_path):
    body = np.random.default_rng(0).integers(0, 256, 30_000_000, dtype=np.uint8).tobytes()
    path = tmp_path / "large.warc.gz"
    path.write_bytes(warc.encode_record(1, "u", body, None, False) + warc.encode_record(2, "u", b"small", None, False))
    got = [(header["x-page-id"], len(block)) for _, header, block in warc.records_in(str(path), 0, path.stat().st_size)]
    assert [g[0] for g in got] == ["1", "2"] and got[0][1] > len(body)


def test_texts_of_tens_of_megabytes(spark):
    one = long_text(1_000_000) + " tail"
    docs = spark.createDataFrame([(1, one), (2, "x " + one), (3, "y")], "doc_id long, text string").repartition(2)
    rows = {r["doc_id"]: r for r in near_groups(docs).collect()}
    assert rows[2]["component_id"] == 1 and rows[3]["component_id"] == 3
    removed = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect()}
    assert removed == {1: 0, 2: 1_000_001, 3: 0}
    net = toxicity.train([b"good words here", b"bad scum idiot"] * 4, np.array([0, 1] * 4))
    assert len(net.score([one.encode(), b""])) == 2
