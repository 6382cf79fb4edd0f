import zlib

from tidemark.llm import toxicity


def test_label_counts_leave_out_held_out_repeated_and_null_rows(spark, monkeypatch):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:60]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, k % 3 == 0) for k, i in enumerate(ids)] + [(ids[0], 1)] * 5 + [(i, 1) for i in held] + [(None, 1), (ids[1], None)]
    labels = spark.createDataFrame([(i, None if y is None else int(y)) for i, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, of_all: seen.append((len(texts), of_all)))
    toxicity.fit(docs, labels)
    assert seen == [(60, (40, 20))]
