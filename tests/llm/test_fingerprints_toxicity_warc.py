import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity
from tidemark.llm.fingerprints import fingerprint_documents
from tidemark.llm.warc import MAGIC, encode_record, read_warc, records_in, write_warc
from tests.llm.conftest import WORD


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(docs, most=0.3):
    rows = docs.collect()
    got = fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    low = lambda x: -(2**63) if x is None else x
    by_key = {}
    for d in sorted(rows, key=lambda d: d["text"] or "", reverse=True):
        by_key[low(d["doc_id"])] = d["text"] or ""
    order = sorted(by_key, reverse=True)
    after = {k: by_key[order[(i + 1) % len(order)]] for i, k in enumerate(order)}
    want, prints, errors = {}, {}, []
    for d in rows:
        t = d["text"] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + after[low(d["doc_id"])][:h]
        want[d["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest()] = (t, e, after[low(d["doc_id"])])
    for r in got:
        t, e, n = want[r["doc_id"], r["n_chars"], r["edited_sha256"]]
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert len(r["fingerprint"]) == (256 if shingles(t) else 0)
        if t == e:
            assert r["near_edited"] == 1.0 and r["fingerprint"] == r["edited_fingerprint"]
        errors += [r["near_edited"] - likeness(t, e), r["near_next"] - likeness(t, n)]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    if errors:
        assert max(map(abs, errors)) < most
    return errors


def test_fingerprints(null_key_docs, clashing_docs, no_docs, spark, sf_dir):
    for docs in (null_key_docs, clashing_docs, no_docs, spark.createDataFrame([(3, "only one text here")], "doc_id long, text string")):
        check_fingerprints(docs)
    errors = np.array(check_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.05


def made_up(n, seed=3):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(r.choices(["ta", "ri", "no", "le", "su", "mi"], k=r.randint(1, 4))) for _ in range(r.randint(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(r.randrange(len(words) + 1), r.choice(["Idiot,", "SCUM!!", "pfuixa" + r.choice(["ta", "ri"]), "moron"]))
        texts.append(" ".join(words).encode())
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_gradients_are_right():
    texts, labels = made_up(12)
    words = toxicity.Words(texts)
    w = toxicity.Windows(words)
    net = toxicity.Network(words.hashes[::2])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    target = labels[w.doc].astype(np.float64)

    def loss():
        p = toxicity._sigmoid(net.forward(net.inputs(words)[0].astype(np.float64), w.words, w.inside))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    x, origin = net.inputs(words)
    g = net.gradients(x.astype(np.float64), origin, w.words, w.inside, target, np.ones(len(target)))
    r = np.random.default_rng(0)
    for name in ("hf", "hb", "xf", "bb", "attend", "out", "bias", "word", "gram", "head"):
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        places = np.flatnonzero(np.abs(grad) > np.abs(grad).max() * 0.2)
        for k in r.choice(places, min(2, len(places)), replace=False):
            was, step = flat[k], 1e-3
            flat[k] = was + step
            up = loss()
            flat[k] = was - step
            down = loss()
            flat[k] = was
            assert abs((up - down) / (2 * step) - grad[k]) < 2e-3 * max(1, abs(grad[k])) + 0.05 * abs(grad[k]), name


def test_held_out_accuracy_and_last_windows():
    texts, labels = made_up(400)
    net = toxicity.train(texts, labels)
    more, truth = made_up(300, seed=8)
    found = net.score(more) >= 0.5
    assert (found == truth).mean() > 0.95
    clean = b" ".join(t for t, y in zip(*made_up(60, seed=5), strict=True) if not y)
    assert net.score([clean])[0] < 0.5 <= net.score([clean + b" idiot scum moron"])[0]
    assert np.array_equal(net.score(more), net.score(more))
    assert np.allclose(net.score(more), [net.score([t])[0] for t in more], atol=1e-5)
    assert net.score([b"", b"  ", b"\xff\xfe"]).shape == (3,)


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_training_without_both_labels(labels):
    net = toxicity.train([b"some words here"] * len(labels), np.array(labels))
    assert (net.score([b"any text", b""]) > 0.5).all() == (labels == [1, 1])


def test_scores_of_edge_rows(null_key_docs, clashing_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for docs in (null_key_docs, clashing_docs, no_docs):
        net = toxicity.fit(docs, labels)
        rows = toxicity.score_documents(docs, net).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
            assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        out = toxicity.drop_toxic(docs, labels)
        assert out.columns == docs.columns


def test_training_reads_no_held_out_label(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.training_rows(docs, labels, rows=20)
    assert len(sample) and not [d for d in sample["doc_id"] if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sample["toxic"].value_counts().max() <= 20


PAGES = "page_id long, url string, html string"


def check_warc(spark, pages, folder, least=0, split=700):
    rows = pages.collect()
    best = {}
    for p in rows:
        if p["page_id"] is not None:
            best[p["html"] or ""] = max(best.get(p["html"] or "", p["page_id"]), p["page_id"])
    want = []
    for p in rows:
        body = p["html"] or ""
        top = best.get(body)
        alone = sum((q["html"] or "") == body for q in rows) == 1
        again = len(body.encode()) >= least and top is not None and not alone and p["page_id"] != top
        digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        want.append((str(p["page_id"]), len(body.encode()), digest, "revisit" if again else "response", top if again else None))
    files = write_warc(pages, str(folder), least_bytes=least)
    got = read_warc(spark, files, split_bytes=split).collect()
    assert sorted(want, key=str) == sorted([(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str)
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["payload_digest"]
    return files


def test_archives_round_trip(spark, tmp_path, sf_dir):
    noise = "".join(map(chr, np.random.default_rng(0).integers(32, 0x2FFF, 3000)))
    rows = [(1, "u", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "u", noise), (6, "u", "WARC/1.1\r\n\r\n"), (6, "u", "other"), (None, "u", "<p>a</p>"), (7, "u", "7"), (7, "u", "7"), (None, "u", "lone"), (8, "u", "b" * 300_000)]
    pages = spark.createDataFrame(rows, PAGES)
    files = check_warc(spark, pages, tmp_path / "a")
    assert b"".join(gzip.open(f).read() for f in files).count(b"WARC-Type: ") == len(rows)
    check_warc(spark, pages, tmp_path / "b", least=5)
    check_warc(spark, pages.limit(0), tmp_path / "c")
    clash = "body refers again digest best n payload records file record_type payload_bytes payload_digest refers_to".split()
    check_warc(spark, pages.withColumns({c: pages["url"] for c in clash}), tmp_path / "e")
    check_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("page", pages.sparkSession.range(1).selectExpr("1 AS x").first()[0] + __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0)), tmp_path / "d", split=9000)


def test_every_record_belongs_to_one_range(tmp_path):
    records = [encode_record(k, "u", f"<p>{k}</p>".encode() * (k % 5 * 40), None, False) for k in range(40)]
    fake = MAGIC + b"\x00" * 30
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk" + b"".join(records[:20]) + fake + b"".join(records[20:]))
    size = path.stat().st_size
    for split in (1, 37, 500, size):
        found = [h["x-page-id"] for at in range(0, size, split) for _, h, _ in records_in(str(path), at, min(size, at + split))]
        assert found == [str(k) for k in range(40)]


def test_truncated_member_is_no_record(tmp_path):
    path = tmp_path / "x.warc.gz"
    whole = encode_record(1, "u", b"abc", None, False)
    path.write_bytes(whole + encode_record(2, "u", b"abc" * 1000, None, False)[:-20])
    assert [h["x-page-id"] for _, h, _ in records_in(str(path), 0, path.stat().st_size)] == ["1"]
