"""Ranked search, the web archive and the filter audit against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duecast.llm import batches, filter_audit, lexical_search, web_archive

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top):
    """(item, rank, number, score) rows by scoring every pair."""
    counts = [Counter(terms(t)) for _, t in docs]
    n, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for (number, body), c in zip(docs, counts, strict=True):
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, number is None, number or 0, number))
        found.sort(key=lambda f: f[:3])
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(found[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)] + ["Été", "naïve", "a1", "𝒳y"]
    docs = [(i, " ".join(rng.choice(words[: 6 + i % 118]) for _ in range(rng.randrange(1, 90)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(70)]
    docs += [(None, docs[7][1]), (None, "w1-W2_w3"), (900, None), (901, ""), (902, " \n!"), (7, docs[7][1]), (903, " ".join(words) * 400)]
    items = [(i, docs[i * 9][1][: 20 + 30 * i]) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unseen"), (3, "w1 W1 w2"), (3, "w1 W1 w2"), (None, "été A1"), (23, docs[7][1])]
    return docs, items


@pytest.mark.parametrize(("seeds", "rows", "block", "focus"), [(4096, 4096, 500_000, 0.9), (8, 16, 500_000, 0.3), (1, 5, 60, 1.0)])
def test_ranked_search(spark, corpus, monkeypatch, seeds, rows, block, focus):
    monkeypatch.setattr(lexical_search, "SEED_ROWS", seeds)
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", rows)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "FOCUS", focus)
    docs, items = corpus
    table = spark.createDataFrame([(d, t, 0.5, d, 1) for d, t in docs], "doc_id long, text string, score double, item_id long, rank int").repartition(3)
    asked = spark.createDataFrame([(i, t, "x", 2) for i, t in items], "item_id long, text string, doc_id string, score int")
    for top in (50, 3):
        got = lexical_search.rank_documents(table, asked, top=top).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got), key=str) == ranked(docs, items, top)


def test_ranked_search_prunes(corpus):
    """Blocks and rows below an item's threshold are left out, and what is left holds every row at or above it."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(60, 1 + i % 12, replace=False)).astype(np.int32) for i in range(400)]
    held = [rng.integers(1, 1_000_000, len(r)) for r in rows]
    norms = np.array([math.sqrt(float((h.astype(float) ** 2).sum())) for h in held])
    order = np.argsort(-norms)
    batch = pa.RecordBatch.from_pydict({"norm": norms[order], "terms": pa.array([rows[i] for i in order], pa.list_(pa.int32())), "impacts": pa.array([held[i] for i in order], pa.list_(pa.int64()))})
    weights = rng.integers(0, 9000, 60)
    queries = lexical_search.item_vectors([np.sort(rng.choice(60, 8, replace=False)) for _ in range(20)], weights)
    block = lexical_search._Block(batch, 60)
    for q in range(20):
        dense = np.zeros(60, np.int64)
        dense[queries["terms"][q]] = queries["weights"][q]
        exact = np.array([int((dense[rows[i]] * held[i]).sum()) for i in order])
        limit = int(np.sort(exact)[-10])
        left = block.survivors(queries, q, max(limit, 1))
        assert set(np.flatnonzero(exact >= max(limit, 1))) <= set(left) and len(left) < 320
        assert (block.scores(left, dense) == exact[left]).all()
        assert not len(block.survivors(queries, q, int(norms.max() * queries["norms"][q] * 1.01) + 1))


def test_ranked_search_of_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in zip(corpus, ("doc_id", "item_id"), strict=True))
    assert lexical_search.rank_documents(docs.limit(0), items).count() == 0
    assert lexical_search.rank_documents(docs, items.limit(0)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert lexical_search.rank_documents(blank, items).count() == 0


def test_long_texts_are_cut_between_words():
    raw = ("word " * 300_000 + "Last" * 600_000).encode()
    pieces = list(lexical_search._pieces(raw))
    assert len(pieces) > 1 and sum(map(len, pieces)) == 300_001
    assert filter_audit.failures(raw) == 2 | 4


def test_batch_limits_return(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), batches.arrow_batches(spark, 7, "1m"):
        assert spark.conf.get(key) == "7"
        raise RuntimeError
    assert spark.conf.get(key) == before


PAGES = [
    (1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (2**60 + 1, "http://c/\r\nWARC-Type: revisit", "x" * 1000), (None, None, "x" * 1000),
    (3, "http://d/", None), (4, "http://e/", ""), (5, None, "x" * 999), (6, "", "x" * 999), (7, "http://f/", "é" * 500), (8, "http://g/", "é" * 500),
    (8, "http://g2/", "é" * 500), (9, "http://h/", "long " * 60_000), (10, "http://i/", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n"), (None, "u", "alone"), (-4, "n", "x" * 1000), (11, "v", "\0 nul"),
]


def archived(rows):
    out = []
    for number, _, html in rows:
        raw = (html or "").encode()
        same = [n for n, _, h in rows if (h or "") == (html or "")]
        last = max((n for n in same if n is not None), default=None)
        revisits = len(raw) >= 1000 and number != last
        out.append((number, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisits else "response", last if revisits else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_web_archive(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(web_archive, "BROADCAST_ROWS", bound)
    pages = spark.createDataFrame([(*p, "x", "d", b"h") for p in [*PAGES, PAGES[1]]], "page_id long, url string, html string, payload string, digest string, header binary").repartition(4)
    path = str(tmp_path / "archive")
    web_archive.write_archive(pages, path)
    assert sorted(map(tuple, web_archive.page_records(spark, path).collect()), key=str) == archived([*PAGES, PAGES[1]])
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == len({p[2] or "" for p in PAGES})
    for r in web_archive.read_records(spark, path).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        assert rest[:length].partition(b"\r\n\r\n")[2] == (bytes(r["payload"]) if r["record_type"] == "response" else b"")


def test_web_archive_is_verified(spark, tmp_path):
    path = str(tmp_path / "archive")
    web_archive.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    spoiled = str(tmp_path / "spoiled")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{spoiled}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{spoiled}/payloads")
    with pytest.raises(Exception, match="does not give its digest"):
        web_archive.page_records(spark, spoiled).collect()
    lost = str(tmp_path / "lost")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{lost}/headers")
    spark.read.parquet(f"{path}/payloads").limit(0).write.parquet(f"{lost}/payloads")
    with pytest.raises(Exception, match="not in the archive"):
        web_archive.page_records(spark, lost).collect()


def test_web_archive_of_no_pages(spark, tmp_path):
    path = str(tmp_path / "archive")
    web_archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert web_archive.page_records(spark, path).count() == 0


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def outcome(rows, labels):
    """{(part, failed letters, good, toxic): documents}"""
    least = {}
    for number, text, _ in rows:
        if number is not None:
            least[text or ""] = min(least.get(text or "", number), number)
    out = Counter()
    for number, text, part in rows:
        text, words = text or "", SPACE.findall(text or "")
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), number is not None and number > least[text]]
        good, toxic = (number is not None and any(d == number and v[k] == 1 for d, *v in labels) for k in (0, 1))
        out[part or "", "".join(f for f, x in zip("ABCDE", fails, strict=True) if x), good, toxic] += 1
    return out


def audited(rows, labels):
    counts, out = outcome(rows, labels), []
    for part in sorted({k[0] for k in counts}):
        own = {k[1:]: n for k, n in counts.items() if k[0] == part}
        steps, shares = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                left = {k: n for k, n in own.items() if not set(k[0]) & set(order[: step - 1])}
                gone = {k: n for k, n in left.items() if letter in k[0]}
                shares[letter] += sum(gone.values())
                failing = sum(n for k, n in own.items() if letter in k[0])
                steps.append((part, order, step, sum(left.values()) - sum(gone.values()), sum(gone.values()), failing - sum(gone.values()), sum(n for k, n in own.items() if k[0] == letter),
                              sum(n for k, n in gone.items() if k[1]), sum(n for k, n in gone.items() if k[2]), letter))
        out += [(*s[:-1], shares[s[-1]]) for s in steps]
    return sorted(out)


@pytest.fixture(scope="module")
def batches_of_rows():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Aa", "bb", "c#c", "dd", f"w{rng.randrange(900)}"][rng.randrange(5) if i % 3 else 4 :]) for _ in range(rng.choice([20, 199, 200, 240]))) for i in range(25)] + [None, "", "\t é"]
    rows = [(rng.randrange(500), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(400)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (3, texts[1], "en"), (3, texts[1], "en"), (-5, texts[1], "fr"), (2**60, texts[2], "de")]
    rng.shuffle(rows)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 500, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)]
    return rows, labels


def test_filter_audit_retracts(spark, tmp_path, batches_of_rows):
    rows, labels = batches_of_rows
    path, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    table = lambda part: spark.createDataFrame([(*r, 1, b"d") for r in part], "doc_id long, text string, lang string, code int, digest binary").coalesce(1)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for k in range(4):  # numbers fall from file to file, so that later files retract
        table(sorted(rows, key=lambda r: -(r[0] or 0))[k * 90 : k * 90 + 90]).write.mode("append").parquet(path)
    filter_audit.count_outcomes(spark, path, marks, files_per_batch=1, folder=folder)
    taken_back = spark.read.parquet(f"{folder}/deltas").where("n < 0")
    assert not taken_back.isEmpty()
    table(sorted(rows, key=lambda r: -(r[0] or 0))[360:]).write.mode("append").parquet(path)
    outcomes = filter_audit.count_outcomes(spark, path, marks, files_per_batch=1, folder=folder)
    bits = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
    want = {(k[0], sum(bits[c] for c in k[1]) + 32 * k[2] + 64 * k[3]): n for k, n in outcome(rows, labels).items()}
    assert {(r["part"], r["code"]): r["n"] for r in outcomes.collect()} == want
    assert sorted(map(tuple, filter_audit.interactions(outcomes).collect())) == audited(rows, labels)
    again = filter_audit.count_outcomes(spark, path, marks, folder=folder)
    assert {(r["part"], r["code"]): r["n"] for r in again.collect()} == want


def test_filter_audit_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(path)
    outcomes = filter_audit.count_outcomes(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert outcomes.count() == 0 and filter_audit.interactions(outcomes).count() == 0
