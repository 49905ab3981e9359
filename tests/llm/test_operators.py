"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duecast.llm import bytewords, chat_format, decontamination, keys, ngram_join, piece_dropout, quality_rules, queries, secret_scan, suffix_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, source string, kept string, part long, score double"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "été", "naïve"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    long = prose(2, 9000)
    texts = [None, "", " \n\t", "one", "one two", base, base, " ".join(near), base.upper(), prose(3, 9), prose(4, 200) + "\n" + base[:300], long, "x " * 400, prose(5, 60) + "\n" + prose(5, 60), "a\nb\na\nb " + prose(6, 80)]
    return [(i, t, f"s{i % 3}", "x", i, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, rows[5], rows[0]], SCHEMA)


def test_quality_rules(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert quality_rules.quality_rules(docs).count() == len(rows) + 2
    for number, text, *_ in rows:
        want = plain.figures(text) if number != 11 else {"n_words": 9000}
        assert {k: got[number][k] for k in want} == want
        if number != 11:
            assert got[number]["kept"] == plain.kept(text)
    assert quality_rules.quality_rules(docs).where("kept and n_words > 1").count() > 0
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_rules_runs_no_python(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("chunk", "common", "bound"), [(256, 16, 4_000_000), (2, 2, 4_000_000), (256, 3, 0)])
def test_ngram_components(spark, docs, rows, monkeypatch, chunk, common, bound):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "SHARED_TOKENS", bound)
    more = []
    for k in range(25):  # a family around one text, some links direct and some over others
        words = rows[5][1].split(" ")
        for j in range(k % 7):
            words[(k * 13 + j * 11) % 120] = f"z{k}{j}"
        more.append((100 + k, " ".join(words), "s", "x", 0, 0.0))
    family = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = sorted(plain.components([(r[0], r[1]) for r in [*rows, rows[5], rows[0], *more]]))
    # Rows without a word form components of their own; the plain version gives the same.
    assert sorted(map(tuple, ngram_join.ngram_components(family).collect())) == want
    want = sorted(plain.components([(r[0], r[1]) for r in more], 5, 80))
    assert sorted(map(tuple, ngram_join.ngram_components(spark.createDataFrame(more, SCHEMA), words=5, percent=80).collect())) == want


def test_ngram_small_sets_and_empty(spark):
    nine = " ".join(f"w{i}" for i in range(11))
    table = spark.createDataFrame([(1, nine), (2, nine + " more"), (3, "a b"), (4, "A  B"), (None, "a b")], "doc_id long, text string")
    got = {(r[0], r[2]) for r in ngram_join.ngram_components(table).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3)}
    assert ngram_join.ngram_components(table.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [66, 50, 34])
def test_ngram_links_of_few_common_shingles(spark, percent):
    texts = ["a b", "a b c", "d e", "d e f g", "h i", "h j", "k", "k l", "m n", "o p"]
    rows = list(enumerate(texts))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=percent)
    assert sorted(map(tuple, got.collect())) == sorted(plain.components(rows, 1, percent))


def test_ngram_limit_below_one_is_refused(docs):
    with pytest.raises(ValueError, match="percent"):
        ngram_join.ngram_components(docs, percent=0)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {tuple(r) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_toxicity_learns_and_keeps_labels_apart(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(i, 40).split(" ")
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(["Vile!", "rotten"])
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    texts += [(1000, None), (1001, ""), (1000, None)]
    table, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, marks).collect()}
    for i, y in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7) == y
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] < 0.7
    # Labels of held-out rows change nothing.
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-12 for i in again)
    assert toxicity.score(table, toxicity.fit(table, marks.limit(0))).agg(F.max("score")).first()[0] == 0.5


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination(spark, docs, rows, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", bound)
    items = [(1, rows[5][1][30:200]), (2, "one, TWO"), (3, None), (4, ""), (2, "one, TWO"), (5, prose(4, 200)[100:400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench).collect()
    assert len(got) == len(rows) + 2
    known = plain.windows(items)
    by_id = {r["doc_id"]: r for r in got}
    for number, text, *_ in rows:
        assert by_id[number]["contaminated"] == plain.contaminated(text, known), number
    assert by_id[4]["hit_places"] == [0, 1] and by_id[4]["item_ids"] == ["2"]
    assert not decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_toxicity_extracts_before_the_fitting_task(spark, tmp_path, monkeypatch):
    parts = 6
    path, seen = str(tmp_path / "docs"), str(tmp_path / "seen")
    spark.createDataFrame([(i, f"word{i} calm") for i in range(60)], "doc_id long, text string").repartition(parts).write.parquet(path)
    extract = toxicity._extract

    def noted(batches):
        from pyspark import TaskContext

        with open(f"{seen}-{TaskContext.get().partitionId()}", "w"):
            pass
        yield from extract(batches)

    monkeypatch.setattr(toxicity, "_extract", noted)
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
        toxicity.fit(spark.read.parquet(path), marks)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list(tmp_path.glob("seen-*"))) == parts


def test_url_filter_of_hosts_beyond_the_basic_plane(spark):
    host = "😀.example.com"
    pages = spark.createDataFrame([(i, f"s://{host}/en/{i}") for i in range(400)] + [(1000 + i, f"s://b{i}.example.com/en/") for i in range(20)], "page_id long, url string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark)).groupBy("rule", "verdict").count().collect()
    assert [tuple(r) for r in got] == [("example.com/en/", "block", 420)]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "x://example.com", "x://example.com/EN/", "x://a.b.net/es/1", "x://net/fr/", "x://badnet/fr/", "x://example.com:80/en/", "x://q?://example.com/"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()}
    none = ("", "", None, "allow")
    assert [got[i] for i in range(4)] == [none] * 4
    assert got[4] == got[12] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5] == ("example.com", "", None, "allow") and got[6][2:] == ("com/", "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8][2:] == ("net/fr/", "block") and got[9][2] is None
    assert got[10][:3] == ("example.com:80", "/en/", None) and got[11][0] == "q"
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, [])).collect()} == {"allow"}


def test_url_filter_against_all_rules(spark):
    rng = random.Random(3)
    hosts = [".".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rules = list({(rng.choice(hosts), "/" + "/".join(rng.choice("xy") for _ in range(rng.randrange(3)))): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    pages = [(i, f"s://{rng.choice(hosts)}/{'/'.join(rng.choice('xy') for _ in range(3))}") for i in range(600)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), table).collect()}
    for i, url in pages:
        host, _, path = url[4:].partition("/")
        fit = [(len(h + p), h + p, v) for (h, p), v in rules if ("." + host).endswith("." + h) and ("/" + path).startswith(p)]
        assert got[i] == (max(fit)[1:] if fit else (None, "allow"))


@pytest.mark.parametrize(("hot", "size", "remembered"), [(16_000, 300_000, 200_000), (1, 300_000, 1), (16_000, 200, 0)])
def test_remove_repeats(spark, docs, rows, monkeypatch, hot, size, remembered):
    for name, value in (("HOT_BLOCKS", hot), ("SORT_BYTES", size), ("REMEMBERED", remembered)):
        monkeypatch.setattr(suffix_dedup, name, value)
    table = docs.unionByName(spark.createDataFrame([(200, "é" * 300, "", "", 0, 0.0), (201, rows[5][1][:99], "", "", 0, 0.0), (202, "z" + rows[5][1][:150] + "é" * 60, "", "", 0, 0.0)], SCHEMA))
    want = plain.removed([(r[0], r[1]) for r in rows] + [(200, "é" * 300), (201, rows[5][1][:99]), (202, "z" + rows[5][1][:150] + "é" * 60)])
    got = suffix_dedup.remove_repeats(table).select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"]).alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        assert (r["n_bytes"], r["n"] or 0, max(r["s"] or 0, 0), r["h"]) == want[r["doc_id"]], r["doc_id"]
    assert suffix_dedup.remove_repeats(table.limit(0)).count() == 0


def test_frequent_blocks_are_settled_once():
    """All but the earliest of equal blocks may be settled, never the earliest; a row that comes again is open both times."""
    rng = np.random.default_rng(5)
    rows = np.stack([rng.integers(0, 4, 900), rng.integers(0, 3, 900), rng.integers(0, 200, 900), np.zeros(900, np.int64), rng.integers(0, 2, 900)], axis=1)
    frequent = suffix_dedup._Frequent()
    settled = np.concatenate([frequent.settle(rows[a : a + 90]) for a in range(0, 900, 90)])
    for key in np.unique(rows[:, :2], axis=0):
        own = (rows[:, :2] == key).all(axis=1)
        least = min(map(tuple, rows[own][:, 2:]))
        assert not any(done for done, row in zip(settled[own], rows[own], strict=True) if tuple(row[2:]) == least)
    assert settled.sum() > 700


def test_blocks_without_a_shared_side_are_left_out():
    rng = np.random.default_rng(6)
    gram = rng.integers(0, 256, suffix_dedup.GRAM).astype(np.uint8)
    shared = rng.integers(0, 256, 60).astype(np.uint8)
    ends_of = [rng.integers(0, 256, 60).astype(np.uint8) for _ in range(5)]
    texts = [np.concatenate(x) for x in ((ends_of[0], gram, shared), (ends_of[1], gram, shared), (ends_of[2], gram, ends_of[3]), (shared, gram, ends_of[4]))]
    sums, back = suffix_dedup._running(gram)
    anchor = bytewords.mix((sums[-1:] - sums[:1]) * back[:1]).astype(np.int64)
    ends = np.cumsum([0, *map(len, texts)])
    assert suffix_dedup.may_repeat(np.concatenate(texts), ends, np.repeat(anchor, 4)).tolist() == [True, True, False, False]


@pytest.mark.parametrize(("n", "letters"), [(1, 2), (2, 2), (3, 1), (10, 1), (100, 2), (301, 3), (1000, 200)])
def test_suffix_array(n, letters):
    s = np.random.default_rng(n).integers(1, letters + 1, n)
    assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: tuple(s[i:]))


def test_chat_format(spark):
    odd = "a\\b <|end|> <|turn|>x<|says|> </s>[INST]\\[/INST] <<SYS>> \\<|\n"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, None, None), (2, 5, "assistant", ""), (2, 1, "assistant", "é😀"), (2, 1, "assistant", "é😀"), (None, 0, "assistant", "x"), (1, None, odd, "first")]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, piece int")
    got = {r["conv_id"]: r for r in chat_format.format_chats(table).collect()}
    assert chat_format.parse(got[1]["formatted"]) == [(odd, "first"), ("user", odd), ("assistant", odd), ("", "")]
    assert chat_format.parse(got[2]["formatted"]) == [("assistant", "é😀"), ("assistant", "é😀"), ("assistant", "")]
    raw = got[2]["formatted"].encode()
    assert [raw[a : a + n].decode() for a, n in zip(got[2]["loss_start"], got[2]["loss_bytes"], strict=True)] == ["é😀", "é😀", ""]
    digests = {r["conv_id"]: r for r in chat_format.chat_digests(chat_format.format_chats(table)).collect()}
    assert digests[2]["loss_chars"] == 4 and digests[None]["n_turns"] == 1 and digests[1]["formatted_chars"] == len(got[1]["formatted"])
    assert chat_format.chat_digests(chat_format.format_chats(table.limit(0))).count() == 0


def test_chat_pieces_of_a_long_conversation(spark):
    turns = spark.range(1500).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    chats = chat_format.format_chats(turns)
    assert chats.count() > 1 and [r["piece"] for r in chats.collect()] == list(range(chats.count()))
    row = chat_format.chat_digests(chats).first()
    assert (row["n_turns"], row["loss_chars"]) == (1500, sum(len(str(i)) for i in range(1500)))


TRICKY = ["", " ", "a  b\n c", "▁a ▁▁", "日本語😀 x" * 40, "=" * 150 + "-" * 90, "<s> <0x0A> </s>", "é\x00\x7f  ", "the theatre of the north " * 30]


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    p, model = piece_dropout.Pieces(), sentencepiece.SentencePieceProcessor(model_file=piece_dropout.MODEL)
    texts = [t for t in TRICKY if "▁" not in t]
    ids, ends = piece_dropout.encode_texts(p, *bytewords.text_buffer(pa.array(texts)), np.arange(len(texts)), 0.0)
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))] == [model.encode(t) for t in texts]


def test_dropout_is_seeded_varied_and_lossless(spark, docs, rows, monkeypatch):
    p = piece_dropout.Pieces()
    raw, ends = bytewords.text_buffer(pa.array(TRICKY))
    keys_ = np.arange(len(TRICKY))
    ids, stops = piece_dropout.encode_texts(p, raw, ends, keys_, 0.1, 1)
    back, back_ends = piece_dropout.decode_pieces(p, ids, stops)
    assert np.array_equal(back, raw) and np.array_equal(back_ends, ends)
    monkeypatch.setattr(piece_dropout, "MATRIX_CHARS", 3)  # the heap must cut words as the matrix does
    assert np.array_equal(piece_dropout.encode_texts(p, raw, ends, keys_, 0.1, 1)[0], ids)
    assert not np.array_equal(piece_dropout.encode_texts(p, raw, ends, keys_, 0.1, 2)[0], ids)
    encoded = piece_dropout.encode_documents(docs, check=True)
    assert encoded.where("not lossless").count() == 0 and encoded.count() == len(rows) + 2
    texts = {r["doc_id"]: r["text"] for r in piece_dropout.decode_documents(encoded).collect()}
    assert all(texts[r[0]] == (r[1] or "") for r in rows)
    assert piece_dropout.encode_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "group"), [(1 << 17, 1024), (64, 3), (1, 2)])
def test_token_counts(docs, rows, monkeypatch, block, group):
    monkeypatch.setattr(token_counts, "GROUP_BLOCKS", group)
    short = docs.where("doc_id <> 11") if block == 1 else docs
    encoding = token_counts.encoder()
    want = {r[0]: len(encoding.encode_ordinary(r[1] or "")) for r in rows}
    got = token_counts.document_counts(token_counts.write_token_files(short, block_tokens=block)).collect()
    assert len(got) == short.count() and all(want[r["doc_id"]] == r["n_tokens"] for r in got)


def test_token_counts_of_plain_blocks(spark):
    sep = token_counts.SEPARATOR

    def block(*ids):
        return bytearray(np.array(ids, "<u2").tobytes())

    blocks = spark.createDataFrame([(1, 0, block(5, 5)), (1, 1, block()), (1, 2, block(5, sep, sep, 7)), (1, 3, block(8)), (2, 0, block(sep)), (3, 0, None), (None, 0, block(1)), (4, None, block(1))], "file long, block long, tokens binary")
    assert {tuple(r) for r in token_counts.count_tokens(blocks).collect()} == {(1, 0, 3), (1, 1, 0), (1, 2, 2), (2, 0, 0)}
    assert token_counts.count_tokens(blocks.limit(0)).count() == 0


SECRETS = [
    (1, 'é password = "hunter2hunter2" and TOKEN:abc', "o1"), (2, "token: api_key: abcdefgh12 passwd=abcdefgh", "o2"), (3, "AKIAABCDEFGHIJKL AKIAAKIA x" + "0af" * 12, "o1"),
    (4, "secret=copiedcopied", "o1"), (5, "secret=copiedcopied", "o2"), (6, "secret=copiedcopied", "o3"), (7, "key AbCdEfGhIjKlMnOpQrStUvWx12 twice", "o1"), (8, None, None), (9, "", "o1"), (7, "key AbCdEfGhIjKlMnOpQrStUvWx12 twice", "o1"),
    (10, "ſecret=notasecret1 token=" + "x" * 30, None), (11, "token=aaaaaaaa " * 300, "o9"),
]


def test_secret_scan(spark):
    table = spark.createDataFrame([(*r, "clash") for r in SECRETS], "doc_id long, text string, source string, value string")
    want, owners = plain.secrets(SECRETS)
    got = secret_scan.scan_secrets(table).collect()
    assert len(got) == len(SECRETS)
    by_id = {r["doc_id"]: r["findings"] for r in got}
    for number, findings in want:
        assert [(f["start"], f["kind_no"], f["end"], f["kind"], f["n_owners"]) for f in by_id[number]] == [(*f[:4], len(owners[f[4]])) for f in findings], number
    assert [f["shared"] for f in by_id[4]] == [True]
    assert secret_scan.scan_secrets(table.limit(0)).count() == 0
    masked = secret_scan.scan_secrets(table).where("doc_id = 1").join(table.select("doc_id", "text"), "doc_id").select(secret_scan.redact(F.col("text"), F.col("findings"))).first()[0]
    assert masked == "é [secret]\" and TOKEN:abc"


def test_keys_join_nulls(spark):
    table = spark.createDataFrame([(None, None), (None, "a"), (1, "a")], "doc_id long, text string")
    base = keys.keyed(table)
    assert keys.join_keyed(base, base.select("_id", "_hash"), "inner").count() == 3


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)


def thue_morse(a, b, n):
    """Two texts whose polynomial hashes modulo 2 ** 64 agree: a sequence and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_constructed_words_are_told_apart(spark):
    one, two = thue_morse("a", "b", 4096)
    raw, ends = bytewords.text_buffer(pa.array([one, two, one]))
    first, stop, _ = bytewords.word_spans(raw, ends, bytewords.SPACE_WORDS)
    hashes = bytewords.word_hashes(raw, first, stop)
    assert hashes[0] == hashes[2] != hashes[1]
    rows = [(1, f"x y {one} z"), (2, f"x y {two} z")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(plain.components(rows))


def test_large_numbers_beside_a_null(spark):
    turns = [(2**60 + 1, 0, "user", "one"), (2**60 + 2, 0, "user", "two"), (None, 0, "user", "none")]
    chats = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat_format.chat_digests(chat_format.format_chats(chats)).collect()}
    assert got == {2**60 + 1: 1, 2**60 + 2: 1, None: 1}
    pages = spark.createDataFrame([(2**60 + 1, "http://a.com/"), (None, "http://b.com/"), (2**60 + 2, None)], "page_id long, url string").coalesce(1)
    judged = url_filter.filter_urls(pages, url_filter.rule_table(spark))
    assert {(r["page_id"], r["rule"]) for r in judged.collect()} == {(2**60 + 1, "com/"), (None, "com/"), (2**60 + 2, None)}
    assert dict(judged.dtypes)["page_id"] == "bigint"


def test_separators_inside_hosts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 1)
    hosts = ["com", "com\x01evil", "a.com", "com\x02a", "\x01.com", "x\x02.com", "com\U0010ffffx", "\U0010ffff.com", "\U0010ffffz.www.example.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/en/") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got == {0: "com/", 1: None, 2: "com/", 3: None, 4: "com/", 5: "com/", 6: None, 7: "com/", 8: "www.example.com/en/"}


def test_quality_rules_beside_working_names(spark):
    text = prose(4, 120)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").selectExpr("*", "1 as _w", "2 as _t", "3 as _figures", "4 as __again", "5 as n_words", "6 as _L")
    row = quality_rules.quality_rules(docs).first()
    assert [row[c] for c in ("_w", "_t", "_figures", "__again", "_L")] == [1, 2, 3, 4, 6] and row["n_words"] == plain.figures(text)["n_words"]
