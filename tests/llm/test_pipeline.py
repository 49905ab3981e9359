"""The five stages against a plain version, on the smallest data."""

import corpus_pipeline
import plain
from pyspark.sql import functions as F

from duecast.llm import piece_dropout


def test_run_equals_a_plain_pipeline(spark, small):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    rows = [r for r in rows if plain.kept(r[1])]
    first = {d for d, _, c in plain.components([(d, t) for d, t, _ in rows], 5, 80) if d == c}
    known = plain.windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    rows = [r for r in rows if r[0] in first and not plain.contaminated(r[1], known)]
    found, owners = plain.secrets(rows)
    want = {}
    for (number, text, _), (_, findings) in zip(rows, found, strict=True):
        out, at = [], 0
        for start, _, end, _, value in findings:
            if len(owners[value]) >= 3:
                continue
            if start >= at:
                out.append(text[at:start] + "[secret]")
            at = max(at, end)
        want[number] = "".join(out) + text[at:]
    result = corpus_pipeline.run(spark, small)
    assert result.where("not lossless").count() == 0
    assert {r["doc_id"]: r["text"] for r in piece_dropout.decode_documents(result).collect()} == want


def test_stages_keep_columns_and_survive_empty_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({"findings": F.lit(1), "_hash": F.lit(2), "kept": F.lit(3)})
    for table in (docs.limit(40), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, small)
            assert out.columns == docs.columns and out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, small).count() == table.count()


def test_one_row_of_each_component_stays(spark, small):
    words = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))
    other = lambda *at: near(*at).replace("w", "v")
    apart = near().replace("w", "u")
    rows = [
        (7, near(), "a"), (7, near(), "a"), (7, near(), "b"), (7, near(59), "a"), (8, near(0), "a"), (None, near(), "a"), (None, near(0, 59), "a"),
        (7, apart, "a"), (9, apart, "a"),  # the number of another component's document
        (None, other(), "a"), (None, other(59), "a"), (None, other(0, 59), "a"), (None, other(), "a"),
        (1, "", "a"), (1, "", "a"), (None, None, "a"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for part in (table, table.repartition(5)):
        got = sorted(((r["doc_id"], (r["text"] or "-").split(" ")[1:2]) for r in corpus_pipeline.drop_near_copies(spark, part, small).collect()), key=str)
        assert got == sorted([(7, ["w1"]), (7, ["u1"]), (None, ["v1"]), (1, []), (1, []), (None, [])], key=str)


def test_links_run_through_rows_without_a_number(spark, small):
    words = [f"w{i}" for i in range(100)]
    steps = [" ".join(f"x{i}" if i >= 100 - k else w for i, w in enumerate(words)) for k in (0, 5, 10, 15)]
    rows = [(1, steps[0]), (None, steps[1]), (None, steps[2]), (2, steps[3])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table, small).collect()] == [1]
