"""What a task's Python holds at once."""

import json

import pyarrow as pa

from prooflake.sources import json_arrays


def test_json_arrays_are_written_in_small_batches(spark, monkeypatch, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(batch.num_rows)])], names=["value"])

    monkeypatch.setattr(json_arrays, "_as_array", sizes)
    json_arrays.write(spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', 1000) AS text"), str(tmp_path / "out"))
    found = [int(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sum(found) == 3000 and max(found) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"


def test_records_leave_a_task_by_their_bytes():
    records = [{"k": k, "text": "x" * 100_000} for k in range(300)]
    text = json.dumps(records)
    rows = [r for r in text.split("{")]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(["f"] * len(rows)), pa.array([0] * len(rows), pa.int64())], names=["value", "file", "start"])
    out = list(json_arrays._records({("f", 0): (False, 0)})(iter([batch])))
    assert [json.loads(t) for b in out for t in b.column(3).to_pylist()] == records
    assert max(b.nbytes for b in out) <= json_arrays.BATCH_BYTES + 2 * json_arrays.BLOCK_BYTES


def test_terms_are_counted_inside_their_row(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from prooflake.operators import models

    texts = ["the cat the cat the dog", "", "a b c", None, "Dog dog"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    plain = {r.key: Counter(r.g or []) for r in rows.select("key", models.ngrams(F.col("text")).alias("g")).collect()}
    got = {r.key: {t.term: t.n for t in r.t or []} for r in rows.select("key", models.term_counts(F.col("text")).alias("t")).collect()}
    assert got == plain and got[0]["the cat"] == 2
    found = {r.term: (r.place, r.idf) for r in models.tfidf_vocabulary(rows, "text", 100).collect()}
    assert found["the"][0] == 1 and set(found) == set().union(*plain.values())  # dog: three times, as the, and first by name
    plan = models.tfidf_vocabulary(rows, "text", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "Expand" not in plan and "doc" not in plan
