"""What a task of the language model's scoring holds at once."""

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from ridgeline.llm import lm_scoring


def test_texts_are_keyed_in_small_pieces(spark):
    text = "some words of a line " * 500
    rows = spark.range(300).coalesce(1).select(F.col("id"), F.lit(text).alias("text"), F.lit(True).alias("train"))
    blobs = [r["blob"] for r in lm_scoring._asked(rows, 5, 16 << 20).filter("blob is not null").collect()]
    held = [pa.compute.sum(pa.compute.binary_length(pa.ipc.open_stream(b).read_all()["text"])).as_py() for b in blobs]
    assert sum(held) == 300 * len(text) and max(held) <= 1 << 18
