"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("text", pa.string())])


def held_out(id_col):
    """Whether a document is for tests alone: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, label, text)``: whole texts of at most ``most[label]`` documents of each label that are not held out.

    The choice goes by a hash of the id. Only texts of up to ``max_chars`` characters are for fitting,
    which bounds a task's memory; scoring has no such bound. An id with several labels has the
    largest, one with several texts the least; rows with a null id, label or text are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= max_chars)
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in sorted(most.items())]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    # The limits bound what is broadcast, and one text for each id the sample.
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """What ``fit`` makes of a sample's texts and labels, in order of id.

    One task gets the sample, which is bounded, and does the work; the driver gets the model alone, and a
    lost executor's task runs again with the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(zip(*(column for column in pa.Table.from_batches(list(batches), SAMPLE).to_pydict().values()), strict=True))
        model = pickle.dumps(fit([(text, label) for _, label, text in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(rows[0].model)) if rows else fit([])
