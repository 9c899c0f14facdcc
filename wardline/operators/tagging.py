"""Entity labels by constrained decoding: the likeliest sequence of BIO labels in which no I stands without its B.

A document's tokens pass through one task in order; what it keeps of them is a back pointer for each token and
label, a byte each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import decode_bio


def bio_labels(kinds: tuple[str, ...]) -> list[str]:
    """O, then B and I of each kind."""
    return ["O", *(f"{x}-{k}" for k in kinds for x in "BI")]


class Path:
    """The best way to each label so far, token by token."""

    def __init__(self, labels: list[str]):
        at = {name: i for i, name in enumerate(labels)}
        self.inside = np.array([i for name, i in at.items() if name.startswith("I-")], np.int64)
        self.begins = np.array([at["B-" + labels[i][2:]] for i in self.inside], np.int64)
        self.score: np.ndarray | None = None
        self.back: list[bytes] = []

    def step(self, logits: np.ndarray) -> None:
        if self.score is None:
            self.score = logits.astype(np.float64)
            self.score[self.inside] = -np.inf
            return
        before = self.score
        best = int(before.argmax())
        back = np.full(len(before), best, np.uint8)
        # an I goes on from its own B or I; of equal ways the label that comes first
        earlier, later = np.minimum(self.begins, self.inside), np.maximum(self.begins, self.inside)
        back[self.inside] = np.where(before[earlier] >= before[later], earlier, later)
        self.back.append(back.tobytes())
        self.score = before[back] + logits

    def end(self) -> list[int]:
        """Labels of all tokens; of equal sequences the one that ends in the first label."""
        out = [int(self.score.argmax())]
        for back in reversed(self.back):
            out.append(back[out[-1]])
        return out[::-1]


def constrained_labels(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, pos, start, end, label, confidence) of ``tokens`` (doc_id, pos, start, end, logits), a logit for each of ``labels``.

    The labels of a document are those of greatest total log probability among the sequences in which an I-kind
    follows a B-kind or I-kind of its kind; an I never begins.  confidence is the softmax of the chosen label's
    logit.  At most 255 labels.  Tokens without logits, or of a null doc_id, are left out.
    """
    if not 1 < len(labels) < 256:
        raise ValueError("2 to 255 labels")
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches):
        doc, path, held, key = object(), None, [], None

        def done():
            chosen = path.end()
            doc_ids, pos, start, end, logits = zip(*held)
            x = np.stack(logits)
            e = np.exp(x - x.max(1, keepdims=True))
            sure = e[np.arange(len(chosen)), chosen] / e.sum(1)
            return pa.table({"doc_id": pa.array(doc_ids, key), "pos": pa.array(pos, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()), "label": [labels[i] for i in chosen], "confidence": sure}).to_batches()

        for batch in batches:
            key = batch.schema.field(0).type
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for d, p, a, b, logits in zip(*columns):
                if d != doc:
                    if held:
                        yield from done()
                    doc, path, held = d, Path(labels), []
                row = np.array(logits, np.float64)
                path.step(row)
                held.append((d, p, a, b, row))
        if held:
            yield from done()

    told = tokens.filter("doc_id is not null and logits is not null").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("logits").cast("array<double>").alias("logits"))
    return told.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(run, f"doc_id {kind}, pos long, start long, end long, label string, confidence double")


def decode_logits(tokens: DataFrame, kinds: tuple[str, ...], least: float = 0.85, constrained: bool = True) -> DataFrame:
    """(doc_id, kind, start, end, confidence) entities of ``tokens`` (doc_id, pos, start, end, logits), logits in the order of :func:`bio_labels`.

    Without ``constrained`` each token takes its own likeliest label, the first of equal ones, and an I without its
    B begins an entity.
    """
    labels = bio_labels(kinds)
    if constrained:
        return decode_bio(constrained_labels(tokens, labels), least)
    x = F.col("logits").cast("array<double>")
    best = F.array_position(x, F.array_max(x)).cast("int")
    sure = 1 / F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(x)))
    told = tokens.filter("doc_id is not null and logits is not null").withColumn("label", F.element_at(F.array(*map(F.lit, labels)), best)).withColumn("confidence", sure)
    return decode_bio(told.select("doc_id", "pos", "label", "start", "end", "confidence"), least)
