"""Language identification: multinomial naive Bayes over hashed character n-grams.

The matrix of log probabilities (languages x BUCKETS) is broadcast; a batch is scored in numpy by gathering the
rows of the n-grams that occur and adding them by document, which is the sparse product of counts and matrix.

Defined cases: a null text or one without a letter gets `und` and score 0; without learned languages so does every
text. Ids may repeat or be null; every input row gives one row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import held_out, ship

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Expected number of labelled rows that the model is fitted on, chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Languages of which a matrix is broadcast at most (0.5 MB each).
MAX_LANGUAGES = 512

_tables: list[np.ndarray] = []


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code point, blank where it isn't a letter; letter or not) by code point."""
    if not _tables:
        code = np.full(0x110000, 32, np.uint32)
        for x in range(0x110000):
            if (c := chr(x)).isalpha():
                low = c.lower()
                code[x] = ord(low) if len(low) == 1 else x
        _tables[:] = [code, code != 32]
    return _tables[0], _tables[1]


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of a run of texts, letters or not, and the offsets in code points."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    code, letter = _code_tables()
    return code[raw].astype(np.uint64), letter[raw], lead[offsets]


def _grams(codes: np.ndarray, offsets: np.ndarray):
    """For each order: the bucket of each n-gram by its first character, and where n-grams stay inside a document."""
    document_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(codes))
    rolling = np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        if order <= len(codes):
            shifted[: len(codes) - order + 1] = codes[order - 1 :]
        rolling = rolling * np.uint64(0x100000001B3) + shifted + np.uint64(order)
        if order in ORDERS:
            yield (textkit.mix(rolling) & np.uint64(BUCKETS - 1)).astype(np.int64), at + order <= document_end


def _count_batches(batches, text: str, label: str):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(batch.schema.get_field_index(label)).to_pylist()
        for first, data, offsets in textkit.runs(batch.column(batch.schema.get_field_index(text))):
            codes, _, offs = _codes(data, offsets)
            if not len(codes):
                continue
            rows = labels[first : first + len(offs) - 1]
            names = sorted(set(rows))
            which = np.repeat(np.array([names.index(x) for x in rows]), np.diff(offs))
            for bucket, inside in _grams(codes, offs):
                both = np.bincount(which[inside] * BUCKETS + bucket[inside], minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + both[k * BUCKETS : (k + 1) * BUCKETS]
    for name, counts in totals.items():
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(counts[found].astype(np.int64))], ["label", "bucket", "n"])


class LanguageModel:
    def __init__(self, labels: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.labels, self.prior, self.matrix = labels, prior, matrix


def _quota(sizes: list[int], rows: int) -> float:
    """The rows that each language may have, so that rare ones keep theirs and all have `rows` together."""
    left, sizes = rows, sorted(sizes)
    for i, n in enumerate(sizes):
        if n > left / (len(sizes) - i):
            return left / (len(sizes) - i)
        left -= n
    return float(sizes[-1])


def fit(docs: DataFrame, text: str = "text", label: str = "lang", train_rows: int = TRAIN_ROWS, doc_id: str = "doc_id") -> LanguageModel:
    """Fit on about train_rows of the rows with text and label, drawn by a hash of the id, as many of each language as it has or as the total allows."""
    ship(docs.sparkSession)
    usable = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    classes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(classes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the broadcast matrix has no proven bound")
    labels, total = sorted(classes), sum(classes.values())
    if not labels:
        return LanguageModel([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    quota = _quota(list(classes.values()), train_rows)
    cut = F.create_map(*[F.lit(x) for name, n in classes.items() for x in (name, round(min(1.0, quota / n) * 1_000_003))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(cut, F.col("label")))
    counted = sample.select("text", "label").mapInArrow(lambda b: _count_batches(b, "text", "label"), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full((len(labels), BUCKETS), SMOOTHING)
    if counted.num_rows:
        row = np.array([labels.index(x) for x in counted.column("label").to_pylist()])
        np.add.at(matrix, (row, counted.column("bucket").to_numpy()), counted.column("n").to_numpy())
    prior = np.log(np.array([classes[x] for x in labels]) / total)
    return LanguageModel(labels, prior, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32))


def _score_batches(batches, model: LanguageModel):
    for batch in batches:
        best, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        for first, data, offsets in textkit.runs(batch.column(batch.num_columns - 1)):
            codes, letter, offs = _codes(data, offsets)
            filled = np.flatnonzero(np.diff(offs) > 0)
            if not len(filled) or not model.labels:
                continue
            at = offs[:-1][filled]
            has_letter = np.add.reduceat(letter, at) > 0
            logs = np.tile(model.prior, (len(filled), 1))
            for bucket, inside in _grams(codes, offs):
                for k in range(len(model.labels)):
                    logs[:, k] += np.add.reduceat(np.where(inside, model.matrix[k][bucket], np.float32(0)), at, dtype=np.float64)
            logs = np.exp(logs - logs.max(1, keepdims=True))
            logs /= logs.sum(1, keepdims=True)
            for d, k, ok in zip(filled, logs.argmax(1), has_letter, strict=True):
                if ok:
                    best[first + d] = model.labels[k]
            scores[first + filled] = np.where(has_letter, logs.max(1), 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(scores)], [*batch.schema.names[:-1], "lang_pred", "score"])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred and score (posterior of the prediction) of every row."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda b: _score_batches(b, shared.value), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out()), train_rows=train_rows)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model, carry=("doc_id", "held_out"))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return identify(table(spark, sf_dir, "documents"))
