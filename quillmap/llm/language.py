"""Language identification by a byte convolutional network, trained and applied in numpy.

A window of WINDOW bytes passes through filters of several widths, each filter's largest
response in the window goes through a ramp into a softmax over the languages. A filter of
width w is a table of 256 numbers for each of its w places, so that a convolution is a
sum of table look-ups and no byte is ever expanded.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.llm.common import map_portions
from quillmap.session import materialise

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
#: Labelled rows a language is learned from at most, and bytes of each; the only bound.
TRAIN_ROWS = 500
TRAIN_BYTES = 1_024
EPOCHS = 12
STEP = 0.01
BATCH = 64
SEED = 17
#: Windows that pass through the network at once.
AT_ONCE = 512
UNKNOWN = "und"


def windows_of(data: bytes) -> np.ndarray:
    """All of the bytes in rows of WINDOW; the last row is filled up with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


class ByteCnn:
    """tables[i]: (width, 256, FILTERS); bias, dense: from the pooled responses to languages."""

    def __init__(self, languages: Sequence[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = list(languages)
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        pooled = FILTERS * len(WIDTHS)
        self.bias = np.zeros(pooled, np.float32)
        self.dense = rng.normal(0, 0.3, (pooled, len(self.languages))).astype(np.float32)
        self.offset = np.zeros(len(self.languages), np.float32)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Pooled responses, the place of each, and log probabilities."""
        pooled, places = [], []
        for table in self.tables:
            width = len(table)
            span = WINDOW - width + 1
            response = table[0][windows[:, :span]]
            for j in range(1, width):
                response += table[j][windows[:, j : j + span]]
            place = response.argmax(axis=1)
            places.append(place)
            pooled.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0])
        pooled = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return pooled, places, self.log_probabilities(pooled)

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        score = pooled @ self.dense + self.offset
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))

    def train(self, windows: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the cross entropy; the gradient of a pooled response goes to its place only."""
        rng = np.random.default_rng(seed)
        values = [*self.tables, self.bias, self.dense, self.offset]
        first = [np.zeros_like(v) for v in values]
        second = [np.zeros_like(v) for v in values]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), BATCH):
                rows = order[start : start + BATCH]
                x, n = windows[rows], len(rows)
                pooled, places, logs = self.forward(x)
                wrong = np.exp(logs)
                wrong[np.arange(n), label[rows]] -= 1
                wrong /= n
                back = (wrong @ self.dense.T) * (pooled > 0)
                gradients = []
                each = np.arange(n)[:, None]
                for i, table in enumerate(self.tables):
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    gradient = np.zeros_like(table)
                    for j in range(len(table)):
                        np.add.at(gradient[j], (x[each, places[i] + j], np.arange(FILTERS)[None, :]), part)
                    gradients.append(gradient)
                gradients += [back.sum(axis=0), pooled.T @ wrong, wrong.sum(axis=0)]
                step += 1
                for v, g, m, s in zip(values, gradients, first, second):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, look-up tables over byte pairs (and a single byte if it is odd)."""
        out = []
        for table in self.tables:
            pairs = [
                (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65_536, FILTERS)
                for j in range(0, len(table) - 1, 2)
            ]
            out.append(pairs + ([table[-1]] if len(table) % 2 else []))
        return out

    def predict(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Log probabilities by window, with pair_tables()."""
        logs = []
        for start in range(0, len(windows), AT_ONCE):
            x = windows[start : start + AT_ONCE]
            pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            pooled = []
            for parts, table in zip(tables, self.tables):
                width = len(table)
                span = WINDOW - width + 1
                response = parts[0][pair[:, :span]]
                for k, part in enumerate(parts[1:], 1):
                    at = pair if len(part) > 256 else x
                    response += part[at[:, 2 * k : 2 * k + span]]
                pooled.append(response.max(axis=1))
            logs.append(self.log_probabilities(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)))
        return np.concatenate(logs)


def fold(doc_id) -> int:
    """crc32 of the id as text, mod 4; a null id counts as empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


def _fold(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def train_language_model(docs: DataFrame, held_out: int = 2, rows: int = TRAIN_ROWS) -> ByteCnn | None:
    """Learn from `rows` labelled documents of each language, outside the held-out fold.

    The rows are those of lowest hash of their id, so that reruns agree; a threshold on the
    hash leaves about 3 * rows of a language to choose from. None without labelled text.
    """
    name = F.xxhash64("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy("name", "doc_id", "text")
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (_fold(docs) != held_out))
    counts = materialise(labelled.groupBy("lang").agg(F.count("*").alias("labelled")))
    begin = (F.pmod(name, F.greatest(F.char_length("text") - TRAIN_BYTES, F.lit(1))) + 1).cast("int")
    # a share of a language's rows that holds some three times as many as are taken
    share = F.pmod(name, F.lit(1 << 30)) * F.col("labelled") < F.lit(3 * rows * (1 << 30))
    chosen = (
        labelled.select("doc_id", "lang", "text")
        .join(counts, "lang")
        .where(share)
        .select("lang", "doc_id", name.alias("name"), F.substr(F.col("text"), begin, F.lit(TRAIN_BYTES)).alias("text"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rows)
    )
    sample = sorted((r["lang"], r["place"], r["text"]) for r in chosen.collect())
    if not sample:
        return None
    model = ByteCnn(sorted({lang for lang, _, _ in sample}))
    code = {lang: i for i, lang in enumerate(model.languages)}
    windows = [windows_of(text.encode()) for _, _, text in sample]
    label = np.repeat([code[lang] for lang, _, _ in sample], [len(w) for w in windows])
    model.train(np.concatenate(windows), label)
    return model


def identify_language(docs: DataFrame, model: ByteCnn | None, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score from all bytes of every text.

    The mean of the windows' log probabilities decides; `score` is its share after a
    softmax. Null texts, texts without a letter, and all texts when nothing was learned are
    `und` with score 0. Rows are judged by themselves; only doc_id and text are read.
    """

    def work():
        tables = model.pair_tables() if model else []

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch["text"].to_pylist()
            spoken = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if spoken:
                windows = [windows_of(texts[i].encode()) for i in spoken]
                counts = np.array([len(w) for w in windows])
                logs = model.predict(np.concatenate(windows), tables).astype(np.float64)
                mean = np.add.reduceat(logs, np.cumsum(counts) - counts) / counts[:, None]
                share = np.exp(mean - mean.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                for i, k, s in zip(spoken, best, share[np.arange(len(best)), best]):
                    pred[i], score[i] = model.languages[k], float(s)
            held = [fold(x) == held_out for x in batch["doc_id"].to_pylist()]
            columns = [batch["doc_id"], pa.array(held, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        return each

    narrow = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return map_portions(narrow, work, schema)
