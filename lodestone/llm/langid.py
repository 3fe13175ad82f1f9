"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of byte n-gram presence: for each order 1 to 4 the
number of n-grams (of lower-cased letters, hashed to 16 bits) that both hold, divided by the root of
the product of their counts, averaged over orders. A bounded, stratified sample of labelled texts
gives the Nystrom landmarks and the training rows; kernel ridge regression in the Nystrom feature
space gives one weight vector for each language against the rest. As the kernel is linear in the
presence vectors, landmark rows times ridge weights fold into one table (order, n-gram) x language.

Texts are scored a batch at a time: the n-grams of up to 64 texts form the rows of a sparse presence matrix for
each order, and its product with that order's table (entries gathered, then summed by row) gives all outputs.

The score is the softmax of the one-versus-rest outputs at a temperature fitted on the training rows.

The sample: of each language at most ``per_language`` different texts, of all together at most ``most`` (at least
one a language), the first by a hash of the text. Executors turn them into presence rows, so the driver gets at most
32 KB of each, however long a text is.

Defined cases: a text that is null or has no letter is ``und`` with score 0; if no labelled text
exists, every text is. Ties go to the language first in alphabetical order. Null labels are not
learned from. Repeated rows, extra columns and texts of any length change nothing; whole texts count. Columns of
``docs`` called lang_pred or score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import hash_sample, text_slices, trim

ORDERS = 4
BITS = 16
SIZE = 1 << BITS
#: texts of one sparse product
ROOM = 64
_SPACE = 32
_KEEP = np.array([c if c >= 128 or chr(c).isalpha() else _SPACE for c in range(256)], np.uint8)
_PIECE = 1 << 20
#: gathered table entries at a time
_ENTRIES = 1 << 21


def _framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lead): letters with everything ASCII else folded to single spaces; a space before each text and after the last.

    Text i stands between the spaces at lead[i] and lead[i + 1], which its neighbours share.
    """
    n = len(offsets) - 1
    b = np.full(len(data) + n + 1, _SPACE, np.uint8)
    inside = np.ones(len(b), bool)
    inside[offsets + np.arange(n + 1)] = False
    b[inside] = _KEEP[data]
    letter = b != _SPACE
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    at = np.cumsum(keep, dtype=np.int64) - 1
    return b[keep], at[offsets + np.arange(n + 1)]


def _codes(b: np.ndarray, order: int) -> np.ndarray:
    """16-bit code of each n-gram, by its first byte."""
    n = len(b) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    code = b[:n].astype(np.uint32)
    for k in range(1, order):
        code = code * np.uint32(0x01000193) ^ b[k : n + k]
    if order > 2:
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return code & np.uint32(SIZE - 1)


class Presence:
    """Presence matrices of runs of texts: for each order (pointer, n-grams), rows of distinct sorted 16-bit codes."""

    def __init__(self):
        self.flags = np.zeros(ROOM * SIZE, np.uint8)

    def _take(self, texts: int) -> tuple[np.ndarray, np.ndarray]:
        found = np.flatnonzero(self.flags[: texts * SIZE])
        self.flags[found] = 0
        return np.searchsorted(found, np.arange(texts + 1) * SIZE), (found & (SIZE - 1)).astype(np.uint16)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``data`` is lower-cased; at most ROOM texts."""
        n = len(offsets) - 1
        if n == 1 and len(data) > _PIECE:
            return self._long(data)
        b, lead = _framed(data, offsets)
        of = np.repeat(np.arange(n), np.diff(lead))
        stop = lead[1:][of]
        out = []
        for order in range(1, ORDERS + 1):
            code = _codes(b, order)[: len(of)]
            own = np.arange(len(code)) + order - 1 <= stop[: len(code)]
            self.flags[of[: len(code)][own] * SIZE + code[own]] = 1
            out.append(self._take(n))
        return out

    def _long(self, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """One text, a piece at a time; each piece starts with the last bytes before it."""
        carry = np.array([_SPACE], np.uint8)
        for at in range(0, len(data), _PIECE):
            end = [np.array([_SPACE], np.uint8)] if at + _PIECE >= len(data) else []
            b = np.concatenate([carry, _KEEP[data[at : at + _PIECE]], *end])
            letter = b != _SPACE
            letter[1:] |= letter[:-1].copy()
            letter[0] = True
            b = b[letter]
            for order in range(1, ORDERS + 1):
                self.flags[(order - 1) * SIZE + _codes(b, order).astype(np.int64)] = 1
            carry = b[-(ORDERS - 1) :]
        pointer, codes = self._take(ORDERS)
        return [(np.array([0, hi - lo]), codes[lo:hi]) for lo, hi in zip(pointer, pointer[1:])]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    low = (data | 32) - ord("a") < 26
    if len(offsets) == 2:  # a text of any length
        return np.array([bool(low.any()) or any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))])
    count = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
    out = count(low) > 0
    for i in np.flatnonzero(~out & (count(data >= 128) > 0)):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def times(pointer: np.ndarray, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Presence rows, scaled to unit length, times ``table`` (n-grams x columns): a sparse matrix product."""
    size = np.diff(pointer)
    out = np.zeros((len(size), table.shape[1]))
    full = np.flatnonzero(size)
    most = max(1, _ENTRIES // table.shape[1])
    at = 0
    while at < len(full):
        stop = max(at + 1, int(np.searchsorted(pointer[full + 1], pointer[full[at]] + most, "right")))
        some = full[at:stop]
        lo, hi = pointer[some[0]], pointer[some[-1] + 1]
        out[some] = np.add.reduceat(table[codes[lo:hi]], pointer[some] - lo, axis=0, dtype=np.float64) / np.sqrt(size[some])[:, None]
        at = stop
    return out


class Model:
    """languages, and for each order a table n-gram x language; ``temperature`` scales the outputs."""

    def __init__(self, languages: list[str], tables: list[np.ndarray], temperature: float):
        self.languages, self.tables, self.temperature = languages, tables, temperature

    def outputs(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(texts x languages) of the presence rows of a batch."""
        return sum(times(pointer, codes, table) for (pointer, codes), table in zip(rows, self.tables)) / ORDERS


def stack(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64), np.concatenate(codes)


def fit(codes: list[list[np.ndarray]], labels: list[str], landmarks: int = 400, ridge: float = 1e-3) -> Model | None:
    """Nystrom kernel ridge regression on presence rows (``codes[row][order]``); None without any row."""
    if not codes:
        return None
    languages = sorted(set(labels))
    target = np.array([[1.0 if y == x else -1.0 for x in languages] for y in labels])
    # landmarks: as many of each language as its share by round robin allows
    by = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
    chosen = [rows[r] for r in range(max(map(len, by.values()))) for rows in by.values() if r < len(rows)][: max(landmarks, len(languages))]
    n, m = len(codes), len(chosen)
    kernel = np.zeros((n, m))
    for k in range(ORDERS):
        pointer, every = stack([c[k] for c in codes])
        for at in range(0, m, 100):  # few landmarks at a time: the driver's memory is small
            block = np.zeros((SIZE, len(chosen[at : at + 100])), np.float32)
            for j, i in enumerate(chosen[at : at + 100]):
                if len(codes[i][k]):
                    block[codes[i][k], j] = 1 / np.sqrt(len(codes[i][k]))
            kernel[:, at : at + 100] += times(pointer, every, block)
    kernel /= ORDERS
    among = kernel[chosen]
    # weights alpha over landmarks: (K'WK + n*ridge*among) alpha = K'Wy, classes weighted evenly
    weight = np.zeros(n)
    for rows in by.values():
        weight[rows] = n / (len(languages) * len(rows))
    left = kernel.T @ (kernel * weight[:, None]) + n * ridge * among + 1e-8 * n * np.eye(m)
    alpha = np.linalg.solve(left, kernel.T @ (target * weight[:, None]))
    tables = []
    for k in range(ORDERS):
        table = np.zeros((SIZE, len(languages)))
        for j, i in enumerate(chosen):
            if len(codes[i][k]):
                table[codes[i][k]] += alpha[j] / np.sqrt(len(codes[i][k]))
        tables.append(table.astype(np.float32))
    out = kernel @ alpha
    truth = target.argmax(1)
    best, temperature = np.inf, 1.0
    for t in (1, 2, 3, 4, 6, 8, 12):
        z = out * t
        z -= z.max(1, keepdims=True)
        loss = float((weight * (np.log(np.exp(z).sum(1)) - z[np.arange(n), truth])).mean())
        if loss < best:
            best, temperature = loss, float(t)
    return Model(languages, tables, temperature)


def pack(codes: list[np.ndarray]) -> bytes:
    """For each order its number of n-grams, then their list, or a bit map where that is shorter: at most 32 KB."""
    out = [np.array([len(c) for c in codes], "u4").tobytes()]
    for c in codes:
        if 16 * len(c) > SIZE:
            flags = np.zeros(SIZE, np.uint8)
            flags[c] = 1
            out.append(np.packbits(flags).tobytes())
        else:
            out.append(c.astype("u2").tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 4 * ORDERS
    for n in np.frombuffer(data, "u4", ORDERS).tolist():
        if 16 * n > SIZE:
            out.append(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, SIZE // 8, at))).astype(np.uint16))
            at += SIZE // 8
        else:
            out.append(np.frombuffer(data, "u2", n, at))
            at += 2 * n
    return out


def sample_labelled(docs: DataFrame, learn_from, per_language: int, most: int) -> tuple[list[list[np.ndarray]], list[str]]:
    """(presence rows, languages) of the bounded sample, in a fixed order."""
    usable = learn_from & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")
    rows = docs.where(usable).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    keys = hash_sample(rows.select("lang", "h"), "lang", per_language, most)

    def presence(batches):
        maker, seen = Presence(), set()
        for batch in batches:
            out = []
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    for _, _, data, offsets in text_slices(batch.column(2).slice(k, 1), lower=True):
                        out.append((*key, pack([codes for _, codes in maker.rows(data, offsets)])))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "codes"])

    # the keys are bounded by most; equal texts have equal rows, of which one is kept
    found = rows.join(F.broadcast(keys), ["lang", "h"]).mapInArrow(presence, "lang string, h long, codes binary")
    kept = sorted(found.groupBy("lang", "h").agg(F.min("codes").alias("codes")).collect(), key=lambda r: (r.lang, r.h))
    return [unpack(bytes(r.codes)) for r in kept], [r.lang for r in kept]


def predict(docs: DataFrame, learn_from, keep: list[str] | None = None, per_language: int = 400, landmarks: int = 400, most: int = 20_000) -> DataFrame:
    """``keep`` columns (all) of ``docs`` with lang_pred and score; learns from the sample among rows where ``learn_from``."""
    model = fit(*sample_labelled(docs, learn_from, per_language, most), landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = docs.select(F.col("text").alias("_text"), *[c for c in names if c != "text"])

    def run(batches):
        model, presence = shared.value, Presence()
        for batch in batches:
            text = batch.column(0)
            best, score = np.full(len(text), -1), np.zeros(len(text))
            for i, j, data, offsets in text_slices(text, _PIECE, ROOM, lower=True):
                letters = has_letter(data, offsets)
                if model is None or not letters.any():
                    continue
                z = model.outputs(presence.rows(data, offsets)) * model.temperature
                p = np.exp(z - z.max(1, keepdims=True))
                top = p.argmax(1)
                best[i:j] = np.where(letters, top, -1)
                score[i:j] = np.where(letters, p[np.arange(len(top)), top] / p.sum(1), 0.0)
            pred = pa.array([*(model.languages if model else ()), "und"], pa.string()).take(pa.array(best % (len(model.languages) + 1 if model else 1)))
            others = iter(batch.columns[1:])
            yield pa.RecordBatch.from_arrays([*(text if c == "text" else next(others) for c in names), pred, pa.array(score)], [*names, "lang_pred", "score"])
            trim()

    schema = StructType([docs.schema[c] for c in names]).add("lang_pred", StringType()).add("score", DoubleType())
    return sent.mapInArrow(run, schema)
