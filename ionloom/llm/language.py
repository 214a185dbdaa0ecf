"""Language identification by a bidirectional gated recurrent network over bytes.

Model: every byte of the UTF-8 text is one input. Two recurrent layers (left to right, right to left)
of `HIDDEN` gated units (squashed by x / (1 + |x|)) read a window of `WINDOW` bytes; a softmax over both states labels every
position. A document's probabilities are the mean over all its positions.

Training: backpropagation through time, written in numpy, on a bounded sample: at most `SAMPLE`
documents and `WINDOWS` windows a language, the documents with the smallest key of their id. The counts
per language come from all documents. `HELD_OUT` of `FOLDS` folds are never seen.

Prediction: Spark tasks cut every whole text into windows and run them side by side, longest first, so
a step of the recurrence is one matrix product over all windows that still have a byte. Memory is
bounded by `BATCH` windows, whatever a text's length. The weights are a few kilobytes.

Defined cases: null text and text without a letter get `und` with score 0, and so does every text where
nothing could be learned (an empty table, no labels); a null id belongs to fold 0; rows that repeat are
predicted each; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm import kernels as kn

HIDDEN = 16
WINDOW = 128
BATCH = 2048
SAMPLE = 256
WINDOWS = 768
EPOCHS = 8
RATE = 0.01
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


class Model(NamedTuple):
    """Weights of both directions (first axis) and the languages in the order of the outputs.

    `inputs` holds what each byte adds to the three gates (reset, update, candidate), `hidden` the
    recurrent weights, `bias` the candidate's recurrent bias, `out` and `shift` the labelling layer.
    """

    languages: tuple[str, ...]
    inputs: np.ndarray  # 2, 256, 3 H
    hidden: np.ndarray  # 2, H, 3 H
    bias: np.ndarray  # 2, 1, H
    out: np.ndarray  # 2, H, L
    shift: np.ndarray  # L

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.bias, self.out, self.shift]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    n = len(languages)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Model(
        tuple(languages), draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden**-0.5),
        np.zeros((2, 1, hidden), np.float32), draw(2, hidden, n, scale=hidden**-0.5), np.zeros(n, np.float32),
    )


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: bounded like tanh, at a fraction of an exponential's price."""
    divisor = np.abs(x)
    divisor += 1
    return np.divide(x, divisor, out=x)


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of `squash` from its value."""
    return (1 - np.abs(y)) ** 2


class Step(NamedTuple):
    """What backpropagation needs of one step."""

    before: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray
    recurrent: np.ndarray
    after: np.ndarray


def step(model: Model, state: np.ndarray, codes: np.ndarray) -> Step:
    """One byte of every window in both directions; `state` is (2, B, H), `codes` (2, B)."""
    h = state.shape[2]
    x = np.stack([model.inputs[0].take(codes[0], axis=0), model.inputs[1].take(codes[1], axis=0)])
    u = np.matmul(state, model.hidden)
    gates = squash(x[:, :, : 2 * h] + u[:, :, : 2 * h])
    gates += 1
    gates *= 0.5
    recurrent = u[:, :, 2 * h :] + model.bias
    candidate = squash(x[:, :, 2 * h :] + gates[:, :, :h] * recurrent)
    after = candidate + gates[:, :, h:] * (state - candidate)
    return Step(state, gates, candidate, recurrent, after)


def directed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: int) -> np.ndarray:
    """Bytes of step t: from the left and from the right end of each window."""
    return np.stack([data[starts + t], data[starts + lengths - 1 - t]])


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def mirrored(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(L, T, B) by steps from the right end of each window as (L, T, B) by positions, and back."""
    n, span, width = values.shape
    place = np.maximum(lengths - 1 - np.arange(span)[:, None], 0) * width + np.arange(width)
    return values.reshape(n, -1).take(place.ravel(), axis=1).reshape(values.shape)


def label_windows(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, their lengths, probabilities L x T x B) by batches, longest first."""
    order = np.argsort(-lengths, kind="stable")
    hidden, outward = model.hidden.shape[1], model.out.transpose(0, 2, 1)
    for at in range(0, len(order), BATCH):
        mine = order[at : at + BATCH]
        begin, length = starts[mine], lengths[mine]
        span, active = int(length[0]), len(mine)
        parts = np.zeros((2, len(model.languages), span, active), np.float32)
        state = np.zeros((2, active, hidden), np.float32)
        for t in range(span):
            active = int(np.searchsorted(-length, -t, side="left"))  # windows longer than t
            state = step(model, state[:, :active], directed(data, begin[:active], length[:active], t)).after
            parts[:, :, t, :active] = np.matmul(outward, state.transpose(0, 2, 1))
        yield mine, length, softmax(parts[0] + mirrored(parts[1], length) + model.shift[:, None, None])


def windows_of(offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the windows that cover every row."""
    size = np.diff(offsets)
    count = -(-size // window)
    rows = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[rows] + place * window
    return starts, np.minimum(offsets[rows + 1] - starts, window), rows


def gradients(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of all positions and its gradients, by backpropagation through time.

    Windows come longest first. `target` is the language of each window, which all its positions carry.
    """
    hidden, n = model.hidden.shape[1], len(model.languages)
    span, total = int(lengths[0]), int(lengths.sum())
    state = np.zeros((2, len(starts), hidden), model.hidden.dtype)
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(span)]
    steps, codes = [], []
    parts = np.zeros((2, n, span, len(starts)), model.hidden.dtype)
    for t in range(span):
        codes.append(directed(data, starts[: active[t]], lengths[: active[t]], t))
        steps.append(step(model, state[:, : active[t]], codes[t]))
        state = steps[t].after
        parts[:, :, t, : active[t]] = np.matmul(model.out.transpose(0, 2, 1), state.transpose(0, 2, 1))
    chance = softmax(parts[0] + mirrored(parts[1], lengths) + model.shift[:, None, None])
    inside = np.arange(span)[:, None] < lengths[None, :]
    own = np.take_along_axis(chance, np.broadcast_to(target, (1, *inside.shape)), axis=0)[0]
    loss = -float(np.log(np.maximum(own[inside], 1e-30)).sum()) / total
    error = chance
    error[target, :, np.arange(len(target))] -= 1
    error *= inside / total
    both = np.stack([error, np.where(inside, mirrored(error, lengths), 0)]).transpose(0, 2, 3, 1)

    of_inputs, of_hidden = np.zeros_like(model.inputs), np.zeros_like(model.hidden)
    of_bias, of_out = np.zeros_like(model.bias), np.zeros_like(model.out)
    carried = np.zeros((2, 0, hidden), model.hidden.dtype)
    transposed, out_transposed = model.hidden.transpose(0, 2, 1), model.out.transpose(0, 2, 1)
    for t in range(span - 1, -1, -1):
        s, here = steps[t], both[:, t, : active[t]]
        of_out += np.matmul(s.after.transpose(0, 2, 1), here)
        grad = np.matmul(here, out_transposed)
        grad[:, : carried.shape[1]] += carried
        reset, update = s.gates[:, :, :hidden], s.gates[:, :, hidden:]
        of_candidate = grad * (1 - update) * slope(s.candidate)
        of_update = grad * (s.before - s.candidate) * slope(2 * update - 1) * 0.5
        of_reset = of_candidate * s.recurrent * slope(2 * reset - 1) * 0.5
        through = of_candidate * reset
        inner = np.concatenate([of_reset, of_update, through], axis=2)
        outer = np.concatenate([of_reset, of_update, of_candidate], axis=2)
        carried = grad * update + np.matmul(inner, transposed)
        of_hidden += np.matmul(s.before.transpose(0, 2, 1), inner)
        of_bias += through.sum(axis=1, keepdims=True)
        for d in (0, 1):
            np.add.at(of_inputs[d], codes[t][d], outer[d])
    return loss, [of_inputs, of_hidden, of_bias, of_out, error.sum(axis=(1, 2))]


def train(texts: list[bytes], languages: list[str], window: int = WINDOW, windows: int = WINDOWS, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 7, batch: int = 128) -> Model:
    """A model of the texts and their languages; the same texts in the same order give the same model."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    model = new_model(names, hidden, seed)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts, lengths, rows = windows_of(np.cumsum([0, *map(len, texts)]), window)
    if not len(starts):
        return model
    of = np.array([names.index(x) for x in languages])[rows]
    picked = []
    for k in range(len(names)):  # as many windows of every language, repeated where there are few
        mine = np.flatnonzero(of == k)
        if len(mine):
            picked.append(rng.choice(mine, windows, replace=len(mine) < windows))
    picked = np.concatenate(picked)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights]
    turns, steps = 0, epochs * -(-len(picked) // batch)
    for _ in range(epochs):
        rng.shuffle(picked)
        for at in range(0, len(picked), batch):
            mine = picked[at : at + batch]
            # Some windows are cut short, as short texts are.
            cut = np.where(rng.random(len(mine)) < 0.25, rng.integers(1, window + 1, len(mine)), window)
            size = np.minimum(lengths[mine], cut)
            mine = mine[np.argsort(-size, kind="stable")]
            size = np.sort(size)[::-1]
            _, found = gradients(model, data, starts[mine], size, of[mine])
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in found))
            turns += 1
            rate = RATE * (1 - 0.9 * turns / steps)
            for w, g, (m, v) in zip(model.weights, found, moments, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**turns)) / (np.sqrt(v / (1 - 0.99**turns)) + 1e-8)
    return model


def fold(id_column: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def learning_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(lang, text): about `sample` documents of every language, never more than twice that.

    Every language has its share of the key space from its count over all documents, so the selection is
    a filter on the scan; ties of the key are cut by the bound.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & (fold("id") != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    key = F.pmod(F.xxhash64(F.lit(13), F.col("id").cast("string")), F.lit(1 << 40))
    limit = F.lit(0).cast("long")
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 40, (sample << 40) // n))).otherwise(limit)
    drawn = rows.withColumn("key", key).filter(F.col("key") < limit)
    taken = drawn.orderBy("key", "lang", "text").limit(2 * sample * len(counts)).select("lang", "text").collect()
    return [(r["lang"], r["text"]) for r in taken]


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **options) -> Model | None:
    """The model of the folds that are not held out; None where there is nothing to learn."""
    rows = learning_rows(docs, id_column, text_column, lang_column)
    return train([t.encode() for _, t in rows], [x for x, _ in rows], **options) if rows else None


def pooled(model: Model, column: pa.Array) -> np.ndarray:
    """Mean probabilities of every text, rows x languages; zeros for empty texts."""
    out = np.zeros((len(column), len(model.languages)))
    for first, data, offsets in kn.blocks(column):
        starts, lengths, rows = windows_of(offsets)
        for mine, length, chance in label_windows(model, data, starts, lengths):
            chance *= np.arange(chance.shape[1])[:, None] < length
            np.add.at(out, first + rows[mine], chance.sum(axis=1, dtype=np.float64).T)
        out[first : first + len(offsets) - 1] /= np.maximum(np.diff(offsets), 1)[:, None]
    return out


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score and `probabilities` (in the order of the model's languages) of every row."""
    rows = docs.select(F.col(id_column), (fold(id_column) == HELD_OUT).alias("held_out"), F.col(text_column).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    names = np.array([*(model.languages if model else ()), UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            chance = pooled(model, text) if model else np.zeros((len(text), 0))
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best = chance.argmax(axis=1) if model else np.zeros(len(text), np.int64)
            best = np.where(lettered & (chance.sum(axis=1) > 0), best, len(names) - 1)
            score = np.clip(np.c_[chance, np.zeros(len(text))][np.arange(len(text)), best], 0, 1)
            made = [pa.array(names[best], pa.string()), pa.array(score), pa.array(list(chance), pa.list_(pa.float64()))]
            columns = [batch.column(0), batch.column(1), *made]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "held_out", "lang_pred", "score", "probabilities"])

    schema = f"`{id_column}` {kind}, held_out boolean, lang_pred string, score double, probabilities array<double>"
    return rows.mapInArrow(run, schema)


def language_runs(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, begin, end, lang): the runs of positions that carry one label, in bytes; runs end with their window."""
    rows = docs.select(F.col(id_column), F.col(text_column).alias("_text"))
    schema = f"`{id_column}` {rows.schema[0].dataType.simpleString()}, begin bigint, end bigint, lang string"
    names = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in kn.blocks(batch.column(1)):
                starts, lengths, of = windows_of(offsets)
                for mine, length, chance in label_windows(model, data, starts, lengths):
                    label = np.where(np.arange(chance.shape[1])[:, None] < length, chance.argmax(axis=0), -1).T
                    new = np.c_[np.ones(len(label), bool), label[:, 1:] != label[:, :-1]]
                    window, at = np.nonzero(new)
                    value = label[window, at]
                    end = np.where(np.r_[window[1:] != window[:-1], True], label.shape[1], np.r_[at[1:], 0])
                    real = value >= 0
                    window, at, end, value = window[real], at[real], end[real], value[real]
                    base = (starts - offsets[of])[mine[window]]
                    ids = batch.column(0).take(pa.array(first + of[mine[window]]))
                    arrays = [ids, pa.array(base + at), pa.array(base + end), pa.array(names[value], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_column, "begin", "end", "lang"])

    return rows.mapInArrow(run, schema)
