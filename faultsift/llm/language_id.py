"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.batches import bounded_batches, carried, free_name, made_batch, raw_bytes, text_slices

UNITS = 8           # of the state, per direction
LENGTH = 64         # bytes of a window; every byte of a text is in one
WINDOWS_AT_ONCE = 4096
BYTES = np.arange(256, dtype=np.uint8)
BYTES[65:91] += 32  # A-Z count as a-z
LETTER = np.zeros(256, np.float32)
LETTER[97:123] = LETTER[128:] = 1


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(LENGTH x windows bytes, owner rows): texts cut into windows, the last filled up with zeros."""
    size = np.diff(offsets)
    count = -(-size // LENGTH)
    owner = np.repeat(np.arange(len(size)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + turn * LENGTH
    at = start[None, :] + np.arange(LENGTH)[:, None]
    inside = at < offsets[1:][owner][None, :]
    filled = np.where(inside, BYTES[data[np.minimum(at, max(len(data) - 1, 0))]], 0) if len(data) else at.astype(np.uint8)
    return np.ascontiguousarray(filled.astype(np.uint8)), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer; `given` has what each byte adds to the update, reset and new-state gates."""

    def __init__(self, random: np.random.Generator):
        self.given = random.normal(0, 0.3, (3 * UNITS, 256)).astype(np.float32)
        self.given[:UNITS] -= 1.0  # states forget at first
        self.kept = random.normal(0, 1 / np.sqrt(UNITS), (3 * UNITS, UNITS)).astype(np.float32)

    def forward(self, text: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each byte, LENGTH x UNITS x windows."""
        u = UNITS
        states = np.empty((len(text), u, text.shape[1]), np.float32)
        state = np.zeros((u, text.shape[1]), np.float32)
        for t, x in enumerate(text):
            given, kept = np.take(self.given, x, axis=1), self.kept @ state
            gates = _sigmoid(given[:2 * u] + kept[:2 * u])
            update, reset = gates[:u], gates[u:]
            new = np.tanh(given[2 * u:] + reset * kept[2 * u:])
            if trace is not None:
                trace.append((state, update, reset, new, kept[2 * u:]))
            state = new + update * (state - new)
            states[t] = state
        return states

    def backward(self, text: np.ndarray, trace: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of (given, kept) from those of the states, back through time."""
        given, kept = np.zeros_like(self.given), np.zeros_like(self.kept)
        later = np.zeros_like(slopes[0])
        for t in range(len(text) - 1, -1, -1):
            state, update, reset, new, inner = trace[t]
            slope = slopes[t] + later
            d_new = slope * (1 - update) * (1 - new * new)
            d_gates = np.concatenate([slope * (state - new) * update * (1 - update),
                                      d_new * inner * reset * (1 - reset)])
            d_kept = np.concatenate([d_gates, d_new * reset])
            later = slope * update + self.kept.T @ d_kept
            kept += d_kept @ state.T
            hot = np.zeros((text.shape[1], 256), np.float32)
            hot[np.arange(text.shape[1]), text[t]] = 1
            given += np.concatenate([d_gates, d_new]) @ hot
        return given, kept


@dataclass
class LanguageModel:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray    # languages x (2 * UNITS + 1)

    def chances(self, text: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, states) at every position of every window; positions x (languages, states) x windows."""
        ahead = self.ahead.forward(text, traces and traces[0])
        back = self.back.forward(text[::-1], traces and traces[1])[::-1]
        states = np.concatenate([ahead, back, np.ones((len(text), 1, text.shape[1]), np.float32)], axis=1)
        logits = np.matmul(self.out, states)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits, states

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probability of each language over the positions of each text that hold letters."""
        rows = len(offsets) - 1
        total, seen = np.zeros((len(self.languages), rows)), np.zeros(rows)
        text, owner = windows(data, offsets)
        for at in range(0, len(owner), WINDOWS_AT_ONCE):
            part, own = text[:, at:at + WINDOWS_AT_ONCE], owner[at:at + WINDOWS_AT_ONCE]
            part = np.ascontiguousarray(part)
            letter = LETTER[part]
            chance, _ = self.chances(part)
            pooled = np.einsum("tkw,tw->kw", chance, letter)
            for k in range(len(self.languages)):
                total[k] += np.bincount(own, pooled[k], rows)
            seen += np.bincount(own, letter.sum(axis=0), rows)
        return total / np.maximum(seen, 1)


def train_network(text: np.ndarray, label: np.ndarray, languages: list[str], steps: int, batch: int, rate: float,
                  seed: int) -> LanguageModel:
    """Cross entropy at every letter position, by back-propagation through time with Adam steps."""
    random = np.random.default_rng(seed)
    model = LanguageModel(languages, Direction(random), Direction(random),
                          np.zeros((len(languages), 2 * UNITS + 1), np.float32))
    weights = [model.ahead.given, model.ahead.kept, model.back.given, model.back.kept, model.out]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        pick = random.integers(0, text.shape[1], batch)
        part = np.ascontiguousarray(text[:, pick])
        traces: tuple[list, list] = ([], [])
        chance, states = model.chances(part, traces)
        letter = LETTER[part]
        slope = chance
        slope[:, label[pick], np.arange(batch)] -= 1
        slope *= (letter / max(letter.sum(), 1))[:, None, :]
        into = np.matmul(model.out[:, :-1].T, slope)
        slopes = [*model.ahead.backward(part, traces[0], into[:, :UNITS]),
                  *model.back.backward(part[::-1], traces[1], into[::-1, UNITS:]),
                  np.einsum("tkw,tsw->ks", slope, states)]
        size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, train: Column, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
        max_per_language: int = 400, windows_per_text: int = 12, steps: int = 400, batch: int = 256,
        rate: float = 0.03, seed: int = 5) -> LanguageModel | None:
    """Learns from `max_per_language` documents of each language at most (of those for which `train`
    holds and whose language is known: by hash of the id), and `windows_per_text` random windows of each whole text;
    this bounds the memory and time of the fit, which runs in the driver. None without a usable document."""
    bounded_batches(docs.sparkSession)
    known = docs.where(train & F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    known = known.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("__text"),
                         F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 30)).alias("turn"))
    sizes = {r[0]: r[1] for r in docs.where(train & F.col(lang_column).isNotNull())
             .groupBy(F.col(lang_column).alias("lang")).count().collect()}
    if not sizes:
        return None
    upto = F.create_map(*(F.lit(x) for lang, n in sizes.items()
                          for x in (lang, int((1 << 30) * min(1.0, 4 * max_per_language / n)))))
    first = Window.partitionBy("lang").orderBy("turn", "__text")
    sample = (known.where(F.col("turn") <= F.element_at(upto, F.col("lang")))
              .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max_per_language)
              .drop("rank", "turn").toArrow().combine_chunks().sort_by([("lang", "ascending"), ("__text", "ascending")]))
    if not sample.num_rows:
        return None
    languages = sorted(set(sample["lang"].to_pylist()))
    random, texts, labels, at = np.random.default_rng(seed), [], [], 0
    for batch_ in sample.to_batches():
        for rows, part in text_slices(batch_, "__text"):
            text, owner = windows(*raw_bytes(part))
            lang = np.searchsorted(languages, rows.column(0).to_numpy(zero_copy_only=False).astype(str))
            order = np.lexsort((random.random(len(owner)), owner))
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            pick = order[rank < windows_per_text]
            texts.append(text[:, pick])
            labels.append(lang[owner[pick]])
            at += len(rows)
    text, label = np.concatenate(texts, axis=1), np.concatenate(labels)
    return train_network(text, label, languages, steps, batch, rate, seed)


def identify(docs: DataFrame, model: LanguageModel | None, *, text_column: str = "text",
             carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, `lang_pred` and `score`, the pooled probability of that language.

    Every byte of a text is labelled within its window by both directions; probabilities are averaged over
    letters. Null texts, texts without a letter, and all texts if there is no model get `und` and 0; ties go to
    the first language in order. Repeated rows stay; an empty table gives no rows; carried columns
    with made names are left out.
    """
    bounded_batches(docs.sparkSession)
    made = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    kept = carried(docs, carry, made)
    names = [f.name for f in kept]
    own, worded_name = free_name(docs, "__text"), free_name(docs, "__worded")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, own):
                worded = rows.column(rows.schema.get_field_index(worded_name)).to_numpy(zero_copy_only=False)
                if sent.value is None:
                    lang, score = np.full(len(rows), "und"), np.zeros(len(rows))
                else:
                    mean = sent.value.documents(*raw_bytes(texts))
                    lang = np.where(worded, np.array(sent.value.languages)[mean.argmax(axis=0)], "und")
                    score = np.where(worded, np.clip(mean.max(axis=0), 0, 1), 0.0)
                yield made_batch(rows, names, {"lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score)})

    text = docs[text_column]
    return docs.select(*[docs[n] for n in names], text.alias(own),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(worded_name)).mapInArrow(
        run, T.StructType(kept + made.fields))
