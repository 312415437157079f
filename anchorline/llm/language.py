"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, gives every position
a distribution over languages, and pools them: the mean over the text's
positions is the document's distribution.  Gates are ``clip(x/4 + 1/2, 0, 1)``
and the candidate is ``clip(x, -1, 1)``, which numpy evaluates quickly.

It is trained in numpy by backpropagation through time on snippets of at most
``per_language`` labelled documents of each language, chosen by a hash of the
text: a bounded sample, while every byte of every text is classified.  Texts are
read in segments of ``SEGMENT`` bytes with ``CONTEXT`` bytes on either side to
warm up the states; a text's segments are pooled wherever they were read.

``known`` is the filter: a second network of the same kind has one class more, for
text in no language, learned from random letters of random scripts.  A text goes
if that class's share of its positions, after ``PRIOR`` positions in favour of a
language, is above a margin set on labelled rows kept from training.

Defined results: a text that is NULL or has no letter (Unicode category L, so
neither ``\u00bd`` nor ``\u2168``) is ``und`` with score 0;
if there is nothing to learn from, so is every text; equal texts get equal
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Slice, passing, record_batch, slices

PER_LANGUAGE = 256
SNIPPET = 64
STEPS, BATCH, RATE = 220, 128, 0.02
HIDDEN = 8
SEGMENT, CONTEXT = 240, 8
UNKNOWN = "und"
#: stands where a row has no byte: its update gate is shut, so states pass it unchanged
NOTHING = 256

#: of the labelled sample, one in so many is kept from training to set the margin
KEPT_BACK = 4
#: texts in no language made for training, and the share of its language's sample that may be refused
NOISE_TEXTS, REFUSED = 256, 0.01
#: positions in favour of a language that every text starts with, so that a few bytes decide nothing
PRIOR = 32


@dataclass
class Network:
    """Weights; the first axis of the recurrent ones is the direction."""

    languages: list[str]
    inputs: np.ndarray  # 2, 257, 3 hidden: update, reset, candidate
    gates: np.ndarray  # 2, hidden, 2 hidden
    candidate: np.ndarray  # 2, hidden, hidden
    out: np.ndarray  # 2 hidden, languages
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.candidate, self.out, self.bias]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        inputs = normal(2, NOTHING + 1, 3 * hidden, scale=0.5)
        inputs[:, NOTHING] = 0
        inputs[:, NOTHING, :hidden] = -1e9
        return cls(
            languages,
            inputs,
            normal(2, hidden, 2 * hidden, scale=0.3),
            normal(2, hidden, hidden, scale=0.3),
            normal(2 * hidden, len(languages), scale=0.3),
            np.zeros(len(languages), np.float32),
        )

    def states(self, rows: np.ndarray, keep: bool = False):
        """States after each byte in both directions, [time, direction, row, hidden].

        ``rows`` is [row, time]; the second direction's states are at their own
        positions, so both can be read at one place.  With ``keep`` also what
        backpropagation needs.
        """
        time, hidden = rows.shape[1], self.candidate.shape[1]
        out = np.empty((time, 2, len(rows), hidden), np.float32)
        state = np.zeros((2, len(rows), hidden), np.float32)
        kept = []
        both = np.arange(2)[:, None]
        for t in range(time):
            read = np.stack([rows[:, t], rows[:, time - 1 - t]])
            x = self.inputs[both, read]
            raw = np.matmul(state, self.gates)
            raw += x[..., : 2 * hidden]
            raw *= 0.25
            raw += 0.5
            gate = np.clip(raw, 0, 1)
            update, reset = gate[..., :hidden], gate[..., hidden:]
            shown = reset * state
            pre = np.matmul(shown, self.candidate)
            pre += x[..., 2 * hidden :]
            new = np.clip(pre, -1, 1)
            before = state
            state = new - before
            state *= update
            state += before
            out[t, 0] = state[0]
            out[time - 1 - t, 1] = state[1]
            if keep:
                kept.append((read, before, raw, gate, shown, pre, new))
        return (out, kept) if keep else out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """The distribution over languages at every [time, row]."""
        hidden = self.candidate.shape[1]
        scores = states[:, 0] @ self.out[:hidden]
        scores += states[:, 1] @ self.out[hidden:]
        scores += self.bias
        scores -= scores.max(-1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(-1, keepdims=True)
        return scores

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the mean cross-entropy of all positions."""
        states, kept = self.states(rows, keep=True)
        time, hidden = rows.shape[1], self.candidate.shape[1]
        error = self.positions(states)
        error[:, np.arange(len(rows)), labels] -= 1
        error /= error.shape[0] * error.shape[1]
        d_out = np.concatenate([np.einsum("trh,trl->hl", states[:, d], error) for d in range(2)])
        d_states = np.stack([error @ self.out[:hidden].T, error @ self.out[hidden:].T], 1)
        d_inputs, d_gates, d_candidate = (np.zeros_like(w) for w in (self.inputs, self.gates, self.candidate))
        flow = np.zeros((2, len(rows), hidden), np.float32)
        for t in reversed(range(time)):
            read, before, raw, gate, shown, pre, new = kept[t]
            flow[0] += d_states[t, 0]
            flow[1] += d_states[time - 1 - t, 1]
            update, reset = gate[..., :hidden], gate[..., hidden:]
            d_pre = flow * update * (np.abs(pre) < 1)
            d_update = flow * (new - before)
            back = flow * (1 - update)
            d_shown = np.matmul(d_pre, self.candidate.transpose(0, 2, 1))
            back += d_shown * reset
            d_gate = np.concatenate([d_update, d_shown * before], -1) * ((raw > 0) & (raw < 1)) * 0.25
            back += np.matmul(d_gate, self.gates.transpose(0, 2, 1))
            d_candidate += np.matmul(shown.transpose(0, 2, 1), d_pre)
            d_gates += np.matmul(before.transpose(0, 2, 1), d_gate)
            d_x = np.concatenate([d_gate, d_pre], -1)
            for d in range(2):
                np.add.at(d_inputs[d], read[d], d_x[d])
            flow = back
        return [d_inputs, d_gates, d_candidate, d_out, error.sum((0, 1))]


def train(snippets: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network:
    """Fit a network to (language, bytes) pairs with Adam, languages drawn evenly."""
    rng = np.random.default_rng(seed)
    languages = sorted({language for language, _ in snippets})
    net = Network.fresh(languages, hidden, rng)
    texts = [[np.frombuffer(raw, np.uint8) for name, raw in snippets if name == language] for language in languages]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    for step in range(1, steps + 1):
        labels = rng.integers(len(languages), size=BATCH)
        rows = np.full((BATCH, SNIPPET), NOTHING, np.uint16)
        for row, label in zip(rows, labels, strict=True):
            text = texts[label][rng.integers(len(texts[label]))]
            at = rng.integers(max(1, len(text) - SNIPPET + 1))
            part = text[at : at + SNIPPET]
            row[: len(part)] = part
        rate = RATE * min(1, step / 10) * (1 - 0.9 * step / steps)
        for w, g, (m, v) in zip(net.weights(), net.gradients(rows, labels), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def sample(docs: DataFrame, may_learn, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """At most ``per_language`` labelled texts of each language, four snippets of each.

    One text for each value of a hash of the text, so the choice is spread over
    all documents and combined before the shuffle.
    """
    size = 2 * SNIPPET
    places = [F.pmod(F.xxhash64("text", F.lit(i)), F.greatest(F.lit(1), F.length("text") - size)) for i in range(4)]
    snippets = F.concat_ws("\n", *[F.substring("text", at.cast("int") + 1, F.lit(size)) for at in places])
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select(
        "lang",
        F.xxhash64("text").alias("rank"),
        F.pmod(F.xxhash64("text", F.lit("slot")), F.lit(per_language)).alias("slot"),
        snippets.alias("snippets"),
    )
    chosen = rows.groupBy("lang", "slot").agg(F.min_by("snippets", F.struct("rank", "snippets")).alias("snippets"))
    return sorted((row.lang, row.snippets.encode()) for row in chosen.collect())


def document_scores(net: Network, part: Slice, rows_at_once: int = 512) -> np.ndarray:
    """The mean distribution over each text's positions, [text, language]."""
    data, offsets = part.data, part.offsets
    lengths = part.lengths
    per_text = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(part)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = offsets[owner] + number * SEGMENT
    end = np.minimum(begin + SEGMENT, offsets[owner + 1])
    totals = np.zeros((len(part), len(net.languages)))
    order = np.argsort(end - begin, kind="stable")
    for at in range(0, len(order), rows_at_once):
        own = order[at : at + rows_at_once]
        width = int((end[own] - begin[own]).max()) + 2 * CONTEXT
        where = begin[own, None] - CONTEXT + np.arange(width)
        inside = (where >= offsets[owner[own], None]) & (where < offsets[owner[own] + 1, None])
        rows = np.where(inside, data[np.clip(where, 0, len(data) - 1)], np.uint16(NOTHING))
        scores = net.positions(net.states(rows))
        counted = (where >= begin[own, None]) & (where < end[own, None])
        sums = np.einsum("trl,rt->rl", scores, counted.astype(np.float32))
        np.add.at(totals, owner[own], sums)
    return totals / np.maximum(1, lengths)[:, None]


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def has_letter(part: Slice) -> list[bool]:
    """Whether each text of a slice has a letter."""
    return [any(map(str.isalpha, text.decode())) for text in part.texts()]


def predictions(net: Network | None, part: Slice) -> tuple[list[str], list[float]]:
    """Language and score of every text of a slice."""
    readable = has_letter(part)
    names, scores = [UNKNOWN] * len(part), [0.0] * len(part)
    if net is not None:
        found = document_scores(net, part)
        best = found.argmax(1)
        for i in np.flatnonzero(readable).tolist():
            names[i] = net.languages[best[i]]
            scores[i] = round(min(1.0, float(found[i, best[i]])), 4)
    return names, scores


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield record_batch(_SCHEMA, part.column("doc_id"), part.column("held_out"), *predictions(net, part))

    return run


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Network | None:
    snippets = sample(docs, ~held_out())
    return train(snippets) if snippets else None


def noise(count: int = NOISE_TEXTS, seed: int = 11) -> list[bytes]:
    """Texts in no language: words of random letters, half Latin, half of 64 neighbours anywhere in Unicode."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(count):
        latin = i % 2 == 0
        first = ord("a") if latin else int(rng.integers(0x250, 0x30000))
        letters = first + rng.integers(26 if latin else 64, size=4 * SNIPPET)
        gaps = rng.random(len(letters)) < rng.uniform(0.05, 0.25)
        points = np.where(gaps, ord(" "), letters)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        texts.append("".join(map(chr, points.tolist())).encode())
    return texts


@dataclass
class Filter:
    """A network with a class for text in no language, and the margin above which a text goes.

    It reads A-Z as a-z, so that text in capitals is judged like any other.
    """

    net: Network
    margin: float

    def refusals(self, part: Slice) -> np.ndarray:
        """Each text's share of positions in no language, beside ``PRIOR`` positions in one."""
        lower = copy(part)
        lower.data = LOWER[part.data]
        scores = document_scores(self.net, lower)[:, self.net.languages.index(NOISE)]
        return scores * part.lengths / (part.lengths + PRIOR)

    def passes(self, part: Slice) -> list[bool]:
        letters = has_letter(part)
        return [a and bool(b <= self.margin) for a, b in zip(letters, self.refusals(part), strict=True)]


#: names of the filter's classes: that of noise, and what stands before a language's
NOISE, LANGUAGE = "-", "+"


def fit_filter(docs: DataFrame) -> Filter | None:
    """A filter learned from the labelled texts; nothing if there are none.

    The margin is halfway between 1 and the share that all but ``REFUSED`` of the
    texts kept from training stay below.
    """
    snippets = [(LANGUAGE + name, raw.lower()) for name, raw in sample(docs, ~held_out())]
    if not snippets:
        return None
    back = snippets[::KEPT_BACK]
    learned = [pair for i, pair in enumerate(snippets) if i % KEPT_BACK] or snippets
    net = train(learned + [(NOISE, raw) for raw in noise()])
    found = Filter(net, 1.0)
    batch = pa.record_batch({"text": pa.array([raw for _, raw in back], pa.large_binary())})
    shares = np.concatenate([found.refusals(part) for part in slices([batch])])
    found.margin = (1 + float(np.quantile(shares, 1 - REFUSED))) / 2
    return found


def known(docs: DataFrame) -> DataFrame:
    """The documents, whole, that are in a language.

    If there is nothing to learn from, those with a letter.
    """
    found = fit_filter(docs)
    if found is None:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    return passing(docs, lambda: found.passes)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    net = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(net), PREDICTED)
