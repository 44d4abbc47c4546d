"""Language identification by a bidirectional gated recurrent network over bytes.

Method: numpy trains the network by backpropagation through time on labelled texts of a
bounded sample; every byte position gets a distribution over languages, and a document
pools the log-probabilities of all its positions.

A text's bytes run through the network in windows of at most ``CORE`` positions side by
side, cut between characters.  The state is carried across words, and into a window from
outside: each direction starts ``WARM`` bytes or more before the window's first position
in its sense (at the text's edge where that is nearer), so every position has read at
least that much of the text on either side.

Sample: ``per_language`` documents of each language, chosen by a hash of their id, each
with its whole text, in runs of ``RUN`` bytes; where those are more than ``RUNS`` a language, that
many of them, chosen by a hash of document and place wherever in a text they stand.  Cutting and
choosing happens where the rows are, so the driver holds ``RUNS`` * ``RUN`` bytes a language.
Prediction covers every position of every row.  lang, source and
doc_id never enter a prediction.  The languages are the distinct labels: the network's
width, and what the driver holds of them, is their number.

Defined cases: null texts and texts without a letter are ``und`` with score 0; very long
texts and texts without spaces are read whole; ties go to the language first in order;
repeated rows are predicted alike; rows with a null doc_id are predicted but never learned
from (held_out false); a table without labels predicts ``und`` throughout; an empty table
gives no rows; other columns are ignored or kept as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise, release
from .rows import pieces, released

PER_LANGUAGE = 150
HIDDEN = 8
#: Positions of a window, bytes before it that warm its state up, windows side by side.
CORE, WARM, LANES = 512, 32, 1024
#: Bytes of a training run; least updates of a training.
RUN, STEPS = 96, 400
#: Training runs of a language.
RUNS = 40_000
SEED = 7
#: Mean position probability of the predicted language under which the pipeline rejects.
LEAST_SCORE = 0.3
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Two gated recurrent layers, one per direction, and a softmax at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng, h = np.random.default_rng(seed), hidden
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {"out": draw(2 * h, len(languages), scale=0.1), "bias": np.zeros(len(languages), np.float32)}
        for side in "fb":
            # input weights of a byte for update, reset and candidate; recurrent weights and candidate bias
            self.weights |= {f"in_{side}": draw(256, 3 * h, scale=0.1), f"re_{side}": draw(h, 3 * h, scale=h**-0.5), f"c_{side}": np.zeros(h, np.float32)}

    def _states(self, codes: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """Hidden states (steps, words, hidden) over codes (words, steps)."""
        h, w_in, w_re, c = self.hidden, self.weights[f"in_{side}"], self.weights[f"re_{side}"], self.weights[f"c_{side}"]
        state, out = np.zeros((len(codes), h), np.float32), np.empty((codes.shape[1], len(codes), h), np.float32)
        for t in range(codes.shape[1]):
            x, u = w_in[codes[:, t]], state @ w_re
            gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r, un = gates[:, :h], gates[:, h:], u[:, 2 * h :] + c
            n = np.tanh(x[:, 2 * h :] + r * un)
            if trace is not None:
                trace.append((state, z, r, un, n))
            state = n + z * (state - n)
            out[t] = state
        return out

    @staticmethod
    def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of each word, the same reversed, and where position t lies reversed."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(lengths.max())
        codes = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
        mirror = lengths[:, None] - 1 - np.arange(longest)
        inside = mirror >= 0
        mirror = np.where(inside, mirror, np.arange(longest))
        return codes, np.take_along_axis(codes, mirror, 1), np.where(inside, mirror, -1)

    def _joined(self, forward: np.ndarray, backward: np.ndarray, mirror: np.ndarray) -> np.ndarray:
        """(steps, words, 2 hidden): both directions' states at the same byte."""
        at = np.maximum(mirror, 0).T
        return np.concatenate([forward, backward[at, np.arange(mirror.shape[0])]], axis=2)

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Per text: sum of log-probabilities, then of probabilities, by language; positions."""
        k = len(self.languages)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        cuts = -(-sizes // (CORE - 3))  # a cut moves back by 3 bytes at most
        own = np.repeat(np.arange(len(texts)), cuts)
        start = begin[own] + (np.arange(len(own)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * (CORE - 3)
        for _ in range(3):
            start = start - ((data[start] & 0xC0 == 0x80) & (start > begin[own]))
        stop = np.where(np.append(own[1:] == own[:-1], False), np.append(start[1:], 0), (begin + sizes)[own])
        out = np.zeros((len(texts), 2 * k + 1))
        order = np.argsort(start - stop, kind="stable")
        for at in range(0, len(order), LANES):
            rows = order[at : at + LANES]
            found = self._pooled(data, start[rows], stop[rows], begin[own[rows]], (begin + sizes)[own[rows]])
            np.add.at(out, own[rows], found)
        return out

    def _pooled(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``sums`` of windows start to stop within texts first to end, side by side."""
        h, w, n, longest = self.hidden, self.weights, len(start), int((stop - start).max())
        place = start.astype(np.int32) + np.arange(-WARM, longest + WARM, dtype=np.int32)[:, None]
        inside = (place >= first) & (place < np.minimum(end, stop + WARM))  # what is beyond depends on the windows beside
        codes = data[np.clip(place, 0, len(data) - 1)]
        counted = place < stop  # of the window itself, where place >= start
        # a sigmoid is half a tanh of half its argument, so the gates' weights are halved
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(w["out"].dtype)
        reads = {side: np.ascontiguousarray((w[f"in_{side}"] * half).T) for side in "fb"}
        again = {side: np.ascontiguousarray((w[f"re_{side}"] * half).T) for side in "fb"}

        def step(side: str, t: int, state: np.ndarray) -> np.ndarray:
            x, u = reads[side].take(codes[t], axis=1), again[side] @ state
            gates = np.tanh(x[: 2 * h] + u[: 2 * h])
            gates += 1
            gates *= 0.5
            u = u[2 * h :]
            u += w[f"c_{side}"][:, None]
            u *= gates[h:]
            u += x[2 * h :]
            np.tanh(u, out=u)
            state = state - u
            state *= gates[:h]
            state += u
            return state if whole[t] else state * inside[t]

        whole = inside.all(axis=1)
        state = np.zeros((h, n), w["out"].dtype)
        held = np.empty((longest, h, n), w["out"].dtype)
        for t in range(WARM + longest):
            state = step("f", t, state)
            if t >= WARM:
                held[t - WARM] = state
        k = len(self.languages)
        forth, back = np.ascontiguousarray(w["out"][:h].T), np.ascontiguousarray(w["out"][h:].T)
        logs, odds = np.zeros((k, n)), np.zeros((k, n))
        state = np.zeros((h, n), w["out"].dtype)
        for t in range(2 * WARM + longest - 1, WARM - 1, -1):
            state = step("b", t, state)
            if t < WARM + longest:
                scores = forth @ held[t - WARM] + back @ state + w["bias"][:, None]
                scores -= scores.max(axis=0)
                p = np.exp(scores)
                total = p.sum(axis=0)
                if counted[t].all():
                    logs += scores - np.log(total)
                    odds += p / total
                else:
                    logs += (scores - np.log(total)) * counted[t]
                    odds += p / total * counted[t]
        return np.concatenate([logs, odds, (stop - start)[None]]).T

    def _gradients(self, words: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        codes, reverse, mirror = self._codes(words)
        traces: dict[str, list] = {"f": [], "b": []}
        forward, backward = self._states(codes, "f", traces["f"]), self._states(reverse, "b", traces["b"])
        joined, inside = self._joined(forward, backward, mirror), (mirror >= 0).T[:, :, None]
        scores = joined @ self.weights["out"] + self.weights["bias"]
        odds = np.exp(scores - scores.max(axis=2, keepdims=True))
        wrong = odds / odds.sum(axis=2, keepdims=True)
        wrong[:, np.arange(len(words)), labels] -= 1
        wrong = wrong * inside / np.float32(inside.sum())
        flat = lambda x: x.reshape(-1, x.shape[-1])
        grads = {"out": flat(joined).T @ flat(wrong), "bias": flat(wrong).sum(axis=0)}
        down, h = wrong @ self.weights["out"].T, self.hidden
        behind = np.zeros_like(backward)
        steps, rows = np.nonzero(mirror.T >= 0)
        behind[mirror[rows, steps], rows] = down[steps, rows, h:]
        for side, errors, read in (("f", down[:, :, :h], codes), ("b", behind, reverse)):
            w_re, d_re, d_c = self.weights[f"re_{side}"], np.zeros((h, 3 * h), np.float32), np.zeros(h, np.float32)
            d_x, d_state = np.empty((read.shape[1], len(words), 3 * h), np.float32), np.zeros((len(words), h), np.float32)
            for t in range(read.shape[1] - 1, -1, -1):
                before, z, r, un, n = traces[side][t]
                d = errors[t] + d_state
                d_n = d * (1 - z) * (1 - n * n)
                d_z, d_r, d_un = d * (before - n) * z * (1 - z), d_n * un * r * (1 - r), d_n * r
                d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u = np.concatenate([d_z, d_r, d_un], axis=1)
                d_re += before.T @ d_u
                d_c += d_un.sum(axis=0)
                d_state = d * z + d_u @ w_re.T
            byte = read.T.reshape(-1)
            d_in = np.stack([np.bincount(byte, column, 256) for column in flat(d_x).T], axis=1).astype(np.float32)
            grads |= {f"re_{side}": d_re, f"c_{side}": d_c, f"in_{side}": d_in}
        return grads

    def fit(self, runs: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = 192, rate: float = 0.02) -> ByteGRU:
        """Adam over shuffled batches of runs; every run is read, and ``steps`` updates made at least."""
        rng, batch = np.random.default_rng(SEED), min(batch, max(16, len(runs) // 8))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        per_epoch = -(-len(runs) // batch)
        total, step = max(steps, per_epoch), 0
        while step < total:
            order = rng.permutation(len(runs))
            for at in range(0, len(order), batch):
                if step == total:
                    break
                part = order[at : at + batch]
                grads, step = self._gradients([runs[i] for i in part.tolist()], labels[part]), step + 1
                now = rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.weights[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def runs(text: str) -> list[bytes]:
    """All bytes of a text in runs of at most ``RUN``, cut between characters."""
    data, out, at = text.encode("utf-8", "replace"), [], 0
    while at < len(data):
        to = min(at + RUN, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of texts; ``text`` tells texts of one id apart."""
    import zlib

    names = ["doc_id", "lang", "text", "place", "run"]
    for batch in batches:
        for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, mark = runs(text), zlib.crc32(text.encode("utf-8", "replace"))
            for at in range(0, len(own), 50_000):
                part = own[at : at + 50_000]
                n = len(part)
                columns = [pa.array([doc_id] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array([mark] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)


def predict(model: ByteGRU, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    k, out = len(model.languages), [(UNKNOWN, 0.0)] * len(texts)
    rows = [i for i, t in enumerate(texts) if k and t and any(map(str.isalpha, t))]
    if rows:
        total = model.sums([texts[i].encode("utf-8", "replace") for i in rows])
        best = total[:, :k].argmax(axis=1)
        score = np.clip(total[np.arange(len(rows)), k + best] / total[:, 2 * k], 0, 1)
        for i, b, s in zip(rows, best.tolist(), score.tolist(), strict=True):
            out[i] = (model.languages[b], s)
    return out


def held_out(column: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteGRU:
    """A network fitted on a bounded sample of the labelled, not held out rows."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    model = ByteGRU(languages)
    if not languages:
        return model
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(per_language / counts[lang]))))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    # the limit only guards against many rows of one id
    rows = materialise(usable.where(chosen).select("doc_id", "lang", "text").limit(2 * per_language * len(languages)), "sample")
    found = materialise(rows.mapInArrow(_cut, "doc_id long, lang string, text long, place long, run binary"), "runs")
    release(rows)
    many = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if over := {lang: RUNS / n for lang, n in many.items() if n > RUNS}:
        kept = F.coalesce(F.create_map(*(F.lit(x) for pair in over.items() for x in pair))[F.col("lang")], F.lit(1.0))
        found = found.where(F.pmod(F.xxhash64("doc_id", "text", "place"), F.lit(1 << 30)) < kept * (1 << 30))
    pieces, labels = [], []
    for row in found.orderBy("doc_id", "lang", "text", "place").select("lang", "run").toLocalIterator():
        pieces.append(bytes(row["run"]))
        labels.append(languages.index(row["lang"]))
    if pieces:
        model.fit(pieces, np.array(labels))
    return model


def identify(docs: DataFrame, model: ByteGRU) -> DataFrame:
    """``row`` (the document as it came), lang_pred and score; map-only, and only texts go to Python."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def found() -> Iterator[pa.Array]:
            for array in texts:
                pairs = [x for some in pieces(array) for x in predict(model, some)]
                yield pa.StructArray.from_arrays([pa.array([x[0] for x in pairs], pa.string()), pa.array([x[1] for x in pairs], pa.float64())], ["lang_pred", "score"])

        yield from released(found())

    # not deterministic, as far as the optimizer may think: it would predict again in filters
    predicted = F.arrow_udf(run, "struct<lang_pred: string, score: double>").asNondeterministic()
    rows = docs.select(F.struct("*").alias("row")).withColumn("found", predicted("row.text"))
    return rows.select("row", "found.lang_pred", "found.score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents with a known language at ``least`` score or more, in their own columns."""
    found = identify(docs, train(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op9(docs: DataFrame) -> DataFrame:
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return materialise(found.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score"), "languages")
