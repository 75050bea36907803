"""Document quality from pooled random-indexing vectors and a small network.

A word is a hashed bucket.  Its vector is a fixed sparse random index plus what a bounded sample of
labelled texts shows around it: the sum of its neighbours' indices.  A piece between white space
counts as its bare word, the shape of its letters, and the punctuation at either end; a piece that
follows itself also counts as a repetition.  A document is the mean over all of these.  Two layers in numpy turn that into a logit, and a temperature
fitted on labelled rows that the layers did not see calibrates it.  Only the text is an input.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import pieces
from paperloom.llm.common import free_name

#: Buckets, length of a vector, its non-zero entries, and words around one that count.
BUCKETS, DIMENSIONS, NONZERO, WINDOW = 1 << 14, 64, 6, 2
#: The labelled sample: so many rows of at most so many code points, those with the lowest hashes of their ids.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 32_768
#: Pieces whose buckets a worker remembers, packed; a full memory is emptied.
CACHE_PIECES = 200_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 3e-3, 1e-4
_ENDS = re.compile(r"([^\w\s]*)(.*?)([^\w\s]*)", re.S)


def _shape(word: str) -> str:
    if not word:
        return ""
    if word.isdigit():
        return "9"
    if not word.isalnum():
        return "mixed"
    return "X" if word.isupper() and len(word) > 1 else "Xx" if word[0].isupper() else "x" if word.islower() else "xX"


def _bucket(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}{text}".encode("utf-8", "surrogatepass")) % BUCKETS


def piece_buckets(piece: str) -> tuple[int, ...]:
    """The word, its shape and the punctuation around it."""
    before, word, after = _ENDS.fullmatch(piece).groups()
    found = [_bucket("p", x) for x in (before, after) if x]
    return (*([_bucket("w", word.lower()), _bucket("s", _shape(word))] if word else []), *found)


REPEAT = _bucket("r", "")
_SEEN: dict[str, bytes] = {}
pieces.MEMORIES["quality"] = _SEEN.clear


def buckets_of(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many buckets each piece has, and all of them in a row; computed once while a worker remembers them."""
    if len(_SEEN) > CACHE_PIECES:
        _SEEN.clear()
    for p in distinct:
        if p not in _SEEN:
            _SEEN[p] = np.array(piece_buckets(p), dtype=np.uint16).tobytes()
    packed = [_SEEN[p] for p in distinct]
    n = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) >> 1
    return n, np.frombuffer(b"".join(packed), dtype=np.uint16)


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors of all buckets."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    at = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.float32), size=at.shape), axis=1)
    return out / np.sqrt(NONZERO, dtype=np.float32)


def word_vectors(texts: list[str]) -> np.ndarray:
    """Index vectors plus what stands around each bucket in these texts."""
    index = index_vectors()
    around = np.zeros_like(index)
    for text in texts:
        words = [b[0] for b in map(piece_buckets, text.split()) if b]
        ids = np.array(words, dtype=np.int64)
        for d in range(1, WINDOW + 1):
            np.add.at(around, ids[d:], index[ids[:-d]])
            np.add.at(around, ids[:-d], index[ids[d:]])
    size = np.linalg.norm(around, axis=1, keepdims=True)
    return (index + around / np.maximum(size, 1e-9)).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each text; zero where there are no words."""
    out = []
    for block in pieces.blocks(texts):
        distinct, at, offsets = pieces.cut(block)
        n, flat = buckets_of(distinct)
        own = np.zeros((len(distinct), DIMENSIONS), dtype=np.float32)
        step = 50_000  # pieces whose vectors are held at a time
        some, ends = np.flatnonzero(n), np.cumsum(n)
        for a in range(0, len(some), step):
            now = some[a : a + step]
            begin = ends[now] - n[now]
            own[now] = np.add.reduceat(vectors[flat[begin[0] : ends[now[-1]]]], begin - begin[0], axis=0)
        total = np.zeros((len(block), DIMENSIONS), dtype=np.float32)
        count = np.zeros(len(block), dtype=np.int64)
        # a word that follows itself counts once more, as the pseudo-word of repetition
        again = np.flatnonzero((at[1:] == at[:-1]) & (n[at[1:]] > 0)) + 1
        doc = np.searchsorted(offsets, again, side="right") - 1
        repeats = np.bincount(doc[again > offsets[doc]], minlength=len(block))
        total += repeats[:, None].astype(np.float32) * vectors[REPEAT]
        count += repeats
        for a in range(0, len(at), step):
            b = min(len(at), a + step)
            first = int(np.searchsorted(offsets, a, side="right")) - 1
            last = int(np.searchsorted(offsets, b, side="left"))
            begin = np.maximum(offsets[first:last], a) - a
            keep = np.maximum(offsets[first:last], a) < np.minimum(offsets[first + 1 : last + 1], b)
            docs = np.arange(first, last)[keep]
            total[docs] += np.add.reduceat(own[at[a:b]], begin[keep], axis=0)
            count[docs] += np.add.reduceat(n[at[a:b]], begin[keep])
        out.append(total / np.maximum(count, 1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, DIMENSIONS), dtype=np.float32)


class Network:
    """A tanh layer and a logit, trained with Adam, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(11)
        order = rng.permutation(len(x))
        held = order[: len(x) // 5]
        fit = order[len(x) // 5 :]
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        self.temperature = 1.0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
                h = np.tanh(x[at] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[at]) / len(at)
                back = np.outer(error, self.w[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ error, np.array([error.sum()]))):
                    g = g + DECAY * self.w[i]
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        if len(held) >= 20:
            z, t = self._logits(x[held]), y[held]
            loss = {c: np.mean(np.logaddexp(0, z / c) - t * z / c) for c in np.geomspace(0.25, 8, 60)}
            self.temperature = float(min(loss, key=loss.get))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._logits((x.astype(np.float64) - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Model:
    """Word vectors and a network; without labels of both kinds every score is 0.5."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.network = None
        self.vectors = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
        if len(set(labels)) == 2 and len(labels) >= 10:
            self.vectors = word_vectors(texts)
            self.network = Network(pool(pa.array(texts, pa.string()), self.vectors).astype(np.float64), np.array(labels, dtype=np.float64))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.score(pool(texts, self.vectors))


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most SAMPLE_ROWS labelled rows of at most SAMPLE_CHARS code points, none of them held out.

    A null text counts as empty, a null id has no label, of labels that repeat an id the largest
    counts, and rows that repeat an id are rows of the sample each.  Without labels of both kinds,
    or documents, the model scores 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE_ROWS)  # long texts may take half of them out
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "id").where(F.length("text") <= SAMPLE_CHARS)
    rows = rows.orderBy(F.xxhash64("id"), "id", "text").limit(SAMPLE_ROWS).collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return Model([r.text for r in rows], [int(r.label) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score (0 to 1, higher is better), as score_col, which docs must not have.

    A null text counts as empty, an empty text gets a score as any other; repeated rows score alike,
    and an empty table gives an empty result.
    """
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {score_col} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.only("quality")
        for batch in batches:
            found = pa.array(shared.value.score(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*(f"c{k}" for k in range(batch.num_columns)), "score"])

    names = docs.columns
    inner = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, f"{inner}, score double").toDF(*names, score_col)


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns, whatever they are called."""
    name = free_name(docs.columns, "score")
    return score(docs, model, id_col, text_col, name).where(F.col(f"`{name}`") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
