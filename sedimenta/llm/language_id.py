"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed character n-grams (1 to 3 letters, whole text). Each language's training
vectors are clustered by spherical k-means; a text takes the language of the centroid with the highest cosine, and is rejected where
that cosine is below the centroid's floor. The floor lies between the cosines that other languages' training texts reach and those that
the centroid's own texts keep when they are left out of it, `slack` of the way up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 4096
SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x DIMENSIONS), and whether each text has a letter."""
    raw = "\n".join(t.replace("\x00", " ").lower() for t in texts)
    ends = np.cumsum([len(t.replace("\x00", " ").lower()) + 1 for t in texts])
    code = np.frombuffer((raw + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends, prepend=0))
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one blank after each word
    code, row = np.where(letter, code, 32)[kept].astype(np.uint32), row[kept]
    out = np.zeros(len(texts) * DIMENSIONS, np.int64)
    for n in (1, 2, 3):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ code[k : k + len(h)]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        same = row[: len(h)] == row[n - 1 :]
        out += np.bincount((row[: len(h)] * DIMENSIONS + (h >> np.uint32(20)))[same], minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS), np.bincount(row, minlength=len(texts)) > 0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    """A few centroids per language; its size depends on the number of languages only."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        counts, lettered = term_counts(texts)
        if not len(self.centroids):
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        cosine = unit(np.log1p(counts).astype(np.float32) * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        top = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        names = [self.langs[self.owner[b]] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, top, 0.0).astype(float).tolist(), (lettered & (top >= self.floor[best])).tolist()


def groups(column: pa.Array, most_rows: int = 128, most_chars: int = 1 << 20) -> Iterator[list[str]]:
    """Whole texts in groups of a bounded size; a longer text stands alone."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if held and (len(held) >= most_rows or size + len(text) > most_chars):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def clusters(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids and each row's cluster."""
    rng = np.random.default_rng(seed)
    picks = [int(rng.integers(len(x)))]
    while len(picks) < min(k, len(x)):
        near = (x @ x[picks].T).max(1)
        picks.append(int(np.argsort(near, kind="stable")[len(x) // 10]))  # far, but no outlier
    c = unit(x[picks])
    for _ in range(rounds):
        owner = (x @ c.T).argmax(1)
        c = unit(np.stack([x[owner == j].mean(0) if (owner == j).any() else c[j] for j in range(len(c))]))
    return c, (x @ c.T).argmax(1)


def left_out(own: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Each training row's cosine with the nearest of its language's centroids, its own centroid made without it."""
    cosine = own @ c.T
    for i in range(len(c)):
        rows = np.flatnonzero(cluster == i)
        if len(rows):
            total = own[rows].sum(0)
            rest = np.sqrt(np.maximum(total @ total - 2 * own[rows] @ total + 1, 1e-12))
            cosine[rows, i] = (own[rows] @ total - 1) / rest if len(rows) > 1 else -1
    return cosine.max(1)


def floors(own: np.ndarray, others: np.ndarray, c: np.ndarray, cluster: np.ndarray, slack: float, enough: int = 20) -> np.ndarray:
    """The least cosine accepted at each centroid: `slack` of the way from what 99% of the other languages' rows stay below to what 99% of its own
    rows reach when left out. Centroids of fewer rows than `enough` take their language's; with no other language half of that stands for the others."""
    reached = left_out(own, c, cluster)
    out = np.zeros(len(c), np.float32)
    for i in range(len(c)):
        mine = reached[cluster == i] if (cluster == i).sum() >= enough else reached
        low = max(0.0, float(np.quantile(mine, 0.01)))
        high = float(np.quantile(others @ c[i], 0.99)) if len(others) else low / 2
        out[i] = min(low, high + slack * (low - high))
    return out


def fit_languages(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 500, k: int = 4, slack: float = 0.35, rounds: int = 12, seed: int = 6) -> LanguageModel:
    """Fits on about `per_lang` rows of each language at most (those whose seeded key hash is low); rows without text or language are left out."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    sizes = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0, np.float32))
    share = F.create_map(*(F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, per_lang / n))))
    drawn = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_003)) <= share[F.col(lang)] * 1_000_003)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row.astype(np.float16).tobytes() for texts in groups(batch.column(1)) for row in np.log1p(term_counts(texts)[0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "tf"])

    got = sorted((r["lang"], bytes(r["tf"])) for r in drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(vectors, "lang string, tf binary").toLocalIterator())
    langs = sorted({name for name, _ in got})
    tf = np.stack([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32) if got else np.zeros((0, DIMENSIONS), np.float32)
    of = np.array([langs.index(name) for name, _ in got], int)
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x, kept, owner, floor = unit(tf * idf), [], [], []
    for j in range(len(langs)):
        own = x[of == j]
        c, cluster = clusters(own, k, rounds, seed)
        least = floors(own, x[of != j], c, cluster, slack)
        for i in range(len(c)):
            if (cluster == i).any():
                kept.append(c[i])
                owner.append(j)
                floor.append(least[i])
    return LanguageModel(langs, idf, np.array(kept, np.float32).reshape(-1, DIMENSIONS), np.array(owner, int), np.array(floor, np.float32))


def identify_languages(docs: DataFrame, model: LanguageModel | Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (cosine, 0 to 1), accepted (letters, and near enough to its centroid).

    Null texts, empty texts and texts without a letter are `und` with score 0 and not accepted. Very long texts count whole. A tie
    goes to the language that sorts first. Repeated rows each give a row; a null key stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model) if isinstance(model, LanguageModel) else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, accepted = [], [], []
            for texts in groups(batch.column(1)):
                for held, new in zip((names, scores, accepted), shared.value.predict(texts), strict=True):
                    held += new
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def held_out(key: Column) -> Column:
    """Rows kept from training: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
