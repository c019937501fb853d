"""Toxicity by a subsequence string-kernel machine with Nystroem landmarks.

The kernel compares words by their shared subsequences of four letters, gaps
allowed: a subsequence that spans ``s`` letters weighs ``DECAY ** s``, up to
``SPAN``. Inserted letters therefore cost weight, not the match. Punctuation inside
a word and blanks between single letters are skipped beforehand (``i.d-i o t``).

Training is multiple-instance: labels are on documents, evidence on words. Words
of toxic documents that clean ones lack start as positives, each also with letters
inserted; a machine is trained on
Nystroem features of the landmark words, then the best word of each toxic document
and the worst of each clean one become instances, twice. The decision of a window
is linear in its subsequences, so the trained machine folds into one weight per
subsequence, a table of fixed size. A document scores by its best window, mapped to
0..1 by a logistic fit on labelled documents that the machine hasn't seen.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import store

TRAINING_DOCS = 8000     # bound on labelled rows the machine is fitted on
POSITIVES, NEGATIVES, LANDMARKS = 400, 4000, 256
DECAY, LENGTH, SPAN, WINDOW = 0.8, 4, 6, 10
CHUNK = 1 << 20          # characters scored at once
OVERLAP = 64
START = 31               # class of a word's start
TABLES: list[np.ndarray] = []
STEPS = [(0, *p) for p in itertools.combinations(range(1, SPAN), LENGTH - 1)]


def letter_classes() -> np.ndarray:
    """Class of each code point below 0x3000: 0 none, 1-26 letters, 27 digits, 28-30 other letters."""
    if TABLES:
        return TABLES[0]
    table = np.zeros(0x3000, np.uint8)
    for c in range(len(table)):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if "a" <= base <= "z":
            table[c] = ord(base) - 96
        elif base.isdigit():
            table[c] = 27
        elif base.isalpha():
            table[c] = 28 + c % 3
    TABLES.append(table)
    return table


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters that count, and their places in ``text``.

    One ``START`` stands before each word.
    """
    codes = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = letter_classes()
    cls = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], (28 + codes % 3).astype(np.uint8))
    letter = cls > 0
    keep = np.ones(len(cls), bool)
    # a gap of one mark between letters, or of one blank between single letters
    mark = ~letter & (codes > 32) & (codes < 128)
    keep[1:-1] &= ~(mark[1:-1] & letter[:-2] & letter[2:])
    alone = np.zeros(len(cls), bool)
    alone[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    keep[1:-1] &= ~(~letter[1:-1] & (codes[1:-1] != 10) & alone[:-2] & alone[2:])
    place = np.flatnonzero(keep)
    cls = cls[place]
    begins = np.zeros(len(cls), bool)
    begins[:-1] = (cls[:-1] == 0) & (cls[1:] > 0)
    cls[begins] = START
    used = cls > 0
    return cls[used], place[used] - 1


def evidence(cls: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of subsequence weights in the window from each place, and where its letters end."""
    n = len(cls)
    starts = np.flatnonzero(cls == START)
    if not n or not len(starts):
        return np.zeros(n), np.arange(n)
    ends = np.append(starts[1:], n)
    end = np.repeat(ends, ends - starts)
    end = np.concatenate([np.arange(starts[0]), end])
    wide = np.concatenate([cls.astype(np.int32), np.zeros(SPAN, np.int32)])
    here, total = np.arange(n), np.zeros(n, np.float32)
    left = end - here
    for step in STEPS:
        code = wide[:n] << 15
        for shift, d in zip((10, 5, 0), step[1:]):
            code |= wide[d:d + n] << shift
        value = weights[code]
        value[left <= step[-1]] = 0
        total += value * np.float32(DECAY ** (step[-1] + 1))
    sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    stop = np.minimum(here + WINDOW, end)
    return sums[stop] - sums[:n], np.minimum(stop + SPAN - 1, end)


def features(word: str) -> dict[int, float]:
    """The word's subsequences and their weights."""
    cls, _ = encode(word)
    out: dict[int, float] = {}
    breaks = np.flatnonzero(cls == START)
    for s, e in zip(breaks, np.append(breaks[1:], len(cls))):
        for i in range(s, e):
            for step in STEPS:
                if i + step[-1] < e:
                    code = 0
                    for d in step:
                        code = code << 5 | int(cls[i + d])
                    out[code] = out.get(code, 0.0) + DECAY ** (step[-1] + 1)
    return out


def inserted(word: str) -> list[str]:
    """Spellings with one foreign letter, a fixed choice for each place."""
    return [word[:k] + chr(97 + (7 * k + len(word)) % 26) + word[k:] for k in range(1, len(word))]


def train(words: list[str], labels: list[int], rows: list[float]) -> tuple[np.ndarray, float]:
    """Squared-hinge machine on Nystroem features, folded to a weight per subsequence."""
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    maps = [features(w) for w in words]
    half = LANDMARKS // 2
    chosen = [i for i in range(len(words)) if y[i] > 0][:half] + [i for i in range(len(words)) if y[i] < 0][:half]
    codes = {u: k for k, u in enumerate(sorted({u for i in chosen for u in maps[i]}))}
    marks = np.zeros((len(chosen), len(codes) + 1), np.float32)
    for r, i in enumerate(chosen):
        for u, v in maps[i].items():
            marks[r, codes[u]] = v
    norms = np.sqrt((marks ** 2).sum(1)) + 1e-9
    marks /= norms[:, None]
    kernel = np.zeros((len(words), len(chosen)))
    for i, m in enumerate(maps):
        known = [(codes[u], v) for u, v in m.items() if u in codes]
        if known:
            k, v = map(np.array, zip(*known))
            kernel[i] = marks[:, k.astype(int)] @ v
    values, vectors = np.linalg.eigh(marks @ marks.T)
    kept = values > 1e-6 * max(values.max(), 1e-9)
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    z = np.hstack([kernel @ whiten, np.ones((len(words), 1))])
    cost = np.array(rows, float)
    for sign in (1, -1):
        side = y == sign
        cost[side] *= 1.0 / max(cost[side].sum(), 1e-9)
    cost *= np.where(y > 0, 200.0, 1000.0)
    w, ridge = np.zeros(z.shape[1]), np.ones(z.shape[1])
    ridge[-1] = 1e-6
    for _ in range(30):  # Newton steps on the active set
        active = y * (z @ w) < 1
        za = z[active] * cost[active, None]
        new = np.linalg.solve(za.T @ z[active] + np.diag(ridge) * 0.05, za.T @ y[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    beta = whiten @ w[:-1]
    table = np.zeros(1 << 20, np.float32)
    folded = beta @ marks
    for u, k in codes.items():
        table[u] = folded[k]
    return table, float(w[-1])


def best_windows(texts: list[str], weights: np.ndarray) -> Iterator[tuple[float, str]]:
    """The largest evidence in each text and the characters of that window.

    Texts are scored in chunks of bounded size; long texts overlap at the cuts.
    """
    n = len(texts)
    best, found = np.zeros(n), [""] * n
    queue: list[tuple[int, str]] = []
    held = 0

    def flush() -> None:
        joined = "\n".join(t for _, t in queue)
        starts = np.cumsum([0] + [len(t) + 1 for _, t in queue[:-1]])
        cls, place = encode(joined)
        if not len(cls):
            return
        sums, stop = evidence(cls, weights)
        owner = np.searchsorted(starts, place, "right") - 1
        owner = np.maximum(owner, 0)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        tops = np.maximum.reduceat(sums, first)
        for s, e, top in zip(first, np.append(first[1:], len(cls)), tops):
            k = queue[owner[s]][0]
            if top > best[k]:
                at = s + int(np.argmax(sums[s:e]))
                last = min(stop[at], e) - 1
                best[k], found[k] = top, joined[max(place[at], 0):place[last] + 1].strip()

    for k, text in enumerate(texts):
        for start in range(0, max(len(text), 1), CHUNK - OVERLAP):
            piece = text[start:start + CHUNK]
            queue.append((k, piece))
            held += len(piece)
            if held >= CHUNK:
                flush()
                queue, held = [], 0
            if start + CHUNK >= len(text):
                break
    if queue:
        flush()
    return zip(best, found)


def _windows(weights: np.ndarray, keep: int):
    """Arrow batches whose last column is the text: replaced by ``best, window``."""
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            best, found = zip(*best_windows(texts, weights)) if texts else ((), ())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([float(b) for b in best], pa.float64())]
            names = [*batch.schema.names[:-1], "best"]
            if keep:
                columns, names = columns + [pa.array(found, pa.string())], names + ["window"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRAINING_DOCS) -> dict:
    """Train on at most ``sample`` labelled documents, chosen by a hash of the id.

    ``labels``: ``doc_id, toxic``; null labels or ids are skipped, repeated ones
    count once by their largest label. Without both classes the model calls
    nothing toxic. Every collected table is bounded by the constants above.
    """
    picked = (labels.where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    texts = store(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
        .withColumn("part", F.expr("pmod(hash(doc_id), 4)")), "labelled")
    learn = texts.where("part > 0")
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x00-\x20]+"))).alias("word")
    counted = store(learn.select("toxic", word).where("length(word) between 3 and 40").groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "word-counts")
    seen = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
    if not seen.get(0) or not seen.get(1):
        return {"weights": np.zeros(1 << 20, np.float32), "scale": 1.0, "shift": -3.0}
    # so often in toxic documents only that chance gives less than a tenth of a word
    chance = np.log(seen[1] / (seen[0] + seen[1]))
    least = max(2, int(np.ceil(-np.log(10.0 * max(counted.count(), 1)) / chance)))
    tops = counted.where("good = 0").orderBy(F.desc("bad"), "word").limit(POSITIVES).collect()
    lows = counted.where("good > 0").orderBy(F.xxhash64("word"), "word").limit(NEGATIVES).collect()
    strong = [r for r in tops if r.bad >= least] or [r for r in tops if r.bad >= 3]
    positives = {r.word: float(min(r.bad, 20)) for r in strong}
    negatives = {r.word: 1.0 for r in lows}
    if not positives or not negatives:
        return {"weights": np.zeros(1 << 20, np.float32), "scale": 1.0, "shift": -3.0}
    bent = {v: 0.5 * min(r.bad, 20) / len(r.word) for r in strong for v in inserted(r.word) if v not in negatives}
    for turn in range(3):
        instances = [*positives, *bent, *negatives]
        weights, bias = train(instances, [1] * (len(positives) + len(bent)) + [0] * len(negatives),
                              [*positives.values(), *bent.values(), *negatives.values()])
        rows = texts.select("part", "toxic", "text").mapInArrow(
            _windows(weights, 1), "part int, toxic int, best double, window string").collect()
        if turn == 2:
            break
        clean = {r.window for r in rows if r.part > 0 and r.toxic == 0 and r.window}
        for r in sorted(rows, key=lambda r: (-r.best, r.window)):
            if r.part > 0 and r.toxic == 1 and r.best + bias > 0 and r.window not in clean:
                positives[r.window] = min(positives.get(r.window, 0.0) + 1.0, 20.0)
        negatives |= dict.fromkeys(sorted(clean - set(positives)), 3.0)
    unseen = [r for r in rows if r.part == 0] or rows
    scale, shift = _logistic(np.array([r.best + bias for r in unseen]), np.array([r.toxic for r in unseen], float))
    return {"weights": weights, "scale": scale, "shift": shift + scale * bias}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's fit: smoothed targets, Newton steps, slope kept positive."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target, z = np.where(y > 0, hi, lo), np.stack([x, np.ones_like(x)], 1)
    w = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - target) + 1e-3 * w
        w = w - np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), grad), -5, 5)
    return float(max(w[0], 0.1)), float(w[1])


def _judged(weights: np.ndarray):
    """Arrow batches of any columns, the last one the text: ``best`` is added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            best = pa.array([float(b) for b, _ in best_windows(texts, weights)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, best], names=[*batch.schema.names, "best"])
    return run


def _scored(df: DataFrame, model: dict) -> DataFrame:
    score_ = 1 / (1 + F.exp(-(F.col("best") * model["scale"] + model["shift"])))
    return df.withColumn("score", score_).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("best")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score (0..1), predicted`` of every row's whole text; a null text is empty."""
    return _scored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _windows(model["weights"], 0), f"doc_id {dict(docs.dtypes)['doc_id']}, best double"), model)


def marked(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, which replace columns of these names;
    rows, texts and all other columns are as they were."""
    rest = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    packed = docs.select(F.struct(*rest).alias("rest"), "text")
    kinds = ", ".join(f"`{c}` {t}" for c, t in packed.dtypes)
    judged = _scored(packed.mapInArrow(_judged(model["weights"]), f"{kinds}, best double"), model)
    return judged.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns
                           if c not in ("score", "predicted")), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows whose remainder is 0 are never learned from."""
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
