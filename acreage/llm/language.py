"""Operator 2: language identification by averaged hashed subword embeddings.

A text is lower-cased, characters that are no letters become blanks, and its character
n-grams (2 to 4, a blank only at either end) are hashed to buckets.  The mean of the
buckets' embeddings goes through a linear softmax; both are trained by stochastic
gradient descent in numpy.  As the model is linear, embedding and output weights are
multiplied once after training, so a prediction averages one row of scores for each
n-gram of the whole text.

Training uses a bounded sample: about ``max_rows`` labelled rows, equally many of each
language, chosen by a hash of the key, and of each its ``max_features`` most frequent
n-grams.  Executors compute the n-gram counts; only these reach the driver.  A fifth of
the sample is kept for calibration: a temperature is fitted to it, and the rejection
threshold is the smaller of one half and the score that ``reject_share`` of its rightly
predicted rows do not reach.

Defined results: null texts and texts without a letter are `und` with score 0 and
rejected; rows with null language are predicted, not learned from; without any labelled
row everything is `und`; repeated rows are predicted row by row; a null key is kept, not
learned from; an empty table gives no rows; other columns pass through ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import small_batches, unused

LOG2_BUCKETS = 16
SIZES = (2, 3, 4)
GROUP = 1 << 19            # characters that are hashed at once
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray       # buckets x languages: embeddings times output weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which characters of the basic plane are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16))
    return _LETTERS[0]


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint32)
    ok = letters()[np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    return np.where(ok, c, np.uint32(32))


def grams(c: np.ndarray):
    """For each n: (place of the n-gram, bucket).  ``c``: codes with a blank at either end."""
    blank = c == 32
    h = np.zeros(len(c), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = (h[:m] ^ c[n - 1:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in SIZES:
            bad = blank[:m] & blank[n - 1:]
            for i in range(1, n - 1):
                bad = bad | blank[i:i + m]
            at = np.flatnonzero(~bad)
            yield at, (h[at] * np.uint32(0x85EBCA77) + np.uint32(n)) >> np.uint32(32 - LOG2_BUCKETS)


def parts_of(text: str):
    """Pieces of a long text that share no n-gram: cut after blanks, so no n-gram is lost or split
    (one between two blanks-to-blank pieces has its blank in both)."""
    at = 0
    while len(text) - at > GROUP:
        end = text.rfind(" ", at, at + GROUP)
        if end <= at:
            end = text.find(" ", at + GROUP)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their counts."""
    total = np.zeros(1 << LOG2_BUCKETS, dtype=np.int64)
    for part in parts_of(text):
        for _, b in grams(codes(f" {part} ")):
            total += np.bincount(b, minlength=1 << LOG2_BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def sample(docs: DataFrame, max_rows: int, max_features: int, text: str, lang: str, key: str) -> list[tuple]:
    """(lang, buckets, counts) of the sampled labelled rows."""
    rows = small_batches(docs).where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key), F.lit("sample")).alias("h"))
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # one row for each language
    if not per:
        return []
    share = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, max_rows / len(per) / n)))])
    rows = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= share[F.col("lang")])

    def count(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                b, n = features(t)
                if len(b) > max_features:
                    top = np.sort(np.argpartition(-n, max_features)[:max_features])
                    b, n = b[top], n[top]
                out.append((b.astype("<i4").tobytes(), n.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())],
                                             names=["lang", "h", "b", "n"])

    got = rows.select("lang", "text", "h").mapInArrow(count, "lang string, h bigint, b binary, n binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["lang"], r["b"]))
    return [(r["lang"], np.frombuffer(r["b"], "<i4"), np.frombuffer(r["n"], "<f4")) for r in got if r["b"]]


def fit(rows: list[tuple], dim: int = 16, epochs: int = 6, rate: float = 0.5, reject_share: float = 0.002, seed: int = 7) -> Model:
    langs = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((1 << LOG2_BUCKETS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    place = {x: i for i, x in enumerate(langs)}
    held = [r for i, r in enumerate(rows) if i % 5 == 0] if len(rows) >= 50 else rows
    train = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << LOG2_BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            lang, b, n = train[i]
            w = n / n.sum()
            x = w @ emb[b]
            z = x @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[place[lang]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = out @ g
            out -= step * np.outer(x, g)
            bias -= step * np.float32(0.1) * g
            emb[b] -= (step * len(b) ** 0.5) * w[:, None] * back
            done += 1
    model = Model(langs, emb @ out, bias)
    z = np.array([(n / n.sum()) @ model.scores[b] + bias for _, b, n in held])
    right = np.array([place[r[0]] for r in held])
    best = None
    for t in np.exp(np.linspace(np.log(0.02), np.log(5), 60)):
        p = z / t
        p = p - p.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(p)), right]))
        if best is None or loss < best[0]:
            best = (loss, float(t))
    model.temperature = best[1]
    p = softmax(z / model.temperature)
    good = np.sort(p.max(axis=1)[p.argmax(axis=1) == right])
    model.threshold = min(0.5, float(good[int(reject_share * len(good))])) if len(good) else 0.0
    return model


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def logits(model: Model, texts: list[str]) -> np.ndarray:
    """Mean score of each text's n-grams, before the temperature."""
    total = np.zeros((len(texts), len(model.langs)))
    number = np.zeros(len(texts))

    def add(owners: list[int], parts: list[str]) -> None:
        joined = " " + " ".join(parts) + " "
        c = codes(joined)
        if len(c) == len(joined):
            starts = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        else:                                    # lower-casing changed a length: place the parts by themselves
            low = [codes(f" {p}")[0:] for p in parts]
            starts = np.cumsum([0, *(len(x) for x in low)])[:-1]
            c = np.concatenate([*low, np.array([32], dtype=np.uint32)])
        owner = np.array(owners)
        for at, b in grams(c):
            s = model.scores[b]
            who = np.searchsorted(starts, at, side="right") - 1
            edge = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, dtype=int)
            if len(edge):
                np.add.at(total, owner[who[edge]], np.add.reduceat(s, edge, axis=0, dtype=np.float64))
                np.add.at(number, owner[who[edge]], np.diff(np.append(edge, len(who))))

    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in parts_of(t):
            if size + len(part) > GROUP and parts:
                add(owners, parts)
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        add(owners, parts)
    return total / np.maximum(number, 1)[:, None] + model.bias


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "_lang") -> DataFrame:
    """Adds the struct ``out`` (pred, score, rejected), in place of an input column of that name.  Of equal scores the
    language that comes first by name is predicted."""
    docs = docs.drop(out)
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)      # 2^LOG2_BUCKETS rows of one number a language
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col(text).alias("text"))
    kind = docs.schema.simpleString()

    def score(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            use = [i for i, t in enumerate(texts) if t and m.langs and any(x.isalpha() for x in t)]
            pred, top, low = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if use:
                p = softmax(logits(m, [texts[i] for i in use]) / m.temperature)
                for i, j, s in zip(use, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    pred[i], top[i], low[i] = m.langs[j], s, s < m.threshold
            found = pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(top, pa.float64()), pa.array(low, pa.bool_())], names=["pred", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", out])

    done = rows.mapInArrow(score, f"row {kind}, `{out}` struct<pred:string,score:double,rejected:boolean>")
    return done.select(*[F.col(f"row.{c}") for c in names], out)


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_rows: int = 2000, max_features: int = 4096, text: str = "text", lang: str = "lang", key: str = "doc_id", **options) -> Model:
    """Model of the rows that are not held out."""
    return fit(sample(docs.where(~is_held_out(key)), max_rows, max_features, text, lang, key), **options)


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is not rejected."""
    out = unused(docs.columns, "_lang")
    return predict(docs, train(docs, **options), options.get("text", "text"), out).where(~F.col(f"{out}.rejected")).drop(out)
