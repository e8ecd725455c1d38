"""Language identification as a mixture of languages, fitted to each document by expectation-maximisation.

Training counts hashed byte trigrams (words with their borders) of each language over a bounded sample of labelled
rows. A document's words each get a log-likelihood under every language, the sum over their trigrams. EM over the
words then estimates the languages' proportions; nested sets (the strongest language, the two strongest, ...) are
refitted and the set with the best likelihood less a penalty for each further language is taken. The prediction is
its largest language, the score that language's proportion, lowered where too little text supports it.

Defined cases: null texts and texts without a letter are ``und`` with score 0; other columns are ignored; without any
labelled row everything is ``und``. The model is ``N_SLOTS`` numbers a language, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.llm.textops import Words, lean, sliced

N_SLOTS = 1 << 15
#: Labelled rows of each language that training counts at most (those with the smallest hash of their id).
SAMPLE_ROWS = 3_000
ROUNDS, MIN_SHARE, PENALTY = 8, 0.04, 1.0
#: What isn't told, and the least score that the filter keeps: its leading language holds half of the text.
UND, LEAST_SCORE = "und", 0.5
SPACE = 0x20
IS_LETTER = np.zeros(256, bool)
IS_LETTER[0x41:0x5B] = IS_LETTER[0x61:0x7B] = IS_LETTER[0x80:] = True


def _slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words (one border byte on either side), and where each word's begin."""
    size = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - words.start, size)
    inside = words.bytes
    here = inside[at].astype(np.uint32)
    first, last = np.zeros(len(at), bool), np.zeros(len(at), bool)
    first[begin[:-1]] = True
    last[begin[1:] - 1] = True
    prev = np.where(first, SPACE, inside[np.maximum(at - 1, 0)]).astype(np.uint32)
    follow = np.where(last, SPACE, inside[np.minimum(at + 1, len(inside) - 1)]).astype(np.uint32)
    h = ((prev << np.uint32(16)) | (here << np.uint32(8)) | follow) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - 15)).astype(np.int32), begin


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return text.upper() != text.lower() or any(map(str.isalpha, text.decode("utf-8", "replace")))


def held_out(part: int, of: int = 4, col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string")) % of == part


def _count(langs: list[str]):
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), N_SLOTS), np.int64)
        for batch in batches:
            of = batch.column(1).to_pylist()
            for a, b, texts in sliced(batch.column(0)):
                words = Words(texts, IS_LETTER)
                if not words.n:
                    continue
                slots, begin = _slots(words)
                lang = np.array([index[x] for x in of[a:b]])[words.text]
                flat = np.repeat(lang, np.diff(begin)).astype(np.int64) * N_SLOTS + slots
                sums += np.bincount(flat, minlength=sums.size).reshape(sums.shape)
        i, slot = np.nonzero(sums)
        for at in range(0, len(i), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(i[s].astype(np.int32)), pa.array(slot[s].astype(np.int32)), pa.array(sums[i[s], slot[s]])], names=["lang", "slot", "n"])

    return lean(run)


class Model:
    """``logp``: slots x languages."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)


def train(docs: DataFrame, holdout: int | None = 2, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trigram tables of the languages among the rows that aren't held out (crc32(doc_id) mod 4 = ``holdout``)."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    if holdout is not None:
        known = known.where(~held_out(holdout))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, N_SLOTS)))
    # a threshold on a uniform hash of the id takes about sample_rows of each language, without a sort
    limits = F.create_map(*(F.lit(x) for lang in langs for x in (lang, (1 << 62) * min(sample_rows, sizes[lang]) // sizes[lang])))
    taken = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 62)) < limits[F.col("lang")])
    counts = np.zeros((len(langs), N_SLOTS))
    rows = taken.select("text", "lang").mapInArrow(_count(langs), "lang int, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():
        counts[r[0], r[1]] = r[2]
    return Model(langs, counts)


def _fit(like: np.ndarray, text: np.ndarray, n_texts: int, size: np.ndarray, share: np.ndarray) -> np.ndarray:
    """EM for all texts of a chunk at once: ``like`` words x languages, ``share`` texts x languages to start from."""
    for _ in range(ROUNDS):
        part = share[text] * like
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        share = np.stack([np.bincount(text, part[:, j], n_texts) for j in range(like.shape[1])], axis=1) / size[:, None]
    return share


def predict_chunk(model: Model, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, list[list[tuple[str, float]]]]:
    """Language, score and the chosen mixture (language, proportion) of each text."""
    n, langs = len(texts), len(model.langs)
    names, scores, mixtures = [UND] * n, np.zeros(n), [[] for _ in range(n)]
    words = Words(texts, IS_LETTER)
    ok = np.array([has_letter(t) for t in texts], bool)
    if not langs or not words.n or not ok.any():
        return names, scores, mixtures
    slots, begin = _slots(words)
    word_log = np.stack([np.add.reduceat(model.logp[:, j][slots], begin[:-1]) for j in range(langs)], axis=1)
    top = word_log.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(word_log - top, -30.0))  # the common factor changes no proportion and no comparison
    size = np.maximum(words.counts(), 1).astype(float)
    share = _fit(like, words.text, n, size, np.full((n, langs), 1.0 / langs))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.full(n, -np.inf)
    chosen = np.zeros((n, langs))
    for k in range(1, langs + 1):
        wanted = ok if k == 1 else ok & (np.take_along_axis(share, order[:, k - 1 : k], 1)[:, 0] >= MIN_SHARE)
        if not wanted.any():
            break
        allowed = np.zeros((n, langs), bool)
        np.put_along_axis(allowed, order[:, :k], True, 1)
        rows = wanted[words.text]
        text = words.text[rows]
        now = np.where(allowed, share, 0.0)
        now /= np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
        if k > 1:
            now = _fit(like[rows], text, n, size, now)
        value = np.bincount(text, np.log(np.maximum((now[text] * like[rows]).sum(axis=1), 1e-30)), n) - PENALTY * (k - 1) * np.log(size + 1)
        better = wanted & (value > best)
        best[better] = value[better]
        chosen[better] = now[better]
    # certainty of the leading language against the next, from all trigrams together
    total = np.stack([np.bincount(words.text, word_log[:, j], n) for j in range(langs)], axis=1)
    for i in np.flatnonzero(ok):
        j = int(np.argmax(chosen[i]))
        odds = np.exp(np.clip(total[i] - total[i, j], -50, 50))
        alone = (chosen[i] > 0) | (np.arange(langs) == j)
        doubt = float(odds[~alone].sum())
        names[i] = model.langs[j]
        scores[i] = min(1.0, max(0.0, float(chosen[i, j]) / (1.0 + doubt)))
        mixtures[i] = [(model.langs[m], float(chosen[i, m])) for m in np.argsort(-chosen[i], kind="stable") if chosen[i, m] > 0]
    return names, scores, mixtures


def _predict(model: Model):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.num_columns - 1
            for a, b, texts in sliced(batch.column(kept)):
                names, scores, mixtures = predict_chunk(model, texts)
                mixed = pa.array([[{"lang": x, "share": y} for x, y in m] for m in mixtures], kind)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in range(kept)), pa.array(names), pa.array(scores), mixed],
                    names=[*batch.schema.names[:kept], "lang_pred", "score", "mixture"],
                )

    return run


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, mixture (languages of the chosen set with their proportions)."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def with_language(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` whose language can be told: rows predicted ``und``, and those of which no language of the mixture holds
    ``least``, go. A null ``lang`` takes the prediction; other columns, and a given ``lang``, stay as they were. The
    verdict is a column of its own while it lasts; no join."""
    columns = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text_at, lang_at = columns.index("text"), columns.index("lang") if "lang" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in sliced(batch.column(text_at)):
                names, scores, _ = predict_chunk(model, texts)
                part = batch.slice(a, b - a)
                if lang_at is not None:
                    given = part.column(lang_at)
                    filled = pc.coalesce(given, pa.array(names, given.type))
                    part = part.set_column(lang_at, part.schema.field(lang_at), filled)
                yield part.filter(pa.array([x != UND and s >= least for x, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(lean(run), kinds)
