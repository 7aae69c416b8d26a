"""Language identification by interpolated Kneser-Ney character models.

A text is its words, lower-cased and framed by blanks; a model predicts each character from up to ORDER - 1 before it
inside the frame. The n-grams of all languages share one sorted array of 64-bit hashes, with a column of interpolated
log probabilities and one of backoff weights for each language. The language with the lowest cross-entropy per character
wins. On labelled texts kept from the counting, the score is calibrated: the margin to the runner-up is mapped to the
share of right answers, and a cross-entropy limit per language marks texts that no model fits (accepted = false).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import batch, grams, texts_of

ORDER = 5
#: The models are fitted on so many texts of each language and so many characters, in expectation (whole texts, drawn by hash);
#: this bounds what they hold.
TEXTS_PER_LANGUAGE = 1500
CHARS_PER_LANGUAGE = 6_000_000
#: Of 16 parts of the training texts, by hash, those that calibrate.
CALIBRATION_PART = 3
#: Share of calibration texts of a language whose cross-entropy the rejection limit admits.
ADMITTED = 0.995
BINS = 40
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words of which a worker keeps the scores at hand.
AT_HAND = 400_000
#: Words of texts that are scored together.
TOGETHER = 20_000


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def framed(word: str) -> str:
    return f" {word} "


def window_hashes(text: str, n: int) -> np.ndarray:
    """One 64-bit hash for each window of n characters."""
    return grams(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), n)


def hashed(texts: list[str]) -> np.ndarray:
    """The hashes of n-grams, as window_hashes gives them."""
    out, sizes = np.zeros(len(texts), np.uint64), np.array([len(t) for t in texts])
    for n in range(1, ORDER + 1):
        if len(own := np.flatnonzero(sizes == n)):
            out[own] = window_hashes("".join(texts[i] for i in own), n)[::n]
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """(lang, word, n) over the sampled texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            each = frame.assign(word=frame["text"].map(words_of))[["lang", "word"]].explode("word").dropna()
            yield each.groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    return train.select("lang", "text").mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ngram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of all orders, each n-gram ending at a character to predict."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lang, gram, n = [], [], []
            for row in frame.itertuples(index=False):
                w = framed(row.word)
                for end in range(2, len(w) + 1):
                    for size in range(1, min(ORDER, end) + 1):
                        lang.append(row.lang)
                        gram.append(w[end - size : end])
                        n.append(row.n)
            yield pd.DataFrame({"lang": lang, "gram": gram, "n": n}).groupby(["lang", "gram"], as_index=False).sum()

    return words.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated Kneser-Ney models of several languages over one sorted hash array."""

    def __init__(self, languages: list[str], counts: pd.DataFrame):
        self.languages = languages
        grams = sorted(counts["gram"].unique())
        hashes = hashed(grams)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        grams = [grams[i] for i in order]
        row = dict(zip(grams, range(len(grams)), strict=True))
        size = np.array([len(g) for g in grams])
        parent = np.array([row.get(g[1:], -1) if len(g) > 1 else -1 for g in grams])  # without its first character
        context = np.array([row.get(g[:-1], -1) if len(g) > 1 else -1 for g in grams])
        k = len(languages)
        self.log_p = np.zeros((len(grams), k), np.float32)
        self.log_backoff = np.zeros((len(grams), k), np.float32)
        alphabet = max(2, int((size == 1).sum()) + 1)
        self.floor = np.full(k, -np.log(alphabet * 50.0), np.float32)
        for j, lang in enumerate(languages):
            own = counts[counts["lang"] == lang]
            raw = np.zeros(len(grams))
            raw[[row[g] for g in own["gram"]]] = own["n"].to_numpy(float)
            # Lower orders count the distinct characters before the n-gram, except where it starts the frame.
            before = np.bincount(parent[(raw > 0) & (parent >= 0)], minlength=len(grams)).astype(float)
            starts = np.array([g.startswith(" ") for g in grams])
            count = np.where((size == ORDER) | (starts & (size > 1)), raw, np.where(raw > 0, np.maximum(before, 1), 0))
            p = np.zeros(len(grams))
            weight = np.ones(len(grams))
            for n in range(1, ORDER + 1):
                at = np.flatnonzero((size == n) & (count > 0))
                if not len(at):
                    continue
                once, twice = (count[at] == 1).sum(), (count[at] == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                if n == 1:
                    total, kinds = count[at].sum(), len(at)
                    p[at] = (count[at] - discount) / total + discount * kinds / total / alphabet
                    self.floor[j] = np.log(discount * kinds / total / alphabet + 1e-12)
                    continue
                ctx = context[at]
                known = ctx >= 0
                at, ctx = at[known], ctx[known]
                total = np.bincount(ctx, count[at], len(grams))
                kinds = np.bincount(ctx, minlength=len(grams))
                has = total > 0
                weight[has] = np.maximum(discount * kinds[has] / total[has], 1e-6)
                low = np.where(parent[at] >= 0, p[parent[at]], 0)
                low = np.where(low > 0, low, np.exp(self.floor[j]))
                p[at] = (count[at] - discount) / total[ctx] + weight[ctx] * low
            self.log_p[:, j] = np.log(p, out=np.zeros(len(grams)), where=p > 0)
            self.log_backoff[:, j] = np.where(weight < 1, np.log(weight), 0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the table, -1 where there is none."""
        own, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, at, -1)[back]

    def score(self, words: list[str]) -> np.ndarray:
        """Summed log probability of each word's characters and closing blank: a row for each word, a column for each language."""
        text = "".join(map(framed, words))
        sizes = np.array([len(w) + 2 for w in words])
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(text)) - np.repeat(starts, sizes)
        total = np.broadcast_to(self.floor, (len(text), len(self.languages))).copy()
        context = None
        for n in range(1, ORDER + 1):
            # from short to long: a found n-gram replaces the estimate, a known context without it discounts it
            row = np.full(len(text), -1)
            ends = np.flatnonzero(place >= n - 1)
            row[ends] = self.find(window_hashes(text, n)[ends - (n - 1)])
            found = (row >= 0)[:, None] & (self.log_p[row] < 0)
            if context is not None:
                before = np.concatenate(([-1], context[:-1]))
                before[place < n - 1] = -1
                total += np.where((before >= 0)[:, None], self.log_backoff[before], 0)
            total = np.where(found, self.log_p[row], total)
            context = row
        total[place == 0] = 0
        return np.add.reduceat(total.astype(np.float64), starts, axis=0)


class Scorer:
    """Cross-entropies of whole texts, with the scores of the words seen last at hand."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((AT_HAND, len(model.languages)), np.float64)
        self.sizes = np.zeros(AT_HAND, np.int64)

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if not new:
            return
        if len(self.rows) + len(new) > len(self.sizes):
            self.rows = {}
            new = list(dict.fromkeys(words))
            if len(new) > len(self.sizes):
                self.table, self.sizes = np.zeros((len(new), self.table.shape[1])), np.zeros(len(new), np.int64)
        first = len(self.rows)
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.table[first + i : first + i + len(part)] = self.model.score(part)
            self.sizes[first + i : first + i + len(part)] = [len(w) + 1 for w in part]
        self.rows.update(zip(new, range(first, first + len(new)), strict=True))

    def entropies(self, texts: list[list[str]]) -> np.ndarray:
        """Nats per character of each text (its words, not empty), a column for each language."""
        self.learn([w for words in texts for w in words])
        out = np.empty((len(texts), self.table.shape[1]))
        for i, words in enumerate(texts):
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            out[i] = -self.table[at].sum(axis=0) / self.sizes[at].sum()
        return out


class Identifier:
    """A fitted model with its calibration."""

    def __init__(self, model: Model, labelled: list[tuple[str, str]]):
        self.model = model
        scorer, entropies, right = Scorer(model), [], []
        for text, lang in labelled:
            if words := words_of(text):
                entropies.append(scorer.entropies([words])[0])
                right.append(model.languages.index(lang))
        e, right = np.array(entropies).reshape(-1, len(model.languages)), np.array(right, int)
        self.limits = np.full(len(model.languages), np.inf)
        for j in range(len(model.languages)):
            own = e[right == j, j]
            if len(own):  # few texts say little about the tail
                self.limits[j] = np.quantile(own, ADMITTED) + 0.25 if len(own) >= 20 else own.max() + 0.5
        margin, best = self.margin(e), e.argmin(axis=1) if len(e) else np.empty(0, int)
        self.edges = np.quantile(margin, np.linspace(0, 1, BINS + 1)[1:-1]) if len(margin) else np.empty(0)
        bin_ = np.searchsorted(self.edges, margin)
        hits = np.bincount(bin_[best == right], minlength=BINS)
        seen = np.bincount(bin_, minlength=BINS)
        share = (hits + 1) / (seen + 2 - (seen > 0)) if len(margin) else np.full(BINS, 1 / len(model.languages))
        self.scores = np.minimum(np.maximum.accumulate(share), 1.0)

    @staticmethod
    def margin(e: np.ndarray) -> np.ndarray:
        if e.shape[1] < 2:
            return np.ones(len(e))
        two = np.partition(e, 1, axis=1)[:, :2]
        return two[:, 1] - two[:, 0]

    def judge(self, e: np.ndarray) -> tuple[int, float, float, bool]:
        j = int(e.argmin())
        score = float(self.scores[np.searchsorted(self.edges, self.margin(e[None])[0])])
        return j, score, float(e[j]), bool(e[j] <= self.limits[j])


def fit(labelled: DataFrame) -> Identifier | None:
    """From labelled (doc_id, text, lang); None if there is no labelled text. What reaches the driver is bounded by the two parameters above."""
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r[0]: (r[1], r[2] or 0) for r in labelled.groupBy("lang").agg(F.count("*"), F.sum(F.length("text"))).collect()}  # a row for each language
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    rate = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, TEXTS_PER_LANGUAGE / n, CHARS_PER_LANGUAGE / max(1, chars)))) for lang, (n, chars) in sizes.items()))
    sample = labelled.where(draw < rate).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(16)))
    count_part = sample.where(F.col("part") != CALIBRATION_PART)
    counts = ngram_counts(word_counts(count_part)).toPandas()
    if counts.empty:
        return None
    languages = sorted(counts["lang"].unique())
    held = sample.where(F.col("part") == CALIBRATION_PART).where(F.col("lang").isin(languages)).select("text", "lang").collect()
    return Identifier(Model(languages, counts), [(r[0], r[1]) for r in held])


def predict(docs: DataFrame, identifier: Identifier | None) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, accepted) of every row of docs (doc_id, text).

    und with score 0 if text is null or has no letter, or if there is no model. Repeated rows are judged each. Very long
    texts are judged whole; of languages with equal cross-entropy the first by name is taken. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("accepted", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(identifier)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = Scorer(known.model) if known else None
        for b in batches:
            out, waiting, size = [("und", 0.0, None, False)] * b.num_rows, {}, 0
            for i, text in enumerate(texts_of(b.column(1))):
                words = words_of(text.decode()) if known else []
                if any(c.isalpha() for w in words for c in w):  # superscripts, fractions and Roman numerals are none
                    waiting[i], size = words, size + len(words)
                if waiting and (size >= TOGETHER or i == b.num_rows - 1):
                    for k, e in zip(waiting, scorer.entropies([*waiting.values()]), strict=True):
                        j, score, entropy, fits = known.judge(e)
                        out[k] = known.model.languages[j], score, entropy, fits
                    waiting, size = {}, 0
            lang, score, entropy, fits = zip(*out, strict=True) if out else ((), (), (), ())
            yield batch(schema, doc_id=b.column(0), lang_pred=lang, score=score, cross_entropy=entropy, accepted=fits)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean")


def held_out(doc_id: Column) -> Column:
    """The fold that models never see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents outside the held-out fold and predicts all: (doc_id, held_out, lang_pred, score, ...)."""
    known = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    out = predict(docs, known)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
