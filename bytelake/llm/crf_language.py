"""Language identification with a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes (1 to 3 letters), the letter pairs and triples of the word with
edge marks, and whether it is in the lexicon of a language (its most frequent words in the sample).  Each feature
has a weight per language and there is a learned weight for each transition; the weights maximise the
conditional likelihood of label sequences by gradient steps with forward-backward.  The sequences are
spliced from pieces of labelled documents of different languages, so switches within a text are learned.  At
prediction forward-backward gives each word its language probabilities; words are labelled by the largest one, and
a document gets the language with the largest mean over all its words, which is the score.

The model is fitted on the driver on a bounded sample of labelled rows (about ``train_per_lang`` documents per
language, chosen by a hash of the id; at most ``max_langs`` languages).  Prediction covers all words of all texts:
a text is a sequence of chains of ``CHAIN`` words.

Defined results: a null text or one without letters is ``und`` with score 0, and so is everything if no row may be learned
from; equal rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty
from .registry import query, table

TRAIN_PER_LANG = 400
MAX_LANGS = 200
LEXICON = 300
CHAIN = 64
SEQUENCES = 3000
LEAST_SCORE = 0.4  # a ``least`` for keep_identified that asks for one clear language; not used by default
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def to_word(token: str) -> str:
    """A token in lower case without what isn't a letter at its ends ('' if it has no letter)."""
    w = token.lower()
    if w.isalpha():
        return w
    w = w.strip(".,;:!?")
    if w.isalpha():
        return w
    w = _NOT_LETTERS.sub("", w)
    return w if any(map(str.isalpha, w)) else ""  # numbers such as one half or the Roman eight aren't letters


def features(word: str) -> list[str]:
    marked = f"^{word}$"
    out = ["bias"]
    out += [f"p{word[:n]}" for n in (1, 2, 3) if len(word) >= n]
    out += [f"s{word[-n:]}" for n in (1, 2, 3) if len(word) >= n]
    out += [marked[i : i + 2] for i in range(len(marked) - 1)]
    out += [marked[i : i + 3] for i in range(len(marked) - 2)]
    return out


class Crf:
    """``weights`` (features x languages), ``moves`` (languages x languages), ``lexicons``: word -> languages."""

    def __init__(self, langs: list[str], rows: dict[str, int], lexicon: dict[str, list[int]]):
        self.langs, self.rows, self.lexicon = langs, rows, lexicon
        self.weights = np.zeros((len(rows), len(langs)))
        self.moves = np.eye(len(langs)) * 2.0

    def feature_rows(self, word: str) -> list[int]:
        found = [self.rows[f] for f in features(word) if f in self.rows]
        return found + [self.rows[f"lex{k}"] for k in self.lexicon.get(word, ())]

    def emission(self, word: str) -> np.ndarray:
        return self.weights[self.feature_rows(word)].sum(axis=0)


def forward_backward(scores: np.ndarray, valid: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Label probabilities ``(chains, positions, langs)`` of chains given by word scores and a mask of real
    positions (which come first); with ``pairs``, also the expected transitions."""
    b, t, n = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    alpha = np.empty((t, b, n))
    beta = np.ones((t, b, n))
    a = emit[:, 0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for k in range(1, t):
        a = alpha[k - 1] @ step * emit[:, k]
        alpha[k] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((n, n))
    for k in range(t - 2, -1, -1):
        after = emit[:, k + 1] * beta[k + 1]
        back = after @ step.T
        back /= back.sum(axis=1, keepdims=True)
        beta[k] = np.where(valid[:, k + 1, None], back, 1.0)
        if pairs:
            joint = alpha[k][:, :, None] * step[None] * after[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint[valid[:, k + 1]].sum(axis=0)
    post = (alpha * beta).transpose(1, 0, 2)
    post = post / post.sum(axis=2, keepdims=True)
    return (post, expected) if pairs else post


def fit(sample: list[tuple[str, str]], sequences: int = SEQUENCES, steps: int = 50, seed: int = 7) -> Crf | None:
    """CRF from ``(text, language)`` rows."""
    docs = [([w for w in map(to_word, t.split()) if w], lang) for t, lang in sample]
    docs = [(ws, lang) for ws, lang in docs if ws]
    if not docs:
        return None
    langs = sorted({lang for _, lang in docs})
    number = {lang: k for k, lang in enumerate(langs)}
    by_lang = defaultdict(list)
    counts = defaultdict(Counter)
    for ws, lang in docs:
        by_lang[lang].append(ws)
        counts[lang].update(ws)
    lexicon = defaultdict(list)
    for lang in langs:
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w].append(number[lang])
    # spliced sequences: pieces of 4 to 24 words, the next piece in another language half of the time
    rng = np.random.default_rng(seed)
    words: dict[str, int] = {}
    ids = np.zeros((sequences, CHAIN), np.int64)
    labels = np.zeros((sequences, CHAIN), np.int64)
    for s in range(sequences):
        k, lang = 0, langs[rng.integers(len(langs))]
        while k < CHAIN:
            ws = by_lang[lang][rng.integers(len(by_lang[lang]))]
            size = min(int(rng.integers(4, 25)), CHAIN - k, len(ws))
            at = int(rng.integers(len(ws) - size + 1))
            ids[s, k : k + size] = [words.setdefault(w, len(words)) for w in ws[at : at + size]]
            labels[s, k : k + size] = number[lang]
            k += size
            if rng.random() < 0.5:
                lang = langs[rng.integers(len(langs))]
    rows: dict[str, int] = {}
    for w in words:
        for f in features(w):
            rows.setdefault(f, len(rows))
    for k in range(len(langs)):
        rows[f"lex{k}"] = len(rows)
    crf = Crf(langs, rows, dict(lexicon))
    _climb(crf, list(words), ids, labels, steps)
    return crf


def _climb(crf: Crf, words: list[str], ids: np.ndarray, labels: np.ndarray, steps: int) -> None:
    """AdaGrad steps on the mean conditional log-likelihood with a small ridge penalty."""
    own = [crf.feature_rows(w) for w in words]
    size = np.array([len(x) for x in own])
    flat = np.concatenate([np.array(x, np.int64) for x in own])
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    n, total = len(crf.langs), ids.size
    valid = np.ones(ids.shape, bool)
    seen = np.zeros((len(words), n))
    np.add.at(seen, (ids.ravel(), labels.ravel()), 1.0)
    moved = np.zeros((n, n))
    np.add.at(moved, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1.0)
    square_w, square_m = np.full(crf.weights.shape, 1e-12), np.full((n, n), 1e-12)
    for _ in range(steps):
        emit = np.add.reduceat(crf.weights[flat], starts, axis=0)
        post, pairs = forward_backward(emit[ids], valid, crf.moves, pairs=True)
        gap = seen - np.stack([np.bincount(ids.ravel(), post[:, :, k].ravel(), len(words)) for k in range(n)], axis=1)
        grad = np.stack([np.bincount(flat, gap[owner, k], len(crf.weights)) for k in range(n)], axis=1) / total - 1e-6 * crf.weights
        step = (moved - pairs) / total - 1e-6 * crf.moves
        square_w += grad**2
        square_m += step**2
        crf.weights += 0.3 * grad / np.sqrt(square_w)
        crf.moves += 0.3 * step / np.sqrt(square_m)


class Labeler:
    """Applies a fitted CRF; keeps the scores of the tokens it has met in a table of bounded size."""

    ROWS = 150_000

    def __init__(self, crf: Crf):
        self.crf = crf
        self.at: dict[str, int] = {}
        self.scores = np.zeros((1024, len(crf.langs)))
        self.used = 0

    def _token_row(self, token: str) -> int:
        """Row of the token's word scores, -1 for a token without letters."""
        word = to_word(token)
        if not word:
            row = -1
        else:
            row = self.at.get(word, -2)
            if row < -1:
                row = self.used
                if row == len(self.scores):
                    self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
                self.scores[row] = self.crf.emission(word)
                self.used += 1
                self.at[word] = row
        self.at[token] = row
        return row


    def word_posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(posteriors of all words, number of words of each text)``."""
        if self.used > self.ROWS or len(self.at) > 3 * self.ROWS:
            self.at, self.used = {}, 0
        get = self.at.get
        numbers = []
        for t in texts:
            tokens = t.split()
            rows = [r if (r := get(x)) is not None else self._token_row(x) for x in tokens]
            ids = np.array(rows, np.int64)
            numbers.append(ids[ids >= 0])
        sizes = np.array([len(x) for x in numbers], np.int64)
        chains = -(-sizes // CHAIN)
        n = int(chains.sum())
        post = np.zeros((int(sizes.sum()), len(self.crf.langs)))
        if not n:
            return post, sizes
        ids = np.zeros(n * CHAIN, np.int64)
        valid = np.zeros(n * CHAIN, bool)
        first = (np.cumsum(chains) - chains) * CHAIN
        for x, f in zip(numbers, first, strict=True):
            ids[f : f + len(x)] = x
            valid[f : f + len(x)] = True
        ids, valid = ids.reshape(n, CHAIN), valid.reshape(n, CHAIN)
        parts = []
        for at in range(0, n, 2048):
            some = slice(at, at + 2048)
            parts.append(forward_backward(self.scores[ids[some]], valid[some], self.crf.moves)[valid[some]])
        return np.concatenate(parts), sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        langs, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), 128):
            post, sizes = self.word_posteriors(texts[at : at + 128])
            ends = np.cumsum(sizes)
            total = np.concatenate((np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)))
            mean = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)[:, None]
            best = mean.argmax(axis=1)
            langs += [self.crf.langs[b] if s else UNDETERMINED for b, s in zip(best, sizes, strict=True)]
            scores[at : at + len(sizes)] = np.where(sizes > 0, np.clip(mean.max(axis=1), 0, 1), 0)
        return langs, scores

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """The words of a text, each with its language."""
        post, _ = self.word_posteriors([text])
        words = [w for w in map(to_word, text.split()) if w]
        return [(w, self.crf.langs[k]) for w, k in zip(words, post.argmax(axis=1), strict=True)]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_per_lang: int = TRAIN_PER_LANG, max_langs: int = MAX_LANGS
) -> Crf | None:
    """CRF fitted on about ``train_per_lang`` labelled documents of each language that aren't held out."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_l"), held_out(id_col).alias("_h"))
    rows = rows.filter("_l IS NOT NULL AND NOT _h")
    sizes = rows.groupBy("_l").count().limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["_l"]), F.lit(min(1.0, train_per_lang / r["count"])))])
    draw = (F.xxhash64(F.lit("crf-sample"), F.col("_id").cast("string")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).alias("_u")
    drawn = rows.filter("_t IS NOT NULL").select("*", draw).filter(F.col("_u") < F.element_at(share, F.col("_l")))
    top = drawn.orderBy("_u", "_id").limit(2 * train_per_lang * len(sizes)).select("_t", "_l").collect()
    return fit([(r["_t"], r["_l"]) for r in sorted(top)])


def _predictor(docs: DataFrame, id_col: str, text: str, lang: str, train_per_lang: int):
    crf = fit_on(docs, id_col, text, lang, train_per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    own: dict = {}

    def predict(texts: list[str]) -> tuple[list[str], np.ndarray]:
        if shared.value is None:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if "labeler" not in own:
            own["labeler"] = Labeler(shared.value)
        return own["labeler"].predict(texts)

    return predict


def identify_language(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_per_lang: int = TRAIN_PER_LANG
) -> DataFrame:
    """One row per document: ``(id, lang_pred, score, held_out)``."""
    predict = _predictor(docs, id_col, text, lang, train_per_lang)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t"))
    found = map_rows(rows, lambda c: (c["_id"], *predict(c["_t"])), f"_id {kind}, lang_pred string, score double")
    return found.select(F.col("_id").alias(id_col), "lang_pred", "score", held_out("_id").alias("held_out"))


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", least: float | None = None, train_per_lang: int = TRAIN_PER_LANG
) -> DataFrame:
    """The rows of ``docs`` whose text has letters, with their own columns; a null language becomes the best one, also of an evenly
    mixed text (it stays null if no row may be learned from).  With ``least`` only rows of that score at least."""
    predict = _predictor(docs, id_col, text, lang, train_per_lang)
    text_at, lang_at = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                found, scores = predict(texts)
                # without a model all is undetermined, but what has letters stays
                keep = [x != UNDETERMINED or any(map(to_word, t.split())) for x, t in zip(found, texts, strict=True)]
                if least is not None:
                    keep = [k and score >= least for k, score in zip(keep, scores, strict=True)]
                own = part.column(lang_at)
                filled = [x if x is not None or y == UNDETERMINED else y for x, y in zip(own.to_pylist(), found, strict=True)]
                columns = [*part.columns]
                columns[lang_at] = pa.array(filled, own.type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op3_crf_language")
def op3(spark, sf_dir):
    found = identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
