"""Language identification of whole texts, with spans for mixed-language text.

Learning (one pass over all labelled texts): per language, counts of hashed character
n-grams (1 to 4, word ends marked) and of the scripts its words are written in. The model is
``n_languages x 2 ** HASH_BITS`` floats, a size that does not depend on the corpus; it is the
only thing gathered on the driver and broadcast.

Prediction: the script of a word (by code-point ranges, the one most of its letters are in)
narrows its candidate languages; the word gets a score for each candidate (naive Bayes over
its n-grams) and no other language can label it; a Viterbi pass over the words of a text, with
a penalty for switching, labels spans. A text's language is the one that labels most of its
letters, and the score is that share of letters.

An n-gram's share in a language is mixed with the same small background for every language, so
what a language has not met costs the same however much text it was learned from.

Words are runs of letters, lower-cased; equal words are scored once per batch. The Viterbi
pass runs over many texts at once, ``SLICE_CHARS`` of them at a time. A longer text is cut at
white space into stretches of that size: the state is carried over them, and the path is read
back stretch by stretch, each run a second time from its stored state. Beside the text itself
(and a single word without white space, which is not cut) memory is bounded by a stretch, and by
the model: ``2 ** HASH_BITS`` floats per learned language.

Defined cases: null, empty or letterless text is ``und`` with score 0; null language rows
are not learned from; with nothing to learn from every text is ``und``; a text whose script
no learned language uses keeps all languages as candidates; ties go to the language first
in code-point order; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

HASH_BITS = 16
MAX_WORD = 24
SLICE_CHARS = 1_500_000
PENDING_WORDS = 200_000
BACKGROUND = 0.01
UNDETERMINED = "und"
LETTER_RUN = re.compile(r"[^\W\d_]+")
WHITE_SPACE = re.compile(r"\s")

# first code points of script ranges, in order (fixed values); 0 is any other script
SCRIPT_RANGES = [
    (0x0041, 1, "Latin"), (0x0250, 1, "Latin"), (0x0370, 2, "Greek"), (0x0400, 3, "Cyrillic"),
    (0x0530, 4, "Armenian"), (0x0590, 5, "Hebrew"), (0x0600, 6, "Arabic"), (0x0700, 0, "other"),
    (0x0750, 6, "Arabic"), (0x0780, 0, "other"), (0x08A0, 6, "Arabic"), (0x0900, 7, "Devanagari"),
    (0x0980, 8, "Bengali"), (0x0A00, 9, "Gurmukhi"), (0x0A80, 10, "Gujarati"), (0x0B00, 0, "other"),
    (0x0B80, 11, "Tamil"), (0x0C00, 12, "Telugu"), (0x0C80, 13, "Kannada"), (0x0D00, 14, "Malayalam"),
    (0x0D80, 0, "other"), (0x0E00, 15, "Thai"), (0x0E80, 0, "other"), (0x10A0, 16, "Georgian"),
    (0x1100, 17, "Hangul"), (0x1200, 18, "Ethiopic"), (0x1380, 0, "other"), (0x1E00, 1, "Latin"),
    (0x1F00, 2, "Greek"), (0x2000, 0, "other"), (0x3040, 19, "Kana"), (0x3100, 0, "other"),
    (0x3130, 17, "Hangul"), (0x3190, 0, "other"), (0x3400, 20, "Han"), (0xA000, 0, "other"),
    (0xAC00, 17, "Hangul"), (0xD7B0, 0, "other"), (0xF900, 20, "Han"), (0xFB00, 1, "Latin"),
    (0xFB1D, 5, "Hebrew"), (0xFB50, 6, "Arabic"), (0xFE00, 0, "other"),
]
N_SCRIPTS = 21
_STARTS = np.array([a for a, _, _ in SCRIPT_RANGES], np.uint32)
_SCRIPTS = np.array([0] + [s for _, s, _ in SCRIPT_RANGES])


def _code_matrix(words: list[str]) -> np.ndarray:
    """Code points of each word, cut into rows of ``MAX_WORD`` + 2 with 1 at both ends."""
    codes = np.array(words, dtype=f"U{MAX_WORD}").view(np.uint32).reshape(len(words), MAX_WORD)
    out = np.zeros((len(words), MAX_WORD + 2), np.uint32)
    out[:, 0] = 1
    out[:, 1:-1] = codes
    length = (codes != 0).sum(1)
    out[np.arange(len(words)), length + 1] = 1
    return out


def _pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words cut into stretches of at most ``MAX_WORD`` characters, and each one's word.
    Nothing of a word is left out: scripts without blanks have very long "words"."""
    if max(map(len, words), default=0) <= MAX_WORD:
        return words, np.arange(len(words))
    out, owner = [], []
    for i, w in enumerate(words):
        for a in range(0, len(w), MAX_WORD):
            out.append(w[a:a + MAX_WORD])
            owner.append(i)
    return out, np.array(owner)


def _grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of all n-grams of each row, and which of them exist."""
    width = codes.shape[1] - n + 1
    h = np.full((codes.shape[0], width), 1469598103 + n, np.uint64)
    for j in range(n):
        h = (h ^ codes[:, j:j + width].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)).astype(np.int64), \
        codes[:, n - 1:n - 1 + width] != 0


def word_scripts(words: list[str]) -> np.ndarray:
    """The script most letters of each word are in (the first of ``SCRIPT_RANGES``' numbers, if several)."""
    stretches, owner = _pieces(words)
    codes = np.array(stretches, dtype=f"U{MAX_WORD}").view(np.uint32).reshape(len(stretches), MAX_WORD)
    row, at = np.nonzero(codes)
    script = _SCRIPTS[np.searchsorted(_STARTS, codes[row, at], side="right")]
    held = np.bincount(owner[row] * N_SCRIPTS + script, minlength=len(words) * N_SCRIPTS)
    return held.reshape(len(words), N_SCRIPTS).argmax(1)


def _stretches(text: str):
    """``text`` in pieces of about ``SLICE_CHARS``, cut at white space only."""
    start = 0
    while len(text) - start > SLICE_CHARS:
        cut = WHITE_SPACE.search(text, start + SLICE_CHARS)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _letter_words(text: str) -> list[str]:
    return LETTER_RUN.findall(text.lower())


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def learn(labelled: DataFrame) -> dict | None:
    """Model from (text, lang): languages in code-point order, n-gram scores, scripts."""
    size = 1 << HASH_BITS

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}

        def add(lang: str, held: Counter):
            words = list(held)
            table = counts.setdefault(lang, np.zeros(size))
            seen = scripts.setdefault(lang, np.zeros(N_SCRIPTS))
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                weight = np.array([held[w] for w in part], float)
                seen += np.bincount(word_scripts(part), weight, N_SCRIPTS)
                stretches, owner = _pieces(part)
                codes = _code_matrix(stretches)
                for n in (1, 2, 3, 4):
                    grams, real = _grams(codes, n)
                    w = np.broadcast_to(weight[owner][:, None], grams.shape)
                    table += np.bincount(grams[real], w[real], size)

        pending: dict[str, Counter] = {}
        n_pending = 0  # different words of all languages' counters

        def flush():
            for lang, held in pending.items():
                if held:
                    add(lang, held)
            pending.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for stretch in _stretches(text):
                    held = pending.setdefault(lang, Counter())
                    n_pending -= len(held)
                    held.update(_letter_words(stretch))
                    n_pending += len(held)
                    if n_pending > PENDING_WORDS:
                        flush()
                        n_pending = 0
        flush()
        for lang, table in counts.items():
            both = np.concatenate([table, scripts[lang]])
            used = np.nonzero(both)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)),
                 pa.array(both[used].astype(np.int64))], names=["lang", "slot", "n"])

    known = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = map_batches(known, count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # one list per language, of at most 2 ** HASH_BITS + N_SCRIPTS counts
    packed = rows.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c")).select(
        "lang", F.col("c.slot").alias("slots"), F.col("c.n").alias("ns")).toPandas()
    if packed.empty:
        return None
    packed = packed.sort_values("lang", key=lambda s: s.map(lambda x: x.encode())).reset_index(drop=True)
    table = np.zeros((len(packed), size + N_SCRIPTS))
    for i, (slots, ns) in enumerate(zip(packed["slots"], packed["ns"])):
        table[i, np.asarray(slots, int)] = ns
    grams, scripts = table[:, :size], table[:, size:]
    shares = grams / np.maximum(1, grams.sum(1, keepdims=True))
    background = (shares.mean(0) + 1 / size) / 2
    scores = np.log((1 - BACKGROUND) * shares + BACKGROUND * background)
    share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    return {"langs": packed["lang"].tolist(), "scores": scores.T.astype(np.float32).copy(),
            "scripts": share >= 0.01}


def _candidates(model: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of languages that may label words (one row each), and every word's set."""
    allowed = model["scripts"].T
    allowed = allowed | ~allowed.any(1, keepdims=True)  # a script that no language uses narrows nothing
    sets, of_script = np.unique(allowed, axis=0, return_inverse=True)
    return sets, of_script.ravel()[word_scripts(words)]


def _gram_sums(table: np.ndarray, words: list[str]) -> np.ndarray:
    """Sums of the scores of each word's n-grams, per column of ``table``: the mean over the
    lengths 2 to 4, so that every letter counts about once."""
    stretches, owner = _pieces(words)
    codes = _code_matrix(stretches)
    total = np.zeros((len(stretches), table.shape[1]), np.float32)
    for n in (2, 3, 4):
        grams, real = _grams(codes, n)
        count = real.sum(1)
        has = count > 0
        if has.any():
            first = np.cumsum(count) - count
            total[has] += np.add.reduceat(table[grams[real]], first[has], axis=0) / 3
    if len(stretches) == len(words):
        return total
    out = np.zeros((len(words), table.shape[1]), np.float32)
    np.add.at(out, owner, total)
    return out


def score_words(model: dict, words: list[str]) -> np.ndarray:
    """Score per word and language; languages outside a word's candidates get -inf."""
    out = np.full((len(words), len(model["langs"])), -np.inf, np.float32)
    if not words:
        return out
    sets, of_word = _candidates(model, words)
    for k in np.unique(of_word):
        langs, at = np.flatnonzero(sets[k]), np.flatnonzero(of_word == k)
        if len(langs) == 1:  # nothing to tell apart
            out[at, langs] = 0
            continue
        table = model["scores"] if len(langs) == len(model["langs"]) else model["scores"][:, langs].copy()
        for a in range(0, len(at), 10_000):
            part = at[a:a + 10_000]
            out[np.ix_(part, langs)] = _gram_sums(table, [words[i] for i in part])
    return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best language per word for many texts at once (``offsets``: each text's first word)."""
    return viterbi_stretch(scores, offsets, penalty, np.zeros((len(offsets) - 1, scores.shape[1]), np.float32))[0]


def viterbi_stretch(scores: np.ndarray, offsets: np.ndarray, penalty: float, start: np.ndarray,
                    end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the words, every text's state after its last word and the label before its first.

    ``start`` holds the texts' states before their first words, ``end`` the label that the word
    after the last one came from, if there is one.
    """
    n_words, n_langs = scores.shape
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    came = np.zeros((n_words, n_langs), np.int16)
    state = start[order]
    stay = np.arange(n_langs, dtype=np.int16)
    for t, n in enumerate(active):
        rows = starts[:n] + t
        best = state[:n].argmax(1)
        # states are kept relative to the best one, so they stay small however long the text
        behind = state[:n] - state[np.arange(n), best][:, None]
        came[rows] = np.where(behind < -penalty, best[:, None], stay)
        state[:n] = np.maximum(behind, -penalty) + scores[rows]
    labels = np.zeros(n_words, np.int16)
    last = state.argmax(1) if end is None else np.full(len(lengths), end)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        labels[rows] = last[:n]
        last[:n] = came[rows, last[:n]]
    back = np.argsort(order)
    return labels, state[back], last[back]


def _scored_words(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all words of the texts, offsets, and letters per word."""
    words: list[str] = []
    offsets = [0]
    for text in texts:
        words += _letter_words(text or "")
        offsets.append(len(words))
    codes, unique = pd.factorize(np.array(words, dtype=object))
    unique = list(unique)
    letters = np.array([len(w) if _has_letter(w) else 0 for w in unique], np.int64)
    scores = score_words(model, unique)
    scores[letters == 0] = 0
    return scores[codes], np.array(offsets), letters[codes]


def _label_texts(model: dict, texts: list[str | None], penalty: float):
    """Offsets of all texts' words, labels and letters per word."""
    scores, offsets, letters = _scored_words(model, texts)
    return offsets, viterbi(scores, offsets, penalty), letters


def _label_stretches(model: dict, text: str, penalty: float):
    """Labels and letters of the words of a long text, a stretch at a time, the last one first."""
    cuts = [0]
    states = [np.zeros((1, len(model["langs"])), np.float32)]
    for stretch in _stretches(text):
        cuts.append(cuts[-1] + len(stretch))
        scores, offsets, _ = _scored_words(model, [stretch])
        states.append(viterbi_stretch(scores, offsets, penalty, states[-1])[1])
    end = None
    for i in range(len(cuts) - 2, -1, -1):
        scores, offsets, letters = _scored_words(model, [text[cuts[i]:cuts[i + 1]]])
        if len(scores):
            labels, _, before = viterbi_stretch(scores, offsets, penalty, states[i], end)
            end = int(before[0])
            yield labels, letters


def text_spans(model: dict, text: str, penalty: float = 8.0) -> list[tuple[int, int, str]]:
    """Spans (first word, past the last word, language) of one text, words as runs of letters."""
    labels = np.concatenate([x for x, _ in _label_stretches(model, text, penalty)][::-1] or [np.zeros(0, np.int16)])
    cuts = np.nonzero(np.diff(labels))[0] + 1
    edges = [0, *cuts.tolist(), len(labels)]
    return [(a, b, model["langs"][labels[a]]) for a, b in zip(edges, edges[1:]) if b > a]


def predict(docs: DataFrame, model: dict | None, penalty: float = 8.0) -> DataFrame:
    """Rows (doc_id, lang_pred, score, n_spans) for documents (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, n_spans int"
    if model is None:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0).alias("n_spans"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        n_langs = len(m["langs"])
        names = np.array([*m["langs"], UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end] or "") <= SLICE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                n = end - start
                if chars > SLICE_CHARS:  # one long text
                    share, spans, after = np.zeros((1, n_langs)), np.zeros(1, int), None
                    for labels, letters in _label_stretches(m, texts[start], penalty):
                        share += np.bincount(labels, letters, n_langs)
                        spans += (np.diff(labels) != 0).sum() + (labels[-1] != after)
                        after = labels[0]
                else:
                    offsets, labels, letters = _label_texts(m, texts[start:end], penalty)
                    doc = np.repeat(np.arange(n), np.diff(offsets))
                    share = np.bincount(doc * n_langs + labels, letters, n * n_langs).reshape(n, n_langs)
                    changes = np.zeros(len(labels), bool)
                    changes[1:] = (np.diff(labels) != 0) & (np.diff(doc) == 0)
                    spans = np.bincount(doc, changes, n) + (np.diff(offsets) > 0)
                total = share.sum(1)
                best = np.where(total > 0, share.argmax(1), n_langs)
                score = np.where(total > 0, share.max(1) / np.maximum(1, total), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(names[best], pa.string()),
                     pa.array(score.astype(float)), pa.array(spans.astype(np.int32))],
                    names=["doc_id", "lang_pred", "score", "n_spans"])
                start = end

    return map_batches(docs.select("doc_id", "text"), run, schema)
