"""Languages of documents and of passages by error-correcting output codes.

Each of the 31 binary classifiers of the exhaustive code for six languages tells one half of the languages from
the other by character n-grams of words (log odds of smoothed frequencies, languages weighing alike). A sentence's
margins are the sums over its words; loss-weighted decoding takes the language whose codeword has the
least logistic loss, every bit weighted by its accuracy in training. If the runner-up is nearly as
near, the sentence is ambiguous and tells nothing. Training reads a bounded sample of labelled rows, twice: the second time
sentences count for the language that the first model gives them, which removes wrong labels.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")
#: Labelled rows that the classifiers are trained on; an argument of ``train``.
SAMPLE = 2_000
_BUCKETS = 1 << 14
_WORDS_KEPT = 300_000
_PIECE = 256

#: Usual forms of the labels (ISO 639-1, both ISO 639-2 codes, English and own names).
FORMS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castilian",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands flemish",
}
_KNOWN = {form: code for code, forms in FORMS.items() for form in forms.split()}
_MISSING = {"", "und", "unknown"}

#: What is not running text: code, formulas and markup; blanked out so that offsets stay.
_NOT_TEXT = re.compile(
    r"(?is)```.*?```|<(pre|code|math|script|style|syntaxhighlight|source)\b.*?</\1>|\\begin\{(verbatim|lstlisting|equation\*?|align\*?|displaymath)\}.*?\\end\{\2\}"
    r"|\$\$[^$\n]+\$\$|(?<![\\\w$])\$(?![\d\s$])(?=[^$\n]*[\\^_=])[^$\n]+(?<![\s\\])\$(?![\d$])|<!--.*?-->|</?[a-z][^<>]*>|\\[a-z]+\*?|&#?\w{1,8};|\b(?:https?|ftp)://\S+|\b\S+\.(?:png|jpe?g|gif|html?|txt)\b"
)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:]+(?=\s)|\n")


def canonical(label: str | None) -> str | None:
    """The two-letter code of a label in any usual form, None for a missing one, the label itself if it names none of the languages."""
    text = (label or "").strip().lower()
    if text in _MISSING:
        return None
    return _KNOWN.get(re.split(r"[-_ (]", text)[0], text)


def code_matrix(n: int) -> np.ndarray:
    """The exhaustive code: one row of 2^(n-1) - 1 signs for each class."""
    columns = np.arange(1, 1 << (n - 1))
    bits = (columns[None, :] >> np.arange(n - 1)[:, None]) & 1
    return np.concatenate([np.zeros((1, len(columns)), int), bits]) * 2 - 1


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    grams = {w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))}
    return [zlib.crc32(g.encode()) % _BUCKETS for g in grams]


def plain(text: str) -> str:
    """Lower-cased running text with everything at its place."""
    if "<" in text or "\\" in text or "`" in text or "&" in text or "$" in text or "://" in text or "." in text:
        text = _NOT_TEXT.sub(lambda m: " " * len(m[0]), text)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Model:
    """Trained classifiers; small, so it travels with the tasks."""

    def __init__(self, counts: np.ndarray):
        self.code = code_matrix(len(LANGUAGES))
        freq = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        up = (self.code == 1).astype(float)
        one = (up.T @ freq) / up.sum(0)[:, None]
        zero = ((1 - up).T @ freq) / (1 - up).sum(0)[:, None]
        self.weights = np.ascontiguousarray(np.log(one / zero).T.astype(np.float32))
        self.accuracy = np.ones(self.code.shape[1])

    def word(self, word: str) -> np.ndarray:
        """The margins of a word; a third of the sum, as its n-grams overlap."""
        return self.weights[_grams(word)].sum(0) / 3

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """(n, languages): the weighted logistic loss of each codeword."""
        m = np.clip(margins, -30, 30)
        plus, minus = np.log1p(np.exp(-m)) * self.accuracy, np.log1p(np.exp(m)) * self.accuracy
        up = (self.code == 1).T.astype(float)
        return (plus @ up + minus @ (1 - up)) / self.accuracy.sum()


class Reader:
    """Sentences of texts with their language; keeps the margins of the words met."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, self.model.code.shape[1]), np.float32)
        self.used = 0  # row 0 stands for the ends of sentences

    def _place(self, tokens: list[list[str]]) -> None:
        if len(self.place) > _WORDS_KEPT:
            self.reset()
        for w in set().union(*tokens) - self.place.keys():
            if not w[0].isalpha():
                self.place[w] = 0
                continue
            self.used = k = self.used + 1
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = self.model.word(w)
            self.place[w] = k

    def sentences(self, texts: list[str], least: int = 4) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each (plain) text: first token, end token, words and margins of its sentences of ``least`` words or more."""
        tokens = [_TOKEN.findall(t) for t in texts]
        self._place(tokens)
        out = []
        get = self.place.__getitem__
        for ws in tokens:
            k = np.fromiter(map(get, ws), np.int64, len(ws))
            ends = np.flatnonzero(k == 0)
            first, last = np.r_[0, ends + 1], np.r_[ends, len(k)]
            words = last - first
            keep = words >= least
            first, last, words = first[keep], last[keep], words[keep]
            if not len(first):
                out.append((first, last, words, np.zeros((0, self.table.shape[1]))))
                continue
            sums = np.add.reduceat(self.table[k], np.stack([first, np.minimum(last, len(k) - 1)], 1).ravel(), axis=0)[::2]
            tail = last == len(k)
            if tail.any():
                sums[tail] = self.table[k[first[tail][0] :]].sum(0)
            out.append((first, last, words, sums))
        return out


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Classifiers from ``sample`` labelled rows at most, chosen by a hash of their id; whole texts are used."""
    known = F.lower(F.trim(F.regexp_extract(F.col(lang_col), r"^\s*([^-_ (]+)", 1))).isin(list(_KNOWN))
    usable = df.filter(known & F.col(text_col).isNotNull())
    # Ids are chosen first, so that tasks never send more than ids and hashes of candidates to the driver.
    picked = usable.select(F.col(id_col), F.xxhash64(F.col(id_col)).alias("h")).distinct().orderBy("h").limit(sample).select(id_col)
    rows = usable.join(F.broadcast(picked), id_col, "left_semi").select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).collect()
    examples: list[tuple[int, list[str]]] = []
    for r in rows:
        label = canonical(r["l"])
        if label in LANGUAGES:
            for part in re.split(r"[.!?]\s+|\n", plain(r["t"])):
                words = re.findall(r"[^\W\d_]+", part)
                if len(words) >= 4:
                    examples.append((LANGUAGES.index(label), words))
    grams: dict[str, list[int]] = {}
    for _, words in examples:
        for w in words:
            if w not in grams:
                grams[w] = _grams(w)
    own = np.array([y for y, _ in examples], int)
    lists = [[g for w in words for g in grams[w]] for _, words in examples]
    model = Model(np.zeros((len(LANGUAGES), _BUCKETS)))
    for _ in range(2):
        counts = np.zeros((len(LANGUAGES), _BUCKETS))
        for y, gs in zip(own, lists, strict=True):
            np.add.at(counts[y], gs, 1.0)
        model = Model(counts)
        if not len(own):
            break
        margins = np.stack([model.weights[gs].sum(0) / 3 for gs in lists])
        model.accuracy = np.maximum((np.sign(margins) == model.code[own]).mean(0) - 0.5, 0.01)
        own = model.losses(margins).argmin(1)
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_sentences: int = 2, gap: float = 0.2) -> DataFrame:
    """(id, passage, start_char, end_char, lang, confidence, ambiguous, main, given, passages): languages of documents.

    Passage 0 is the whole document with its main language, that of most words; 1, 2, ... are passages of
    ``least_sentences`` sentences or more in another language. Offsets are code points, the end exclusive.
    ``confidence`` is the normalised likelihood under the codewords' losses, ``ambiguous`` tells that the runner-up is nearly as
    near. Sentences of fewer than four words, code, formulas and markup say nothing, so names and single
    terms do not count. ``given`` is the label as a two-letter code, null if missing. A text without words,
    a null or an empty one gives one row of language "und" with confidence 0. Repeated rows give repeated results; extra
    columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                part = batch.slice(at, _PIECE)
                ids, texts, labels = (c.to_pylist() for c in part.columns)
                flat = [plain(t or "") for t in texts]
                read = reader.sentences(flat)
                short = [k for k, r in enumerate(read) if not len(r[0])]
                for k, r in zip(short, reader.sentences([flat[k].replace("\n", " ") for k in short], 1), strict=True):
                    read[k] = r
                losses = model.losses(np.concatenate([r[3] for r in read])) if read else np.zeros((0, 6))
                best = losses.argmin(1)
                two = np.partition(losses, 1, axis=1)[:, :2] if len(losses) else np.zeros((0, 2))
                sure = two[:, 1] - two[:, 0] >= gap
                out, k0 = [], 0
                for i, t, label, (first, last, words, margins) in zip(ids, flat, labels, read, strict=True):
                    n = len(first)
                    lang, ok = best[k0 : k0 + n], sure[k0 : k0 + n]
                    k0 += n
                    given = canonical(label)
                    if not n:
                        out.append((i, 0, 0, len(t), "und", 0.0, False, "und", given, 0))
                        continue
                    use = ok if ok.any() else np.ones(n, bool)
                    main = int(np.bincount(lang[use], words[use], len(LANGUAGES)).argmax())
                    runs: list[list[int]] = []
                    for k in np.flatnonzero(ok).tolist():
                        if runs and runs[-1][0] == lang[k]:
                            runs[-1].append(k)
                        else:
                            runs.append([int(lang[k]), k])
                    other = [r for r in runs if r[0] != main and len(r) > least_sentences]
                    out.append((i, 0, 0, len(t), LANGUAGES[main], *_trust(model, margins[use & (lang == main)].sum(0), main, gap), LANGUAGES[main], given, len(other)))
                    if other:
                        spans = [m.span() for m in _TOKEN.finditer(t)]
                        for p, (l, *own) in enumerate(other, 1):
                            out.append((i, p, spans[first[own[0]]][0], spans[min(last[own[-1]], len(spans) - 1)][1], LANGUAGES[l], *_trust(model, margins[own].sum(0), l, gap), LANGUAGES[main], given, len(other)))
                cols = list(zip(*out, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, k or part.schema.field(0).type) for c, k in zip(cols, types, strict=True)], names)

    names = [id_col, "passage", "start_char", "end_char", "lang", "confidence", "ambiguous", "main", "given", "passages"]
    types = [None, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.int32()]
    return df.select(id_col, text_col, lang_col).mapInArrow(run, f"`{id_col}` {kind}, passage int, start_char int, end_char int, lang string, confidence double, ambiguous boolean, main string, given string, passages int")


def _trust(model: Model, margins: np.ndarray, lang: int, gap: float) -> tuple[float, bool]:
    loss = model.losses(margins[None, :])[0]
    rest = np.delete(loss, lang).min()
    likely = np.exp(-4 * (loss - loss.min()))
    return float(likely[lang] / likely.sum()), bool(rest - loss[lang] < gap)
