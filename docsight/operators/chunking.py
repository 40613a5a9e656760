"""Three chunkers with character offsets and token counts.

Recursive packing depends on what came before in the same text, so it runs in Arrow batches; hard windows
are plain expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsight.functions.vectors import Hasher

#: Separators from strong to weak.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
_HEADING = re.compile(r"\n(?=[A-Z][A-Za-z\s,&]{5,80}\n)")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_COUNTED = re.compile(r"\w+|[^\w\s]")
Embed = Callable[[list[str]], np.ndarray]


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the overlap must be below the size")


def hard_windows(df: DataFrame, text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """``df`` with ``window_no``, ``start_char`` and ``window``: windows of ``size`` every ``size - overlap`` characters over the whole text, stripped, blank ones left out."""
    check_sizes(size, overlap)
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(size - overlap))
    rows = df.filter(F.length(text_col) > 0).select("*", F.posexplode(starts).alias("window_no", "start_char"))
    piece = F.regexp_replace(F.substring(F.col(text_col), F.col("start_char") + 1, F.lit(size)), "^\\s+|\\s+$", "")
    return rows.withColumn("window", piece).filter("window != ''")


def recursive_split(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of about ``size`` characters, cut at the strongest separator that occurs; a separator at a cut is lost.

    Each piece but the first begins with the last ``overlap`` characters of the piece before it and a space, at
    every level of the recursion, so pieces may be longer than ``size``. A text within the size is one
    piece, unchanged; without any separator hard windows are cut.
    """
    check_sizes(size, overlap)
    if len(text) <= size:
        return [text] if text.strip() else []
    cut = next((x for x in separators if x in text), None)
    if cut is None:
        return [w.strip() for w in (text[a : a + size] for a in range(0, len(text), size - overlap)) if w.strip()]
    weaker = separators[separators.index(cut) + 1 :]
    ends = [m.start() for m in re.finditer(re.escape(cut), text)] + [len(text)]
    starts = [0, *(e + len(cut) for e in ends[:-1])]
    pieces, k = [], 0
    while k < len(ends):
        begin, last = starts[k], k
        if ends[k] - begin > size:
            pieces += recursive_split(text[begin : ends[k]], size, overlap, weaker)
        elif ends[k] > begin:  # the run of parts that ends last within the size; a run has no empty part in front
            last = bisect_right(ends, begin + size) - 1
            pieces += filter(None, [text[begin : ends[last]].strip()])
        k = last + 1
    return pieces[:1] + [f"{before[-overlap:]} {piece}" if overlap else piece for before, piece in zip(pieces, pieces[1:], strict=False)]


def semantic_split(text: str, embed: Embed, threshold: float = 0.75, least: int = 200, most: int = 2000) -> list[str]:
    """Runs of sentences; a run ends where the next sentence is less than ``threshold`` similar to its mean and it has ``least`` characters, or where it has ``most``."""
    parts = [s for s in (p.strip() for p in _SENTENCE_END.split(text)) if s]
    if len(parts) < 2:
        return parts
    vectors = np.asarray(embed(parts), float)
    runs: list[list[str]] = []
    mean = np.zeros(vectors.shape[1])
    for sentence, v in zip(parts, vectors, strict=True):
        if runs:
            length = sum(map(len, runs[-1])) + len(runs[-1]) - 1
            scale = np.linalg.norm(mean) * np.linalg.norm(v)
            near = float(mean @ v / scale) if scale else 0.0
        if not runs or length >= most or (near < threshold and length >= least):
            runs.append([sentence])
            mean = v.copy()
        else:
            runs[-1].append(sentence)
            mean = mean + (v - mean) / len(runs[-1])
    return [" ".join(r) for r in runs]


def section_split(text: str, section: str = "", size: int = 1000, overlap: int = 200) -> list[tuple[str, str]]:
    """(label, piece): the text cut before lines that look like headings; a short first line that begins with a capital labels its part."""
    out = []
    for part in filter(None, (p.strip() for p in _HEADING.split(text))):
        first, _, rest = part.partition("\n")
        first = first.strip()
        titled = len(first) < 100 and first[:1].isupper()
        label = (f"{section} > {first}" if section else first) if titled else section
        body = ((rest.strip() if "\n" in part else first) if titled else part)
        out += [(label, piece) for piece in recursive_split(body, size, overlap)]
    return out


def with_offsets(pieces: list[str], text: str) -> list[tuple[int, int]]:
    """Where each piece begins, by its first 50 characters, searched from where the last one ended; else right there."""
    spans, at = [], 0
    for p in pieces:
        found = text.find(p[:50], at)
        start = found if found >= 0 else at
        spans.append((start, start + len(p)))
        at = max(at, start + len(p)) if found < 0 else max(at, start)
    return spans


def count_tokens(text: str, vocabulary: str = "") -> int:
    """Tokens of a public tokenizer whose file (JSON) is given, else words and single signs."""
    return len(_encoder(vocabulary).encode(text, add_special_tokens=False).ids) if vocabulary else len(_COUNTED.findall(text))


@lru_cache(maxsize=4)
def _encoder(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def chunk_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_col: str | None = "section", strategy: str = "section_aware", size: int = 1000, overlap: int = 200, embed: Embed | None = None, threshold: float = 0.75, vocabulary: str = "") -> DataFrame:
    """(id, chunk_index, section, parent_section, text, start_char, end_char, token_count, chunk_id) of every document.

    ``strategy`` is recursive, section_aware or semantic; the last uses ``embed`` (hashed bags of words if
    none is given) and ``size`` as its most. Tokens are counted by the public tokenizer of ``vocabulary`` if there is one. An unknown strategy is recursive. Chunks count from 0 in each document; ids are
    hashes of the document, section, position and text, so the same input gives the same ids. Null and blank
    texts give no chunk; a null section counts as an empty one. Repeated rows give repeated chunks.
    """
    check_sizes(size, overlap)
    kind = df.schema[id_col].dataType.simpleString()
    section = F.coalesce(F.col(section_col), F.lit("")) if section_col else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = embed or Hasher(64)
        for b in batches:
            rows = []
            for i, t, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not t or not t.strip():
                    continue
                if strategy == "section_aware":
                    labelled = section_split(t, s, size, overlap)
                elif strategy == "semantic":
                    labelled = [(s, p) for p in semantic_split(t, how, threshold, 200, size)]
                else:
                    labelled = [(s, p) for p in recursive_split(t, size, overlap)]
                spans = with_offsets([p for _, p in labelled], t)
                rows += [(i, k, label, s, p, a, e, count_tokens(p, vocabulary)) for k, ((label, p), (a, e)) in enumerate(zip(labelled, spans, strict=True))]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

    names = [id_col, "chunk_index", "section", "parent_section", "text", "start_char", "end_char", "token_count"]
    made = df.select(id_col, text_col, section.alias("__section")).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, section string, parent_section string, text string, start_char int, end_char int, token_count int")
    return made.withColumn("chunk_id", F.sha2(F.concat_ws("\u0001", F.col(id_col).cast("string"), "section", F.col("chunk_index").cast("string"), "text"), 256))
