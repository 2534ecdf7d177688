"""Language identification of whole texts, span by span.

A word (a run of letters) belongs to the script of its first letter, and only
languages that use that script remain candidates for it. Its score for a
language is a naive Bayes sum over the letter triples around each letter and
over the word itself, both hashed into tables of fixed size. Viterbi over the
words' scores, with a penalty for each switch, labels spans of mixed-language
text. A text's language is the label with most letters, its score that label's
share of the letters.

The model is fitted on at most `sample` labelled documents a language; those of
whom crc32 of the doc_id as text is divisible by 5 are held out. Null text or
text without letters is `und` with score 0, and so is everything if no document
is labelled. Rows of one doc_id are labelled one by one; a row without doc_id
counts as held out. An empty table gives no rows; the labelled table keeps the
input's columns and adds to them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back
from .tokenizing import text_slices

# First code points of Unicode's larger alphabets; each goes on to the next entry's start.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1400, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
)
STARTS, NAMES = np.array([s for s, _ in SCRIPTS]), np.array([n for _, n in SCRIPTS])
ALPHABETS = sorted(set(NAMES.tolist()))
SCRIPT_OF = np.array([ALPHABETS.index(n) for n in NAMES])

BINS, BLOCK = 1 << 16, 64


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower case."""
    points = range(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in points), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letter, lower


class WordsOf:
    """The words of some texts: hashed triples of each letter, hashed words, scripts and places."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        letter, lower = _tables()
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))])
        mask = letter[points]
        low = np.where(mask, lower[points], 0).astype(np.uint32)
        edge = np.zeros(len(points) + 1, bool)
        edge[self.offsets] = True
        before, after = np.zeros(len(low), np.uint32), np.zeros(len(low), np.uint32)
        if len(low):
            before[1:], after[:-1] = np.where(edge[1:-1], 0, low[:-1]), np.where(edge[1:-1], 0, low[1:])
        first = mask & (before == 0)
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(mask & (after == 0)) + 1
        at = np.flatnonzero(mask)
        h = before[at] * np.uint32(2654435761) ^ low[at] * np.uint32(2246822519) ^ after[at] * np.uint32(3266489917)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(668265263)
        self.triples = h >> np.uint32(16)
        self.letters = self.ends - self.starts
        self.upto = np.cumsum(self.letters) - self.letters
        word = np.add.reduceat(h ^ (h >> np.uint32(13)), self.upto, dtype=np.uint32) if len(self.upto) else np.empty(0, np.uint32)
        self.words = (word * np.uint32(2654435761)) >> np.uint32(16)
        self.scripts = SCRIPT_OF[np.searchsorted(STARTS, points[self.starts], side="right") - 1]
        self.of_doc = np.searchsorted(self.starts, self.offsets)


def _count(key: tuple, rows: pa.Table) -> pa.Table:
    counts = np.zeros((2, BINS))
    scripts = np.zeros(len(ALPHABETS))
    for batch in rows.to_batches():
        for lo, hi in text_slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), 1 << 20):
            words = WordsOf(batch.column("text")[lo:hi])
            counts[0] += np.bincount(words.triples, minlength=BINS)
            counts[1] += np.bincount(words.words, minlength=BINS)
            scripts += np.bincount(words.scripts, minlength=len(ALPHABETS))
    return pa.table({"lang": [key[0].as_py()], "counts": [counts.astype("<f4").tobytes()], "scripts": [scripts.tolist()]})


class Model:
    def __init__(self, langs: list[str], triples: np.ndarray, words: np.ndarray, allowed: np.ndarray, penalty: float):
        self.langs, self.triples, self.words, self.allowed, self.penalty = langs, triples, words, allowed, penalty


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample: int = 1000, penalty: float = 8.0, parts: int = 4) -> Model | None:
    """Counts on the executors; the driver gets two tables of fixed size from each of `parts` portions of a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # Hashes of whole rows thin them to about twice the sample, text and all, before they are ranked; repeated ids stay rows of their own.
    sizes = F.broadcast(labelled.groupBy("lang").agg(F.count("*").alias("size")))  # a row a language, of which the model holds two tables
    own = F.xxhash64("doc_id", "text")
    few = labelled.select("lang", "text", own.alias("own")).join(sizes, "lang").where(F.pmod("own", F.lit(1 << 40)) * F.col("size").cast("double") <= F.lit(2.0 * sample * (1 << 40)))
    order = Window.partitionBy("lang").orderBy("own", "text")
    texts = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("lang", "text", (F.col("n") % parts).alias("part"))
    portions = texts.groupBy("lang", "part").applyInArrow(_count, "lang string, counts binary, scripts array<double>").collect()
    if not portions:
        return None
    found = []
    for lang in sorted({r["lang"] for r in portions}):
        own_rows = [r for r in portions if r["lang"] == lang]
        found.append({"lang": lang, "counts": sum(np.frombuffer(r["counts"], "<f4").reshape(2, BINS).astype(float) for r in own_rows), "scripts": np.sum([r["scripts"] for r in own_rows], axis=0)})
    counts = np.stack([r["counts"] for r in found], axis=2)
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))
    logs -= logs.mean(axis=2, keepdims=True)
    scripts = np.array([r["scripts"] for r in found])
    allowed = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model([r["lang"] for r in found], logs[0].astype(np.float32), logs[1].astype(np.float32), allowed.T, penalty)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of each text, text i's words being offsets[i] to offsets[i + 1] - 1.

    Texts are cut into blocks; a block's best scores from each entry to each
    exit label are found for all blocks at once, then chained text by text, and
    then the way inside each block is followed back.
    """
    n_words, n_labels = scores.shape
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total:
        return np.empty(0, np.int64)
    word = np.arange(n_words) - np.repeat(offsets[:-1], size)
    slot = (np.repeat(first, size) * BLOCK + word).astype(np.int64)
    padded = np.zeros((total * BLOCK, n_labels), np.float32)
    padded[slot] = scores
    steps = padded.reshape(total, BLOCK, n_labels).transpose(1, 0, 2)
    best = np.full((total, n_labels, n_labels), -penalty, np.float32)
    best[:, np.arange(n_labels), np.arange(n_labels)] = 0
    best += steps[0][:, None, :]
    for s in steps[1:]:
        best = np.maximum(best, best.max(axis=2, keepdims=True) - penalty) + s[:, None, :]
    # Chain the blocks of each text.
    entry, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
    came = np.zeros((total, n_labels), np.int64)
    order = np.argsort(-blocks, kind="stable")
    state = np.zeros((len(size), n_labels), np.float32)
    longest = int(blocks.max())
    live_at = [order[: np.searchsorted(-blocks[order], -b, side="left")] for b in range(longest)]
    for b, live in enumerate(live_at):
        way = state[live][:, :, None] + best[first[live] + b]
        came[first[live] + b] = way.argmax(axis=1)
        state[live] = way.max(axis=1)
    label = state.argmax(axis=1)
    for b in reversed(range(longest)):
        live = live_at[b]
        at = first[live] + b
        leave[at] = label[live]
        entry[at] = came[at, label[live]]
        label[live] = entry[at]
    # Inside each block, from its entry label to its exit label.
    now = np.full((total, n_labels), -penalty, np.float32)
    now[np.arange(total), entry] = 0
    now += steps[0]
    switched, source = np.zeros((BLOCK, total, n_labels), bool), np.zeros((BLOCK, total), np.int64)
    for t in range(1, BLOCK):
        source[t] = now.argmax(axis=1)
        jump = now.max(axis=1, keepdims=True) - penalty
        switched[t] = jump > now
        now = np.maximum(now, jump) + steps[t]
    labels = np.empty((BLOCK, total), np.int64)
    here, rows = leave, np.arange(total)
    for t in reversed(range(BLOCK)):
        labels[t] = here
        if t:
            here = np.where(switched[t][rows, here], source[t], here)
    return labels.T.reshape(-1)[slot]


def _label(texts: pa.Array, model: Model | None) -> tuple[list, np.ndarray, pa.Array]:
    """Each text's language, its score, and its spans of one label (first and past-last character, language)."""
    words = WordsOf(texts)
    n = len(texts)
    kind = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    if model is None or not len(words.starts):
        return ["und"] * n, np.zeros(n), pa.array([[]] * n, pa.list_(kind))
    scores = np.add.reduceat(model.triples[words.triples], words.upto, axis=0) + model.words[words.words]
    allowed = model.allowed[words.scripts]
    some = allowed.any(axis=1, keepdims=True)
    scores = np.where(some, np.where(allowed, scores, scores.min(axis=1, keepdims=True) - 4 * model.penalty), 0)
    label = viterbi(scores, words.of_doc, model.penalty)
    doc = np.repeat(np.arange(n), np.diff(words.of_doc))
    n_labels = len(model.langs)
    letters = np.bincount(doc * n_labels + label, words.letters, n * n_labels).reshape(n, n_labels)
    total = letters.sum(axis=1)
    pick = letters.argmax(axis=1)
    score = np.where(total > 0, letters[np.arange(n), pick] / np.maximum(total, 1), 0)
    turn = np.ones(len(label), bool)
    turn[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    last = np.append(np.flatnonzero(turn)[1:] - 1, len(label) - 1)
    base = words.offsets[doc[turn]]
    spans = pa.StructArray.from_arrays([pa.array(words.starts[turn] - base), pa.array(words.ends[last] - base), pa.array(np.array(model.langs, object)[label[turn]], pa.string())], names=["begin", "end", "lang"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[turn], np.arange(n + 1)), pa.int32()), spans)
    return [model.langs[p] if t else "und" for p, t in zip(pick, total, strict=True)], score, lists


def _predict(model):
    def rows(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for lo, hi in text_slices(sizes, 1 << 20):
                some = batch.slice(lo, hi - lo)
                langs, score, spans = _label(some.column("text"), model.value)
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("held_out"), pa.array(langs, pa.string()), pa.array(score), spans], names=["row", "held_out", "lang_pred", "score", "spans"])
            give_back()

    return rows


def label_languages(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """(row: the input's columns, held_out, lang_pred, score, spans) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("row")
    rows = docs.select(kept, held_out().alias("held_out"), F.col("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, spans array<struct<begin:bigint,end:bigint,lang:string>>"
    return rows.mapInArrow(_predict(shared), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return label_languages(docs, fit(docs), ["doc_id"]).select("row.doc_id", "held_out", "lang_pred", "score")
