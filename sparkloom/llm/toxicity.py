"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, normalised by length, calibrated."""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled, pool_adjacent, without

#: Weights of the words that any lexicon starts with.
BASE_WORDS = {
    "idiot": 4.0, "moron": 4.0, "stupid": 3.5, "scum": 4.0, "loser": 3.0, "trash": 2.5, "pathetic": 3.0,
    "worthless": 3.5, "disgusting": 3.0, "clown": 2.5, "imbecile": 4.0, "dumbass": 4.5, "bastard": 4.0, "bitch": 4.5,
}
#: Phrases in which such a word says nothing bad; hits within them do not count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "take out the trash", "worthless coin", "sore loser rule")

#: Letters of other alphabets that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])
WIDE = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | UNSEEN
NARROW = {ord(k): v for k, v in DIGITS.items()}
SIGNS = re.compile(r"[@$](?=[^\W_])")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, invisible characters, look-alike letters and digits in place of letters."""
    if text.isascii():
        text = text.lower().translate(NARROW)
    else:
        text = unicodedata.normalize("NFKD", text).lower().translate(WIDE)
    if "@" in text or "$" in text:
        text = SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text


def outside(at: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """The entries whose place lies in none of the closed intervals: one sweep over both in order."""
    kept, intervals, i, reach = {}, sorted(spared), 0, -1
    for place in sorted(at):
        while i < len(intervals) and intervals[i][0] <= place:
            reach = max(reach, intervals[i][1])
            i += 1
        if place > reach:
            kept[place] = at[place]
    return kept


@dataclass
class Lexicon:
    """Patterns that stand at a word's start (prefixes) or are whole words, with weights; then the score's calibration."""

    words: dict[str, float] = field(default_factory=lambda: dict(BASE_WORDS))
    prefixes: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    xs: list[float] = field(default_factory=lambda: [0.0, math.inf])
    ys: list[float] = field(default_factory=lambda: [0.02, 0.9])

    def automaton(self) -> ahocorasick.Automaton:
        entries: dict[str, list] = {}
        for kind, group in (("w", self.words), ("p", self.prefixes), ("x", dict.fromkeys(self.exceptions, 0.0))):
            for word, weight in group.items():
                if key := fold(word):
                    entries.setdefault(key, []).append((kind, len(key), weight))
        a = ahocorasick.Automaton()
        for key, values in entries.items():
            a.add_word(key, values)
        if entries:
            a.make_automaton()
        return a

    def raw(self, text: str | None, automaton: ahocorasick.Automaton) -> float:
        """Weights of the words hit, each once at its best pattern, per square root of the length in words, at log scale."""
        if not text or not len(automaton):
            return 0.0
        folded = fold(text)
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, values in automaton.iter(folded):
            for kind, n, weight in values:
                start = end - n + 1
                if start and folded[start - 1].isalnum():
                    continue
                if kind != "p" and end + 1 < len(folded) and folded[end + 1].isalnum():
                    continue
                if kind == "x":
                    spared.append((start, end))
                elif weight > at.get(start, 0.0):
                    at[start] = weight
        if spared:
            at = outside(at, spared)
        total = sum(at.values())
        return total / math.sqrt(8 + len(folded) / 6)

    def score(self, text: str | None, automaton: ahocorasick.Automaton) -> float:
        x = self.raw(text, automaton)
        return self.ys[min(bisect.bisect_left(self.xs, x), len(self.ys) - 1)] + min(x, 10.0) * 1e-4


def patterns_of(text: str, shortest: int = 4) -> set[str]:
    """The folded words of a text and their prefixes of at least `shortest` letters."""
    found: set[str] = set()
    for w in set(WORD.findall(fold(text))):
        found.update(w[:k] for k in range(min(shortest, len(w)), len(w) + 1))
    return found


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, largest: int = 5_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon and calibration from at most `sample` labelled documents (half of them toxic, least hash of the id first).

    Folds 0 and 1 give the patterns, by the log odds of documents that hold them; fold 3 gives the calibration, on 64
    steps of the raw score. Without labels, or with one class only, the base lexicon and its fixed calibration remain.
    exceptions: phrases in which a hit does not count.
    """
    order = F.xxhash64("doc_id")
    y = labelled(labels, "toxic")
    parts = [y.where(F.col("y") == v).orderBy(order, "doc_id").limit(sample // 2) for v in (1.0, 0.0)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most `sample` rows of three numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(chosen, "doc_id").select("text", "fold", "y")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = sorted(patterns_of(t))
                yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.string()), pa.array([y] * (len(found) + 1), pa.float64())], names=["pattern", "y"])

    counts = (
        texts.where("fold <> 3").select("text", "y").mapInArrow(emit, "pattern string, y double").groupBy("pattern").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    )
    total = F.broadcast(counts.where("pattern IS NULL").select(F.col("t").alias("tt"), F.col("n").alias("nn")))  # one row
    odds = F.log((F.col("t") + 0.5) / (F.col("tt") - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.1) / (F.col("nn") - F.col("tt") - (F.col("n") - F.col("t")) + 0.5))
    best = (
        counts.where("pattern IS NOT NULL AND t >= 3")
        .crossJoin(total)
        .where("t >= greatest(3, 0.01 * tt) AND (n - t) <= 0.03 * t AND tt > 0 AND nn > tt")
        .select("pattern", "t", odds.alias("w"))
        .orderBy(F.desc("t"), "pattern")
        .limit(largest)
        .collect()
    )
    lex = Lexicon(exceptions=exceptions, prefixes={r["pattern"]: min(8.0, r["w"]) for r in best if r["w"] > 1})

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lex.automaton()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lex.raw(t, a) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "y"])

    step = F.when(F.col("x") <= 0, 0.0).otherwise(F.pow(F.lit(1.25), F.ceil(F.log(F.col("x")) / F.log(F.lit(1.25)))))
    points = [
        (r["step"], r["s"], r["n"])
        for r in texts.where("fold = 3").select("text", "y").mapInArrow(rate, "x double, y double").groupBy(step.alias("step")).agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()  # steps of a score: a few dozen
    ]
    if points and 0 < sum(p[1] for p in points) < sum(p[2] for p in points):
        lex.xs, lex.ys = pool_adjacent(points)
    return lex


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of each row, 0 to 1; null and empty texts hold no toxic word and get the lowest score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            scores = [min(1.0, lexicon.score(t, a)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; one pass, no shuffle."""
    schema = docs.schema
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            yield b.filter(pa.array([lexicon.score(t, a) < threshold for t in b.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op3_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score and decision of each row, repeated ones too. Rows without doc_id keep a null id and are not held out."""
    scored = score_toxicity(docs, learn(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
