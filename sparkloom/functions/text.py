"""Text expressions: cleaning, tokens, shingles, stems, edit similarities, hashes. All are plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters as Python's \\w has them; explicit, so that engines without a Unicode flag agree.
WORD = r"[\p{L}\p{M}\p{N}_]"
#: Suffixes in the order in which they are tried; a fixed list.
SUFFIXES = ("ing", "ed", "ly", "es", "s", "ment", "er", "y")


def clean(text: Column, strict: bool = False) -> Column:
    """Lower case, without signs, white space collapsed and trimmed; strict: unchanged."""
    if strict:
        return text
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_\s]", ""), r"\s+", " "))


def fingerprint(text: Column, strict: bool = False) -> Column:
    return F.sha2(clean(text, strict), 256)


def words(text: Column) -> Column:
    """Split on white space, without empty pieces."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def shingle_words(text: Column) -> Column:
    """Words of a text after lower-casing and deleting full stops and commas."""
    return words(F.translate(F.lower(text), ".,", ""))


def ngrams(array: Column, k: int) -> Column:
    """Each k consecutive elements, joined by one space; an empty array for fewer."""
    n = F.size(array)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(array, i, k), " "))).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, k: int = 3) -> Column:
    """The set of k-word shingles."""
    return F.array_distinct(F.transform(F.array(shingle_words(text)), lambda w: ngrams(w, k))[0])


def stem(word: Column) -> Column:
    """Lower case, without the first suffix that matches and leaves more than two letters."""
    low = F.lower(word)
    out = None
    for s in SUFFIXES:
        hit = low.endswith(s) & (F.length(low) > len(s) + 2)
        cut = F.substring(low, F.lit(1), F.length(low) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(low)


def prefix_similarity(a: Column, b: Column) -> Column:
    """Normalised Levenshtein similarity plus a tenth of the rest for each of up to four equal first letters; 1 if equal."""
    longest = F.greatest(F.length(a), F.length(b))
    sim = F.lit(1.0) - F.levenshtein(a, b) / longest
    prefix = F.lit(0)
    for k in (4, 3, 2, 1):
        same = (F.substring(a, 1, k) == F.substring(b, 1, k)) & (F.length(a) >= k) & (F.length(b) >= k)
        prefix = F.when(same, F.greatest(prefix, F.lit(k))).otherwise(prefix)
    return F.when(a == b, 1.0).otherwise(sim + prefix * 0.1 * (1 - sim))


def deletions(word: Column, distance: int = 1) -> Column:
    """The word and all it gives by deleting up to `distance` letters, without the empty string."""
    found = F.array(word)
    last = found
    for _ in range(distance):
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda w: F.length(w) > 1), cut)))
        found = F.array_union(found, last)
    return F.filter(found, lambda w: w != "")


def weak_hash(text: Column, modulus: int = 256) -> Column:
    """Sum of the code points, modulo."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0).cast("bigint"), lambda a, x: a + x) % modulus


def hex_mod(digest: Column, m: int) -> Column:
    """A 32-digit hexadecimal number modulo m, eight digits at a time."""
    rest = F.lit(0).cast("bigint")
    for k in range(4):
        limb = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
        rest = (rest * ((1 << 32) % m) + limb) % m
    return rest


def bloom_indices(text: Column, capacity: int = 500, hashes: int = 3) -> Column:
    """Bits of a Bloom filter that a text sets: MD5 of its number and the text, modulo the capacity."""
    return F.array(*[hex_mod(F.md5(F.concat(F.lit(f"{i}_"), text)), capacity) for i in range(hashes)])


def chunks(text: Column, size: int = 6, overlap: int = 2) -> Column:
    """Windows of `size` words that overlap; a text of no more words stays as it is; the last window reaches the end."""
    step = size - overlap
    w = words(text)

    def cut(ws: Column) -> Column:
        last = F.ceil((F.size(ws) - size) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(ws, i * step + 1, size), " "))

    return F.transform(F.array(w), lambda ws: F.when(F.size(ws) <= size, F.array(text)).otherwise(cut(ws)))[0]
