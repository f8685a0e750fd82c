"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leak is a run of this many words of an item.
LEAST_WORDS = 12
#: Words of corpus text in one suffix array, and characters of items that meet the corpus at once (the bound of what is broadcast).
SHARD_WORDS = 2_000_000
BLOCK_CHARS = 32_000_000
#: Test suffixes searched, matches expanded and words compared in one step: bounds of a task's memory.
CHUNK, STEP = 200_000, 16

_WORD = re.compile(r"[^\W_]+")
_BREAK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_HYPHEN = re.compile(r"([^\W_]+)[-‐‑][ \t]*(?:\r\n|\r|\n)\s*([^\W_]+)")


def words(text: str | None, vocabulary: dict[str, int] | None = None) -> list[str]:
    """Runs of letters and digits, case folded, without markup tags.

    A word hyphenated at a line break is joined; with a vocabulary, only if the joined word is in it, so that
    a compound broken at its own hyphen stays two words.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", _BREAK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("­", ""))
    text = text.casefold()
    if "\n" in text or "\r" in text:

        def join(m: re.Match) -> str:
            joined = m[1] + m[2]
            return joined if vocabulary is None or joined in vocabulary else f"{m[1]} {m[2]}"

        while (once := _HYPHEN.sub(join, text)) != text:
            text = once
    return _WORD.findall(text)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, as far as the first ``depth`` tokens; by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else []
        step *= 2
        if step >= depth or n == 0 or rank.max() == n:
            return order


class Items:
    """The suffixes of a block of test items, ready to be searched in any number of shards.

    All words stand in one array, each item between separators; a suffix is a place in it.
    """

    def __init__(self, items: list[tuple[object, str | None]], least: int) -> None:
        self.least = least
        texts = [(i, words(t)) for i, t in items]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for _, ws in texts for w in ws))}
        separator = np.array([-2], np.int32)
        parts, at, owner, start, length = [separator], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1
        self.ids = np.empty(len(texts), dtype=object)
        for n, (i, ws) in enumerate(texts):
            self.ids[n] = i
            starts = np.arange(max(0, len(ws) - least + 1))
            at.append(starts + length)
            start.append(starts)
            owner.append(np.full(len(starts), n))
            parts += [np.array([self.vocabulary[w] for w in ws], np.int32), separator]
            length += len(ws) + 1
        self.flat = np.concatenate([*parts, np.full(least + STEP, -2, np.int32)])
        self.at, self.owner, self.start = np.concatenate(at), np.concatenate(owner), np.concatenate(start)

    def search(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Verbatim matches of at least ``least`` words that cannot begin a word earlier: (number of the test suffix, position, length), in chunks."""
        if len(tokens) < self.least or not len(self.at):
            return
        order = suffix_array(tokens, self.least)
        padded = np.concatenate([tokens, np.full(self.least + STEP, -1, tokens.dtype)])
        before = np.concatenate([np.array([-1], tokens.dtype), tokens])
        for low in range(0, len(self.at), CHUNK):
            at = self.at[low : low + CHUNK]
            left, right = self._bound(padded, order, at, False), self._bound(padded, order, at, True)
            found = np.flatnonzero(right > left)
            ends = np.cumsum(right[found] - left[found])
            for first in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                n = np.arange(first, min(first + CHUNK, int(ends[-1])))
                which = np.searchsorted(ends, n, side="right")
                suffix = found[which]
                position = order[left[suffix] + n - (ends[which] - (right[suffix] - left[suffix]))]
                whole = before[position] != self.flat[at[suffix] - 1]
                suffix, position = suffix[whole], position[whole]
                yield low + suffix, position, self._lengths(padded, position, at[suffix])

    def _bound(self, padded: np.ndarray, order: np.ndarray, at: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of test suffixes by their first ``least`` words."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
        span = np.arange(self.least)
        wanted = self.flat[at[:, None] + span]
        rows = np.arange(len(at))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            seen = padded[order[np.minimum(middle, len(order) - 1)][:, None] + span]
            differs = seen != wanted
            first = differs.argmax(1)
            less = np.where(differs.any(1), seen[rows, first] < wanted[rows, first], right)
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def _lengths(self, padded: np.ndarray, position: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How far the words agree from there on; both arrays end on separators that never agree."""
        length = np.full(len(at), self.least, np.int64)
        active, span = np.arange(len(at)), np.arange(STEP)
        while len(active):
            differs = padded[(position[active] + length[active])[:, None] + span] != self.flat[(at[active] + length[active])[:, None] + span]
            stops = differs.any(1)
            length[active] += np.where(stops, differs.argmax(1), STEP)
            active = active[~stops]
        return length


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, item, longest, doc_word, item_word): the longest verbatim match of each leaked item in a document.

    doc_word and item_word are the numbers of its first words, from 0, in the shard's words of the document
    and in the item. Null and empty texts match nothing; repeated rows with one id give one row; items with
    fewer than ``least_words`` words cannot leak. Columns of the tables beyond those named are not read.

    The corpus is read once (once per ``BLOCK_CHARS`` characters of items, the bound of what is broadcast)
    and never shuffled: each task builds suffix arrays over shards of whole documents, sorted as far as
    ``least_words`` words, and searches all test suffixes in them; matches are then followed word by word to
    their ends. Only runs of words that occur in some item can match, so only those enter the array:
    the matches are the same, the array is a small part of the shard.
    """
    spark = docs.sparkSession
    sized = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    blocks = 1 + int(sized.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // BLOCK_CHARS
    kind = dict(docs.dtypes)[doc]
    item_kind = dict(items.dtypes)[item]
    schema = f"doc {kind}, item {item_kind}, longest int, doc_word int, item_word int"
    corpus = docs.where(F.col(doc).isNotNull() & (F.length(text) > 0)).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    found = None
    for block in range(blocks):
        rows = [(r["i"], r["t"]) for r in sized.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()]
        share = spark.sparkContext.broadcast(Items(rows, least_words))

        def search(batches: Iterator[pd.DataFrame], share=share) -> Iterator[pd.DataFrame]:
            items_ = share.value
            for batch in batches:
                yield from _search_batch(batch, items_)

        part = corpus.mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("longest", -F.col("doc_word"), -F.col("item_word"))).alias("b"))
    return best.select(F.col("doc").alias(doc), F.col("item").alias(item), F.col("b.longest").alias("longest"), (-F.col("b.col2")).alias("doc_word"), (-F.col("b.col3")).alias("item_word"))


def _search_batch(batch: pd.DataFrame, items: Items) -> Iterator[pd.DataFrame]:
    vocabulary, least = items.vocabulary, items.least
    runs: list[list[int]] = []
    starts: list[tuple[int, int]] = []  # document row and word number of each run
    held = 0
    for row, text in enumerate(batch["text"]):
        ids = [vocabulary.get(w, -1) for w in words(text, vocabulary)]
        begin = 0
        ids.append(-1)
        for at, x in enumerate(ids):
            if x < 0:
                if at - begin >= least:
                    runs.append(ids[begin:at])
                    starts.append((row, begin))
                    held += at - begin + 1
                begin = at + 1
        if held >= SHARD_WORDS:
            yield _matches(batch, items, runs, starts)
            runs, starts, held = [], [], 0
    if runs:
        yield _matches(batch, items, runs, starts)


def _matches(batch: pd.DataFrame, items: Items, runs: list[list[int]], starts: list[tuple[int, int]]) -> pd.DataFrame:
    tokens = np.concatenate([np.array([*run, -1], np.int32) for run in runs])
    lengths = np.array([len(r) + 1 for r in runs])
    first = np.cumsum(lengths) - lengths
    rows, words_ = np.array([s[0] for s in starts]), np.array([s[1] for s in starts])

    def longest(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["longest", "doc_word", "item_word"], ascending=[False, True, True]).drop_duplicates(["row", "owner"])

    best = pd.DataFrame({"row": [], "owner": [], "longest": [], "doc_word": [], "item_word": []}, dtype="int64")
    for which, position, length in items.search(tokens):
        run = np.searchsorted(first, position, side="right") - 1
        found = pd.DataFrame({"row": rows[run], "owner": items.owner[which], "longest": length, "doc_word": words_[run] + position - first[run], "item_word": items.start[which]})
        best = longest(pd.concat([best, longest(found)]))
    docs = batch["doc"].to_numpy(dtype=object)
    # objects also where there is none: an empty float column is no text
    return pd.DataFrame({"doc": pd.Series(docs[best["row"].to_numpy()], dtype=object), "item": pd.Series(items.ids[best["owner"].to_numpy()], dtype=object), **{c: best[c].to_numpy() for c in ("longest", "doc_word", "item_word")}})


def without_leaks(docs: DataFrame, doc: str, leaks: DataFrame) -> DataFrame:
    """docs without the documents that hold a leak; rows with a null id stay."""
    return docs.join(leaks.select(F.col(doc).alias("__leaked")).distinct(), F.col(doc) == F.col("__leaked"), "left_anti")
