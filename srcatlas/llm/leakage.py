"""Evaluation texts leaking into training text (problem 9): a prefix-filtered set join with exact verification.

The shingles are single words, as a leak may have words changed or put in every few words, which would break longer ones. An item's
words are ordered by rarity in the corpus, the documents that hold half of the item in order left out, so that an item that leaked
often keeps its rare words. A leak holds a share of the rare words, so it holds one of a necessary prefix of them: documents and items
are joined on the prefix words, under a bound on the document's length, and what is joined is verified exactly. Enough rare words
must lie close together, and the longest common subsequence with the item inside a window around them, an item's size more at both
ends, must reach half of the item's words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.plans.runtime import cut, spread

#: Share of an item's words that a window must hold in order, and of its rare words.
WORDS_SHARE, RARE_SHARE = 0.5, 0.2
#: A word is rare if no more documents than this share, or this number, hold it.
RARE_DOCS, RARE_LEAST = 0.003, 5
#: Words of a window, in item lengths, that half of an item may be spread over.
WINDOW = 1.5
#: With fewer rare words an item goes by its rarest ones.
FEW = 5
#: Rare words of an item further apart than this many item lengths belong to different passages.
GAP = 0.9
#: Parts of an item that are looked at apart when its words are frequent because of its own leaks.
PARTS = 3
#: A word is an item's own if no more than this share of the items, or one, have it.
OWN_SHARE = 0.01
#: Bits of the filter that keeps words from being joined which no item asks for: of fixed size, whatever the number of items.
FILTER_BITS = 1 << 22

_MARKUP = regex.compile(r"</?[A-Za-z][^<>\n]*>|&(?:[a-z]{2,8}|#\d{1,6});")
_SENTENCE = regex.compile(r"(?<=[.?!])\s+")
_WORD = regex.compile(r"[\p{L}\p{N}_]+(?:['’][\p{L}]+)?")


def words(text: str | None) -> list[str]:
    """Lower-case words without markup; null gives none."""
    return _WORD.findall(_MARKUP.sub(" ", text).lower()) if text else []


class Item:
    """One item: its words in order, the rare ones, those between its opening and closing sentence, and how many rare ones are needed."""

    def __init__(self, item_words: list[str], rare: list[str], inner: list[str], need: int) -> None:
        self.words, self.rare, self.inner, self.need = item_words, set(rare), set(inner), need
        self.masks: dict[str, int] = {}
        for n, x in enumerate(item_words):
            self.masks[x] = self.masks.get(x, 0) | 1 << n

    def common(self, window: list[str]) -> int:
        """Length of the longest common subsequence, bit-parallel over the item's words."""
        full = (1 << len(self.words)) - 1
        v = full
        for x in window:
            m = self.masks.get(x)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(self.words) - v.bit_count()

    def passages(self, doc: list[str]) -> Iterator[list[str]]:
        """Windows of WINDOW times the item's size, each beginning with a word of the item, that hold half of it in order."""
        n = len(self.words)
        size, half = math.ceil(WINDOW * n), WORDS_SHARE * n
        spots = [k for k, w in enumerate(doc) if w in self.masks]
        to, starts = 0, []
        for k, spot in enumerate(spots):
            while to < len(spots) and spots[to] < spot + size:
                to += 1
            if to - k >= half:
                starts.append(spot)
        at = 0
        while at < len(starts):  # starts close together are looked at one by one only if all their windows as one hold half
            end = at
            while end < len(starts) and starts[end] <= starts[at] + n // 4:
                end += 1
            if self.common(doc[starts[at] : starts[end - 1] + size]) >= half:
                for start in starts[at:end]:
                    window = doc[start : start + size]
                    if self.common(window) >= half:
                        yield window
            at = end

    def leaked_into(self, doc: list[str]) -> bool:
        n = len(self.words)
        if len(doc) < WORDS_SHARE * n:
            return False
        spots = [k for k, w in enumerate(doc) if w in self.rare]
        start = 0
        for k in range(1, len(spots) + 1):  # clusters of rare words not further apart than GAP items
            if k < len(spots) and spots[k] - spots[k - 1] <= max(20, GAP * n):
                continue
            cluster, start = spots[start:k], k
            held = {doc[s] for s in cluster}
            if len(held) < self.need or self.inner and not held & self.inner:
                continue
            if self.common(doc[max(0, cluster[0] - n) : cluster[-1] + n + 1]) >= WORDS_SHARE * n:
                return True
        return False


def ranked(text: str, docs_with: dict[str, int], leaks_with: dict[str, int], own: set[str], limit: float) -> tuple[list[str], list[str], list[str], int, list[str]]:
    """(rare words by rarity, inner ones, necessary prefix, rare words needed, words to look at for the item's own leaks) of one item.

    A word is rare if at most `limit` documents hold it that do not hold half of the item. The last are, for each part of the item
    without two rare words, the FEW rarest of its words that are its `own`, hardly any other item having them: a part that leaked
    often has made its own words frequent. Before each stand the part's number and how many of its words a document must hold.
    """
    w = words(text)
    elsewhere = {x: docs_with.get(x, 0) - leaks_with.get(x, 0) for x in w}
    ordered = sorted(elsewhere, key=lambda x: (docs_with.get(x, 0), x))
    rare = [x for x in ordered if elsewhere[x] <= limit]
    held, suspects = set(rare), []
    for k in range(PARTS):
        part = set(w[len(w) * k // PARTS : len(w) * (k + 1) // PARTS])
        if part and len(part & held) < 2:
            some = [x for x in ordered if x in part & own][:FEW]
            suspects += [f"{k}:{len(some) // 2 + 1} {x}" for x in some]
    if len(rare) < FEW:  # an item of everyday words: its rarest ones, however frequent
        ordered.sort(key=lambda x: (elsewhere[x], x))
        rare = ordered[: max(FEW, len(ordered) // 4)]
    need = max(min(2, len(rare)), math.ceil(RARE_SHARE * len(rare)))
    # rare words between the opening and the closing sentence: those two alone are no leak
    middle = {x for sentence in _SENTENCE.split(_MARKUP.sub(" ", text).strip())[1:-1] for x in words(sentence)}
    # any document with `need` rare words holds one of the rarest so many
    return rare, [x for x in rare if x in middle], rare[: len(rare) - need + 1], need, suspects


_RANKED = "item_key bigint, item_id bigint, words array<string>, rare array<string>, inner array<string>, prefix array<string>, need int, suspects array<string>"


def _rank(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    names = ["item_key", "item_id", "words", "rare", "inner", "prefix", "need", "suspects"]
    lists = pa.list_(pa.string())
    for batch in batches:
        rows = []
        for key, item_id, text, counts in zip(*(batch.column(c).to_pylist() for c in ("item_key", "item_id", "text", "counts"))):
            docs_with, leaks_with = ({x["word"]: x[c] or 0 for x in counts or ()} for c in ("n", "leaks"))
            rare, inner, prefix, need, suspects = ranked(text, docs_with, leaks_with, {x["word"] for x in counts or () if x["own"]}, limit)
            rows.append((key, item_id, words(text), rare, inner, prefix, need, suspects))
        columns = zip(*rows) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), lists, lists, lists, lists, pa.int32(), lists))], names=names)


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, x) for key, text in zip(batch.column("item_key").to_pylist(), batch.column("text").to_pylist()) for x in dict.fromkeys(words(text))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], names=["item_key", "word"])


class Filter:
    """Whether a word may be one of those asked for; asked once per word and worker."""

    def __init__(self, bits: bytes) -> None:
        self.bits, self.known = np.frombuffer(bits, np.uint8), {}

    def __call__(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            h = zlib.crc32(word.encode("utf-8", "replace")) % FILTER_BITS
            got = self.known[word] = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return got


def _document_counts(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """In how many documents of the partition each word of the items occurs, '' counting all."""
    may, counts = Filter(bits), Counter({"": 0})
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts[""] += 1
            counts.update([w for w in set(words(text)) if may(w)])
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _document_words(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, word, n_words): the words of each document that an item may ask for."""
    may = Filter(bits)
    for batch in batches:
        ids, found, sizes = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc = words(text)
            hit = [w for w in set(doc) if may(w)]
            ids += [doc_id] * len(hit)
            found += hit
            sizes += [len(doc)] * len(hit)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "word", "n_words"])


def _bits_of(rows: DataFrame) -> bytes:
    """The filter of the words of a column `word`; what is collected is bounded by FILTER_BITS."""
    spots = rows.select(F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(FILTER_BITS)).cast("int").alias("h")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(FILTER_BITS, np.uint8)
    bits[spots] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _judge(batches: Iterator[pa.RecordBatch], leaks: bool) -> Iterator[pa.RecordBatch]:
    """Each document with the items joined to it: those that leaked into it, or, with `leaks`, the words it holds of those it holds half of."""
    known: dict[int, Item] = {}
    for batch in batches:
        ids, keys, third = [], [], []
        for doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
            doc = words(text)
            held = set(doc)
            for x in items:
                item = known.get(x["item_key"])
                if item is None:
                    if len(known) > 20_000:
                        known.clear()
                    item = known[x["item_key"]] = Item(x["words"], x["rare"], x["inner"], x["need"])
                if leaks:
                    if next(item.passages(doc), None):
                        mine = held & item.masks.keys()
                        ids += [doc_id] * len(mine)
                        keys += [x["item_key"]] * len(mine)
                        third += mine
                elif item.leaked_into(doc):
                    ids.append(doc_id)
                    keys.append(x["item_key"])
                    third.append(x["item_id"])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(third, pa.string() if leaks else pa.int64())], names=["doc_id", "item_key", "word" if leaks else "item_id"])


def _joined(docs: DataFrame, items: DataFrame, suspects: bool = False) -> DataFrame:
    """(doc_id, text, items): documents with the items of which they hold a prefix word, or most of a part's suspects, and half as many words.

    Documents' words that no item asks for are dropped before the join; a word of many documents is split by Spark at run time.
    """
    words_of = F.explode("suspects" if suspects else "prefix").alias("asked")
    asked = items.select("item_key", (F.size("words") * WORDS_SHARE).alias("least"), words_of)
    asked = asked.select("item_key", "least", F.substring_index("asked", " ", 1).alias("part"), F.substring_index("asked", " ", -1).alias("word"))
    found = docs.mapInArrow(partial(_document_words, bits=_bits_of(asked)), "doc_id bigint, word string, n_words bigint")
    pairs = found.join(asked, "word").where(F.col("n_words") >= F.col("least"))
    if suspects:
        pairs = pairs.groupBy("doc_id", "item_key", "part").agg(F.countDistinct("word").alias("n")).where(F.col("n") >= F.substring_index("part", ":", -1).cast("int"))
    one = F.struct("item_key", "item_id", "words", "rare", "inner", "need")
    lists = pairs.select("doc_id", "item_key").distinct().join(items.select("item_key", one.alias("item")), "item_key").groupBy("doc_id").agg(F.collect_list("item").alias("items"))
    return docs.join(lists, "doc_id").select("doc_id", "text", "items")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): every document holding an item's passage, once per item.

    Null and empty texts hold nothing; repeated rows of a document give one row; rows without doc_id or item_id are left out; of an
    item_id with several texts each counts; an item without words is never found. Empty tables give an empty result.
    """
    docs = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    wanted = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct().withColumn("item_key", F.xxhash64("item_id", "text"))
    item_words = cut(wanted.select("item_key", "text").mapInArrow(_words_of_items, "item_key bigint, word string"))
    counted = docs.select("text").mapInArrow(partial(_document_counts, bits=_bits_of(item_words)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counted.join(item_words.select("word").distinct().union(documents.sparkSession.createDataFrame([("",)], "word string")), "word", "left_semi"))
    limit = max(RARE_LEAST, RARE_DOCS * (counts.where("word = ''").agg(F.sum("n")).head()[0] or 0))

    shared = item_words.groupBy("word").agg(F.count(F.lit(1)).alias("n_items"))
    own = F.col("n_items") <= max(1, OWN_SHARE * wanted.count())

    def ranks(leaks: DataFrame | None) -> DataFrame:
        rows = item_words.join(counts, "word", "left").join(shared.select("word", own.alias("own")), "word")
        rows = rows.withColumn("leaks", F.lit(0)) if leaks is None else rows.join(leaks, ["item_key", "word"], "left")
        lists = rows.groupBy("item_key").agg(F.collect_list(F.struct("word", "n", F.col("leaks").cast("bigint").alias("leaks"), "own")).alias("counts"))
        return cut(wanted.join(lists, "item_key").select("item_key", "item_id", "text", "counts").mapInArrow(partial(_rank, limit=limit), _RANKED))

    first = ranks(None)
    suspects = first.where(F.size("suspects") > 0)
    leaks = _joined(docs, suspects, suspects=True).mapInArrow(partial(_judge, leaks=True), "doc_id bigint, item_key bigint, word string")
    times = leaks.distinct().groupBy("item_key", "word").agg(F.count(F.lit(1)).alias("leaks"))
    final = ranks(times) if suspects.limit(1).count() else first
    return _joined(docs, final).mapInArrow(partial(_judge, leaks=False), "doc_id bigint, item_key bigint, item_id bigint").select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_docs) of every item, 0 for those that did not leak."""
    leaks = leaked_items(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").distinct().join(leaks, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))
