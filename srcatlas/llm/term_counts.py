"""Frequency of every distinct term (problem 3): burst-trie counting.

Postings are dealt out by file, so that a posting delivered twice is met by one worker; a file with very many is split by term. Each
worker adds up occurrences and files per term in a compact burst trie and hands on the trie's subtrees, each as one row: the prefix its
terms share and the sorted rest of them with their counters. Subtrees are routed by adaptive prefixes, short ones where few terms
share them and longer ones where many do, and matching subtrees of different workers are merged in a trie again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.plans.runtime import checked_broadcast, cut, shuffle_partitions

#: A term in fewer files is rare; one in more than this share of its index's files is common.
RARE_BELOW, COMMON_SHARE = 3, 0.2
#: Terms in a trie leaf before it bursts into one leaf per next character; terms in a trie before it is emptied.
LEAF, TRIE = 4096, 1_000_000
#: Postings that are gathered before their terms are added to the trie.
GATHERED = 1 << 17
#: Postings of one file from which it is split over several workers, and so many go to each.
SPLIT_FROM = 1_000_000
#: Terms that one route may hold before its prefix is made longer.
ROUTED = 250_000


class BurstTrie:
    """Terms with two counters. A leaf is a dict of suffixes; beyond LEAF entries it bursts into a node with one leaf per next character."""

    def __init__(self, leaf: int = LEAF) -> None:
        self.leaf, self.size, self.root = leaf, 0, {}
        self.nodes: set[int] = set()

    def add(self, term: str, occurrences: int, files: int) -> None:
        node, at = self.root, 0
        while id(node) in self.nodes:
            key = term[at : at + 1]
            child = node.get(key)
            if child is None:
                child = node[key] = {}
            node, at = child, at + 1
            if not key:
                break
        suffix = term[at:]
        got = node.get(suffix)
        if got is not None:
            got[0] += occurrences
            got[1] += files
            return
        node[suffix] = [occurrences, files]
        self.size += 1
        if len(node) > self.leaf and id(node) not in self.nodes and at < len(term):
            self._burst(node)

    def _burst(self, node: dict) -> None:
        held = list(node.items())
        node.clear()
        self.nodes.add(id(node))
        for suffix, counters in held:
            node.setdefault(suffix[:1], {})[suffix[1:]] = counters

    def leaves(self, node: dict | None = None, prefix: str = "") -> Iterator[tuple[str, dict]]:
        """(prefix, leaf) of every leaf, the subtrees that have not burst."""
        node = self.root if node is None else node
        if id(node) not in self.nodes:
            if node:
                yield prefix, node
            return
        for key in sorted(node):
            yield from self.leaves(node[key], prefix + key)

    def subtree(self) -> Iterator[tuple[str, int, int]]:
        """All terms with their counters, in order."""
        for prefix, leaf in self.leaves():
            for suffix in sorted(leaf):
                yield prefix + suffix, *leaf[suffix]


#: A subtree as a row: `tails` are the sorted rests of its terms behind the prefix.
_SUBTREE = "index_no int, prefix string, n bigint, tails array<string>, occurrences array<bigint>, files array<bigint>"


def _subtrees(tries: dict[int, BurstTrie]) -> Iterator[pa.RecordBatch]:
    rows = []
    for number, trie in tries.items():
        for prefix, leaf in trie.leaves():
            tails = sorted(leaf)
            rows.append((number, prefix, len(tails), tails, [leaf[t][0] for t in tails], [leaf[t][1] for t in tails]))
    types = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for i in range(0, len(rows), 64):  # a leaf is bounded, so is a batch
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), types)], names=["index_no", "prefix", "n", "tails", "occurrences", "files"])
    tries.clear()


def _distinct(index: np.ndarray, file_id: np.ndarray, term: pa.Array, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of postings each (index, file, term) once with its most hits, added up by (index, term): (index, -, terms, occurrences, files)."""
    coded = pc.dictionary_encode(term)
    code, terms = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    order = np.lexsort((code, file_id, index))
    index, file_id, code, hits = index[order], file_id[order], code[order], hits[order]
    new = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (file_id[1:] != file_id[:-1]) | (code[1:] != code[:-1])])
    most = np.maximum.reduceat(hits, new)
    key = index[new].astype(np.int64) * len(terms) + code[new]
    number, at = np.unique(key, return_inverse=True)
    return number // len(terms), number % len(terms), terms, np.bincount(at, most, len(number)).astype(np.int64), np.bincount(at, minlength=len(number))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (index_no, file_id), a file's (or its part's) all in this task: counts per term, as subtrees.

    A known file's rows begin with one without term; the rows of other files do not count. What is gathered is counted up to the last whole file; the file at the edge waits for its other rows.
    """
    tries: dict[int, BurstTrie] = {}
    held: list[pa.RecordBatch] = []
    waiting = 0

    def add(rows: pa.Table) -> None:
        index, file_id = rows.column("index_no").to_numpy(), rows.column("file_id").to_numpy()
        mark = rows.column("term").is_null().to_numpy()
        first = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (file_id[1:] != file_id[:-1])])
        rows = rows.filter(pa.array(np.repeat(mark[first], np.diff(np.r_[first, len(index)])) & ~mark))
        if not len(rows):
            return
        index, file_id, hits = (rows.column(c).to_numpy() for c in ("index_no", "file_id", "n_hits"))
        numbers, at, terms, occurrences, files = _distinct(index, file_id, rows.column("term").combine_chunks(), hits)
        names = terms.take(pa.array(at)).to_pylist()
        for number, term, n, c in zip(numbers.tolist(), names, occurrences.tolist(), files.tolist()):
            trie = tries.get(number)
            if trie is None:
                trie = tries[number] = BurstTrie()
            trie.add(term, n, c)

    limit = GATHERED
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        waiting += batch.num_rows
        if waiting < limit:
            continue
        rows = pa.Table.from_batches(held)
        index, file_id = rows.column("index_no").to_numpy(), rows.column("file_id").to_numpy()
        whole = np.flatnonzero((index != index[-1]) | (file_id != file_id[-1]))
        edge = int(whole[-1]) + 1 if len(whole) else 0
        if edge:
            add(rows.slice(0, edge))
        held, waiting = rows.slice(edge).to_batches(), len(rows) - edge
        limit = max(GATHERED, 2 * waiting)
        if sum(t.size for t in tries.values()) > TRIE:
            yield from _subtrees(tries)
    if held:
        add(pa.Table.from_batches(held))
    yield from _subtrees(tries)


def _routed(batches: Iterator[pa.RecordBatch], longer: set[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """Subtrees as routes ask for them: (route, index_no, prefix, ...). A subtree whose prefix is shorter than its route's is cut into several."""
    most = max((len(p) for _, p in longer), default=-1)

    def route(number: int, term: str) -> str:
        at = 0
        while at <= most and (number, term[:at]) in longer and at < len(term):
            at += 1
        return term[:at]

    names = ["route", "index_no", "prefix", "tails", "occurrences", "files"]
    types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for batch in batches:
        rows = []
        for number, prefix, tails, occurrences, files in zip(*(batch.column(c).to_pylist() for c in ("index_no", "prefix", "tails", "occurrences", "files"))):
            whole = route(number, prefix)
            if (number, whole) not in longer:
                rows.append((whole, number, prefix, tails, occurrences, files))
                continue
            parts: dict[str, list[int]] = {}
            for i, tail in enumerate(tails):
                parts.setdefault(route(number, prefix + tail), []).append(i)
            for to, which in parts.items():
                rows.append((to, number, prefix, [tails[i] for i in which], [occurrences[i] for i in which], [files[i] for i in which]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (index_no, route): the subtrees of one route are merged in one trie, then its terms are handed on."""
    current, trie = None, BurstTrie()

    def flush() -> Iterator[pa.RecordBatch]:
        rows = list(trie.subtree())
        for i in range(0, len(rows), 50_000):
            terms, occurrences, files = zip(*rows[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array([current[0]] * len(terms), pa.int32()), pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(files, pa.int64())], names=["index_no", "term", "occurrences", "n_files"])

    for batch in batches:
        for number, route, prefix, tails, occurrences, files in zip(*(batch.column(c).to_pylist() for c in ("index_no", "route", "prefix", "tails", "occurrences", "files"))):
            if (number, route) != current:
                yield from flush()
                current, trie = (number, route), BurstTrie()
            add = trie.add
            for tail, n, c in zip(tails, occurrences, files):
                add(prefix + tail, n, c)
    yield from flush()


def valid_postings(indexes: dict[str, DataFrame], trimmed: tuple[str, ...] = ("words",)) -> DataFrame:
    """(index_no, term, file_id, n_hits) of all indexes: terms in ASCII lower case, those of `trimmed` without outer blanks.

    Null terms and null files do not count; a null n_hits counts 0.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = None
    for number, (name, df) in enumerate(indexes.items()):
        term = F.translate("term", upper, lower)
        kept = df.where(F.col("term").isNotNull() & F.col("file_id").isNotNull())
        part = kept.select(F.lit(number).alias("index_no"), (F.trim(term) if name in trimmed else term).alias("term"), "file_id", F.coalesce(F.col("n_hits").cast("bigint"), F.lit(0)).alias("n_hits"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _long_prefixes(counted: DataFrame, partitions: int) -> set[tuple[int, str]]:
    """(index_no, prefix) of the prefixes that too many terms share, so that their terms are routed by longer ones.

    Two more letters are looked at per round, and only below prefixes that are too long themselves. A prefix of one length is over the
    share for at most (number of terms) / share of them, which is 4 * partitions or the number of terms by ROUTED.
    """
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    share = max(1, min(ROUTED, total // (4 * partitions)))
    if total <= share:
        return set()
    terms = counted.select("index_no", "prefix", F.explode("tails").alias("tail")).select("index_no", F.concat("prefix", "tail").alias("term"))
    longer = {(r["index_no"], "") for r in counted.groupBy("index_no").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()}
    found, at = longer, 0
    while found:
        below = counted.sparkSession.createDataFrame(sorted(found), "index_no int, begin string")
        some = terms.withColumn("begin", F.substring("term", 1, at)).join(F.broadcast(below), ["index_no", "begin"], "left_semi").where(F.length("term") > at)
        prefixes = F.array_distinct(F.array(F.substring("term", 1, at + 1), F.substring("term", 1, at + 2)))
        loads = some.select("index_no", F.explode(prefixes).alias("prefix")).groupBy("index_no", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
        hot = {(r["index_no"], r["prefix"]) for r in loads.collect()}
        longer = longer | hot
        at += 2
        found = {x for x in hot if len(x[1]) == at}
    return longer


def term_counts(indexes: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(index_name, term, occurrences, n_files, mark) of every distinct term of every index.

    Postings of files not in `files` do not count; a posting delivered more than once counts once, with its greatest n_hits. mark is
    rare, common or '' (see RARE_BELOW and COMMON_SHARE, the share being of the files with a valid posting in that index).
    Empty indexes give no rows.
    """
    spark = files.sparkSession
    partitions = shuffle_partitions(spark)
    rows = valid_postings(indexes)
    known = files.select("file_id").where(F.col("file_id").isNotNull()).distinct()
    # one row per file and index: how many files there are, and which have to be split
    per_file = cut(rows.groupBy("index_no", "file_id").agg(F.count(F.lit(1)).alias("n")).join(known, "file_id", "left_semi"))
    sizes = {r["index_no"]: r["n"] for r in per_file.groupBy("index_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = per_file.select("index_no", "file_id", F.ceil(F.col("n") / SPLIT_FROM).cast("int").alias("parts"))
    # files of more than SPLIT_FROM postings, of which there are at most (number of postings) / SPLIT_FROM
    split = checked_broadcast(parts.where("parts > 1"))
    part = F.pmod(F.xxhash64("term"), F.coalesce("parts", F.lit(1))).cast("int")
    postings = rows.join(split, ["index_no", "file_id"], "left").select("index_no", "file_id", part.alias("part"), "term", "n_hits")
    marks = parts.select("index_no", "file_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n_hits"))
    dealt = postings.unionByName(marks).repartition(partitions, "index_no", "file_id", "part").sortWithinPartitions("index_no", "file_id", F.col("term").isNotNull())
    counted = cut(dealt.select("index_no", "file_id", "term", "n_hits").mapInArrow(_count, _SUBTREE))
    longer = _long_prefixes(counted, partitions)
    routed = counted.mapInArrow(partial(_routed, longer=longer), "route string, index_no int, prefix string, tails array<string>, occurrences array<bigint>, files array<bigint>")
    merged = (
        routed.repartition(partitions, "index_no", "route").sortWithinPartitions("index_no", "route")
        .mapInArrow(_merge, "index_no int, term string, occurrences bigint, n_files bigint")
    )
    names = list(indexes)
    common = F.lit(False)
    for number in range(len(names)):
        common = common | ((F.col("index_no") == number) & (F.col("n_files") > COMMON_SHARE * sizes.get(number, 0)))
    mark = F.when(F.col("n_files") < RARE_BELOW, "rare").when(common, "common").otherwise("")
    name = F.array(*map(F.lit, names))[F.col("index_no")]
    return merged.select(name.alias("index_name"), "term", "occurrences", "n_files", mark.alias("mark"))
