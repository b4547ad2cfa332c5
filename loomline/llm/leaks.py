"""Evaluation texts leaking into training text.

Method: latent semantic retrieval. Passages (windows of words) are TF-IDF vectors over hashed words; a randomised SVD, computed
distributedly by two passes of subspace iteration over all passages, gives a latent space of RANK dimensions. The windows of the
evaluation items are indexed there by their nearest centroids (`WindowIndex`); each passage of the corpus looks up the windows of its
nearest centroids, and those above a cosine make (document, item) candidates. A candidate pair is then compared word by word: the longest
common run decides on leaks, the longest common subsequence and the item's own numbers and names (its answers) on paraphrases.

For leaks every run of RUN words of a document and of an item is a passage. A run that both hold has one vector and so one nearest
centroid and a cosine of 1: no threshold, rank or weighting can lose it. Runs with a word that no item has can't be equal to an item's
and are not projected. For paraphrases all passages are, and PROBES centroids are looked up.

What moves: the accumulators of the SVD are DIMENSIONS x RANK numbers per task, whatever the corpus holds. The items are the query side.
They are taken in blocks of at most MOST_ITEM_CHARS characters, each of which is indexed and sent to every task. Documents stay in their
partitions; only (doc_id, item_id) rows of candidates leave them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical_text import canonical
from .hashing import HASHES, mix, shingles_of, slices
from .storage import checkpointed

DIMENSIONS, RANK = 8192, 48
#: Consecutive words that make a leak.
RUN = 12
#: Words of the passages that the SVD is fitted on.
PASSAGE = 18
#: Passages begin at every word for leaks, and at every STRIDE-th word for paraphrases.
STRIDE = 3
#: Latent cosine from which a passage and an item window make a candidate: of leaks, whose windows are equal, and of paraphrases.
SAME, ALIKE = 0.999, 0.8
#: Centroids that a passage looks up for paraphrases.
PROBES = 4
#: Characters of items that are indexed and sent at once.
MOST_ITEM_CHARS = 1_000_000
#: Passages are projected and looked up in chunks of this many.
_CHUNK = 16_384


def reader_words(text: str | None) -> list[str]:
    """Runs of letters and digits as a reader sees them, without case."""
    return re.findall(r"[^\W_]+", canonical()(text).casefold()) if text else []


class _Tokens(dict):
    """A run of text without blanks -> hashes of the reader's words in it; runs recur, so most are looked up."""

    MOST = 500_000

    def __missing__(self, run: str) -> tuple[int, ...]:
        if len(self) >= self.MOST:
            self.clear()
        value = self[run] = tuple(HASHES[w] for w in reader_words(run))
        return value


_TOKENS = _Tokens()
#: Characters that split() takes for blanks, but which show nothing and so do not part words.
_JOINING = re.compile("[\x1c-\x1f\x85]")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the reader's words of all texts, their number per text); blanks part words in any form of a text."""
    get, parts, counts = _TOKENS.__getitem__, [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        before = len(parts)
        if text and _JOINING.search(text):
            parts.extend(HASHES[w] for w in reader_words(text))
        elif text:
            parts.extend(chain.from_iterable(map(get, text.split())))
        counts[i] = len(parts) - before
    return np.array(parts, dtype=np.uint64), counts


def dimension_of(words: np.ndarray) -> np.ndarray:
    return (mix(words) >> np.uint64(40)).astype(np.int64) % DIMENSIONS


def windows(counts: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Rows of word positions of the passages of all texts, -1 where a text is shorter."""
    first, n, _ = passages_of(counts, size, stride)
    index = first[:, None] + np.arange(size)
    index[np.arange(size) >= n[:, None]] = -1
    return index


def _weighted(dims: np.ndarray, index: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = dims[index]
    weight = np.where(index >= 0, idf[at], 0).astype(np.float32)
    norm = np.sqrt((weight * weight).sum(axis=1, keepdims=True))
    return at, weight / np.maximum(norm, 1e-9)


def project(dims: np.ndarray, first: np.ndarray, size: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Unit rows of passages in the latent space: `size` words from `first` on; weighted: the basis with its rows times their idf.

    A passage is a range of words, so its row is a difference of running sums over the words' rows; where passages are few and far
    between, the rows are added up one by one.
    """
    out = np.zeros((len(first), weighted.shape[1]), dtype=np.float32)
    for i in range(0, len(first), _CHUNK):
        at, n = first[i : i + _CHUNK], size[i : i + _CHUNK]
        low, high = int(at.min()), int((at + n).max())
        if high - low > int(n.sum()):
            for j in range(int(n.max())):
                held = np.flatnonzero(n > j)
                out[i + held] += weighted[dims[at[held] + j]]
            continue
        sums = np.zeros((high - low + 1, weighted.shape[1]))
        np.cumsum(weighted[dims[low : low + len(sums) - 1]], axis=0, out=sums[1:])
        out[i : i + _CHUNK] = sums[at + n - low] - sums[at - low]
    return out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out))[:, None], 1e-9)


def passages_of(counts: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of the passages of each text; a shorter text is one passage, the last passage ends with its text."""
    if not counts.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    starts = np.cumsum(counts) - counts
    last = np.maximum(counts - size, 0)
    n = np.where(counts > 0, (last + stride - 1) // stride + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(k * stride, last[text])
    return starts[text] + at, np.minimum(counts[text], size), text


class WindowIndex:
    """Item windows (unit rows of the latent space) by their nearest centroids.

    Centroids come from a few rounds of spherical k-means. A window that is as near to several centroids, up to rounding, is kept under
    each, so that equal windows always meet. A centroid is passed over where the triangle inequality excludes all of its windows.
    """

    ROUNDING = 1e-3

    def __init__(self, windows: np.ndarray, of: np.ndarray) -> None:
        count = max(1, int(np.sqrt(len(windows))))
        self.centroids = windows[np.linspace(0, len(windows) - 1, count).astype(np.int64)].copy() if len(windows) else np.zeros((0, windows.shape[1]), dtype=np.float32)
        for _ in range(5 if len(windows) else 0):
            nearest = self._near(windows)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, nearest, windows)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            self.centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), self.centroids).astype(np.float32)
        rows, lists = [], []
        for i in range(0, len(windows), _CHUNK):
            close = windows[i : i + _CHUNK] @ self.centroids.T
            w, c = np.nonzero(close >= close.max(axis=1, keepdims=True) - self.ROUNDING)
            rows.append(w + i)
            lists.append(c)
        row, of_list = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, lists))
        order = np.lexsort((of[row], of_list))
        row, of_list = row[order], of_list[order]
        self.windows, self.of = np.ascontiguousarray(windows[row]), of[row]
        self.edges = np.searchsorted(of_list, np.arange(count + 1))
        cosine = np.einsum("ij,ij->i", self.windows, self.centroids[of_list]) if len(row) else np.zeros(0)
        self.radius = np.array([np.arccos(np.clip(cosine[a:b].min(), -1, 1)) if b > a else 0.0 for a, b in zip(self.edges[:-1], self.edges[1:])])

    def _near(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([(vectors[i : i + _CHUNK] @ self.centroids.T).argmax(axis=1) for i in range(0, len(vectors), _CHUNK)])

    def search(self, passages: np.ndarray, cosine: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of the windows above the cosine under the passages' nearest centroids."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.windows) or not len(passages):
            return none, none
        close = passages @ self.centroids.T
        probes = min(probes, close.shape[1])
        lists = close.argmax(axis=1)[:, None] if probes == 1 else np.argpartition(-close, probes - 1, axis=1)[:, :probes]
        row = np.repeat(np.arange(len(passages)), probes)
        at = lists.ravel()
        angle = np.arccos(np.clip(close[row, at], -1, 1))
        keep = angle <= self.radius[at] + np.arccos(cosine) + self.ROUNDING
        row, at = row[keep], at[keep]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        cuts = np.searchsorted(at, np.arange(len(self.centroids) + 1))
        found = []
        for c in np.flatnonzero(np.diff(cuts)):
            mine = row[cuts[c] : cuts[c + 1]]
            a, b = self.edges[c], self.edges[c + 1]
            i, j = np.nonzero(passages[mine] @ self.windows[a:b].T >= cosine)
            found.append(np.unique(np.stack((mine[i], self.of[a:b][j])), axis=1))
        return tuple(np.concatenate(found, axis=1)) if found else (none, none)


def gram(dims: np.ndarray, index: np.ndarray, idf: np.ndarray, basis: np.ndarray, into: np.ndarray) -> None:
    """Add A'A basis to into, A being the passages' TF-IDF rows."""
    for i in range(0, len(index), _CHUNK):
        at, weight = _weighted(dims, index[i : i + _CHUNK], idf)
        rows = np.einsum("nw,nwr->nr", weight, basis[at], optimize=False)
        flat = at.ravel()
        order = np.argsort(flat, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        spread = (weight[:, :, None] * rows[:, None, :]).reshape(len(flat), -1)[order]
        into[flat[order][cuts]] += np.add.reduceat(spread, cuts, axis=0)


def _sum_rows(df: DataFrame, shape: tuple[int, ...], dtype: str) -> np.ndarray:
    """Sum of the arrays that tasks return as (part, raw), one row per 512 rows; the result has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, dtype=dtype)
                sums[part] = sums[part] + x if part in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "raw"])

    total = np.zeros(shape, dtype=dtype)
    for row in df.repartition("part").mapInArrow(add, "part int, raw binary").collect():
        total[row.part * 512 : (row.part + 1) * 512] = np.frombuffer(row.raw, dtype=dtype).reshape(-1, *shape[1:])
    return total


def _parts(x: np.ndarray) -> pa.RecordBatch:
    at = range(0, len(x), 512)
    return pa.RecordBatch.from_arrays([pa.array([i // 512 for i in at], pa.int32()), pa.array([x[i : i + 512].tobytes() for i in at], pa.binary())], names=["part", "raw"])


def document_dimensions(documents: DataFrame) -> DataFrame:
    """(dims): per Arrow batch the hashed words of its documents and their counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(0).to_pylist()]
            for i, j in slices(texts):
                words, counts = word_hashes(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dimension_of(words).astype("<i2").tobytes()], pa.binary()), pa.array([counts.astype("<i4").tobytes()], pa.binary())], names=["dims", "counts"]
                )

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "dims binary, counts binary")


def _passages(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for raw, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        dims = np.frombuffer(raw, dtype="<i2").astype(np.int64)
        index = windows(np.frombuffer(sizes, dtype="<i4").astype(np.int64), PASSAGE, PASSAGE)
        if len(index):
            yield dims, index


def inverse_frequencies(stored: DataFrame) -> tuple[np.ndarray, int]:
    """(idf of every dimension, number of passages), counted over all passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 512, dtype=np.int64)  # the last part holds the number of passages
        for batch in batches:
            for dims, index in _passages(batch):
                at = np.where(index >= 0, dims[index], -1)
                at.sort(axis=1)
                new = np.ones(at.shape, dtype=bool)
                new[:, 1:] = at[:, 1:] != at[:, :-1]
                total[:DIMENSIONS] += np.bincount(at[new & (at >= 0)], minlength=DIMENSIONS)
                total[DIMENSIONS] += len(index)
        yield _parts(total)

    total = _sum_rows(stored.mapInArrow(count, "part int, raw binary"), (DIMENSIONS + 512,), "int64")
    passages = int(total[DIMENSIONS])
    return np.log((1.0 + passages) / (1.0 + total[:DIMENSIONS])).astype(np.float32) + 1, passages


@dataclass(frozen=True)
class Items:
    """A block of evaluation items: ids, texts, word hashes and their numbers."""

    ids: np.ndarray
    texts: list[str]
    words: np.ndarray
    counts: np.ndarray


def item_blocks(items: DataFrame) -> list[DataFrame]:
    """The items that have an id and a text, in blocks of about MOST_ITEM_CHARS characters by a hash of the item."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // MOST_ITEM_CHARS))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def query_items(block: DataFrame) -> Items:
    found = block.orderBy("item_id", "text").collect()
    words, counts = word_hashes([r.text for r in found])
    return Items(np.array([r.item_id for r in found], dtype=np.int64), [r.text for r in found], words, counts)


def latent_basis(stored: DataFrame, blocks: list[DataFrame], idf: np.ndarray, passages: int) -> np.ndarray:
    """Right singular vectors (DIMENSIONS x RANK) of the passages, with the items' passages weighted up to half of them."""
    item_words = 0
    for block in blocks:
        item_words += int(query_items(block).counts.sum())
    share = 0.5 * max(passages, 1) / max(item_words / PASSAGE, 1.0)
    basis = np.random.default_rng(11).standard_normal((DIMENSIONS, RANK)).astype(np.float32)
    context = stored.sparkSession.sparkContext
    for _ in range(2):
        basis = np.linalg.qr(basis)[0].astype(np.float32)
        sent, weights = context.broadcast(basis), context.broadcast(idf)  # fixed size

        def multiply(batches: Iterator[pa.RecordBatch], sent=sent, weights=weights) -> Iterator[pa.RecordBatch]:
            out = np.zeros((DIMENSIONS, RANK), dtype=np.float64)
            for batch in batches:
                for d, i in _passages(batch):
                    gram(d, i, weights.value, sent.value, out)
            yield _parts(out)

        product = _sum_rows(stored.mapInArrow(multiply, "part int, raw binary"), (DIMENSIONS, RANK), "float64")
        own = np.zeros((DIMENSIONS, RANK))
        for block in blocks:
            held = query_items(block)
            index = windows(held.counts, PASSAGE, PASSAGE)
            if len(index):
                gram(dimension_of(held.words), index, idf, basis, own)
        product += share * own
        last, basis = basis, product.astype(np.float32)
    values, vectors = np.linalg.eigh(last.T @ product)
    return (last @ vectors[:, ::-1]).astype(np.float32)


def longest_common_subsequence(a: list[str], b: list[str]) -> int:
    """Bit-parallel: one big-integer step per word of b."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for word in b:
        hit = free & places.get(word, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def answers_of(text: str) -> set[str]:
    """Numbers, and capitalised words inside a sentence, as a reader sees them."""
    return {w.casefold() for w in re.findall(r"\d+|(?<!^)(?<![.!?] )\b[A-ZÀ-ÞА-Я][^\W\d_]+", canonical()(text))}


def candidates(documents: DataFrame, items: DataFrame, retold: bool = False, cosine: float | None = None) -> DataFrame:
    """(doc_id, item_id, run, subsequence, answers): pairs of a document and an item with a passage above the cosine.

    run is RUN if they have as many consecutive words in common, else 0. Only where retold is set, passages need not be equal, and
    subsequence and answers are told of pairs without such a run. subsequence: longest common subsequence of words by the item's number
    of words, null where fewer than half of the answers are held; answers: share of the item's numbers and names that the document holds.
    """
    blocks = item_blocks(items)
    stored = checkpointed(document_dimensions(documents))
    idf, passages = inverse_frequencies(stored)
    weighted = (idf[:, None] * latent_basis(stored, blocks, idf, passages)).astype(np.float32)
    out = None
    for block in blocks:
        found = _search(documents, query_items(block), weighted, retold, cosine or (ALIKE if retold else SAME))
        out = found if out is None else out.unionByName(found)
    return out


def _search(documents: DataFrame, items: Items, weighted: np.ndarray, retold: bool, cosine: float) -> DataFrame:
    first, size, of = passages_of(items.counts, RUN, 1)
    if not retold:  # a shorter item has no run to leak
        first, size, of = (x[size == RUN] for x in (first, size, of))
    index = WindowIndex(project(dimension_of(items.words), first, size, weighted), of)
    h, sizes = shingles_of(items.words, items.counts, RUN)
    runs = [np.unique(r) for r in np.split(h, np.cumsum(sizes)[:-1])] if len(sizes) else []
    known_dims = np.zeros(DIMENSIONS, dtype=bool)
    known_dims[dimension_of(items.words)] = True
    sent = documents.sparkSession.sparkContext.broadcast((items.ids, items.texts if retold else [], index, weighted, runs, known_dims))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, index, weighted, runs, known_dims = sent.value
        known: dict[int, tuple[list[str], set[str]]] = {}
        all_runs = np.unique(np.concatenate(runs)) if runs else np.zeros(0, dtype=np.uint64)
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), ["" if t is None else t for t in batch.column("text").to_pylist()]
            for i, j in slices(texts):
                words, counts = word_hashes(texts[i:j])
                first, size, text = passages_of(counts, RUN, STRIDE if retold else 1)
                dims = dimension_of(words)
                if not retold and len(first):
                    strange = np.concatenate(([0], np.cumsum(~known_dims[dims])))
                    keep = strange[first + size] == strange[first]
                    first, size, text = first[keep], size[keep], text[keep]
                found: set[tuple[int, int]] = set()
                for k in range(0, len(first), _CHUNK):
                    at, q = index.search(project(dims, first[k : k + _CHUNK], size[k : k + _CHUNK], weighted), cosine, PROBES if retold else 1)
                    found.update(zip(text[k : k + _CHUNK][at].tolist(), q.tolist()))
                if not found:
                    continue
                h, sizes = shingles_of(words, counts, RUN)
                some = np.isin(h, all_runs)
                h, sizes = h[some], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
                ends = np.cumsum(sizes)
                out, last, own = [], -1, []
                for t, q in sorted(found):
                    if sizes[t] and np.isin(h[ends[t] - sizes[t] : ends[t]], runs[q]).any():
                        out.append((docs[i + t], int(ids[q]), RUN, None, None))
                        continue
                    if not retold:
                        out.append((docs[i + t], int(ids[q]), 0, None, None))
                        continue
                    if t != last:
                        last, own = t, reader_words(texts[i + t])
                    if q not in known:
                        known[q] = reader_words(items[q]), answers_of(items[q])
                    asked, named = known[q]
                    held = len(named.intersection(own)) / len(named) if named else 1.0
                    common = longest_common_subsequence(asked, own) / len(asked) if held >= 0.5 and asked else None
                    out.append((docs[i + t], int(ids[q]), 0, common, held))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["doc_id", "item_id", "run", "subsequence", "answers"])

    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, "doc_id long, item_id long, run int, subsequence double, answers double")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds at least RUN consecutive words of the item's text.

    Exact copies of a document count each, repeated rows of an item once. Null texts and texts or items of fewer than RUN words have no
    leak. Empty tables give no rows.
    """
    return candidates(documents, items).where(f"run >= {RUN}").select("doc_id", "item_id").distinct()


def paraphrases(documents: DataFrame, items: DataFrame, cosine: float = ALIKE, subsequence: float = 0.5) -> DataFrame:
    """(doc_id, item_id, subsequence, answers) of documents that retell an item without holding a run of it.

    They hold half of the item's numbers and names, and share a subsequence of half of its words. Everything is
    scored where the document is read, so no text is shuffled.
    """
    rows = candidates(documents, items, True, cosine).where(f"run < {RUN} AND subsequence >= {subsequence}")
    return rows.select("doc_id", "item_id", F.round("subsequence", 6).alias("subsequence"), F.round("answers", 6).alias("answers")).distinct()
