"""Evaluation texts leaking into a corpus, by latent semantic retrieval of passages.

1. Items are cut into pieces of PIECE words, and pieces are taken in groups whose words one pass over the corpus can look
   for, so all that is shared with the tasks is bounded in bytes, whatever the number and the length of the items.
2. The pass over the corpus tokenizes every text once, counts the documents of each item word, and keeps what could hold a
   leak at all: the stretches of item words as long as a run or, for paraphrases, the passages with as many words of one
   item passage as its longest common subsequence must have.
3. For blocks of pieces a randomised SVD of the TF-IDF passages kept of the corpus and of the items', the weights being of
   the whole corpus, is computed in two distributed passes over them: random projection, and one power iteration, each
   adding up the tasks' partial products.
4. Passages are projected into the latent space and candidates found by their cosine. For leaks as they stand a passage is
   a run of words, and equal runs have the same vector in any space, so the search for coinciding vectors loses none,
   whatever the rank. For paraphrases passages of a cosine of `least_cosine` are candidates.
5. Candidates are checked: equal runs for a leak as it stands; the longest common subsequence and, for items with answers,
   the answer for a paraphrase.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Words of an item's passage, and by how many the next one begins later.
WINDOW, STRIDE = 32, 16
#: Words of a corpus passage, by the length of the item's: each in quarters, one of which lies between two passages.
WIDTHS = (8, 16, 32)
#: Words in a row that make a leak (a shorter item is one as a whole).
RUN = 13
#: Words of a piece of an item; words of the items that one pass over the corpus looks for, and of a block.
PIECE, GROUP_WORDS, BLOCK_WORDS = 4096, 500_000, 30_000
#: Rank of the latent space of paraphrases and of runs, and columns beside it.
RANK, RUN_RANK, OVERSAMPLE = 448, 64, 32
#: Quarters of passages of a text whose words are counted at a time.
QUARTERS = 512
#: Vectors of the same words differ by rounding only.
SAME = 1e-5
#: Weights lie between 1 and TOP_WEIGHT.
TOP_WEIGHT = 2.0

# Soft hyphen and zero-width characters.
_invisible = re.compile("[" + "".join(map(chr, (0xAD, 0x180E, 0xFEFF))) + chr(0x200B) + "-" + chr(0x200F) + chr(0x202A) + "-" + chr(0x202E) + chr(0x2060) + "-" + chr(0x2064) + "]")
_word = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits, without invisible characters, composed and in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", _invisible.sub("", text))
    return _word.findall(text.lower())


def windows(ws: np.ndarray) -> list[np.ndarray]:
    return [ws[k : k + WINDOW] for k in range(0, max(1, len(ws) - STRIDE), STRIDE)]


def width_of(n: int) -> int:
    """The width of the corpus passages that an item passage of n words is compared with."""
    return next((w for w in WIDTHS if w >= n), WIDTHS[-1])


class Block:
    """Pieces (item, words in a row that make a leak, words) with their words as numbers, and their passages."""

    def __init__(self, pieces: list[tuple[int, int, list[str]]], answers: dict[int, list[str]] | None = None, run: int = RUN):
        said, self.run = answers or {}, run
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, _, ws in pieces for w in ws} | {w for ws in said.values() for w in ws}))}
        number = lambda ws: np.array([self.vocabulary[w] for w in ws], dtype=np.int32)
        self.pieces = [(i, n, number(ws)) for i, n, ws in pieces if ws]
        self.answers = {i: number(ws) for i, ws in said.items() if ws}
        # Words of items that are shorter than a run: those need fewer words in a row.
        self.short = sorted({w for _, n, ws in self.pieces if n < run for w in ws.tolist()})
        self.shortest = min((n for _, n, _ in self.pieces), default=run)
        self.passages = [(i, part) for i, _, ws in self.pieces for part in windows(ws)]

    def runs(self) -> dict[int, tuple[np.ndarray, list[set[int]]]]:
        """Length -> the distinct runs of that many words, and the items that hold each."""
        out: dict[int, dict[bytes, set[int]]] = {}
        for i, n, ws in self.pieces:
            held = out.setdefault(n, {})
            for k in range(len(ws) - n + 1):
                held.setdefault(ws[k : k + n].tobytes(), set()).add(i)
        return {n: (np.frombuffer(b"".join(d), dtype=np.int32).reshape(-1, n), list(d.values())) for n, d in out.items() if d}

    def postings(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, n, passages, lengths) of the passages compared with a width: those that hold word w are passages[first[w] :
        first[w] + n[w]]. The last word is any that no item has; it is in no passage."""
        mine = [p for _, p in self.passages if width_of(len(p)) == width]
        distinct = [np.unique(p) for p in mine]
        flat = np.concatenate(distinct) if mine else np.empty(0, dtype=np.int32)
        n = np.bincount(flat, minlength=len(self.vocabulary) + 1)
        owner = np.repeat(np.arange(len(mine)), [len(w) for w in distinct])
        return np.cumsum(n) - n, n, owner[np.argsort(flat, kind="stable")], np.array([len(p) for p in mine])


def _runs(flags: np.ndarray, n: int) -> np.ndarray:
    """Where n set flags in a row begin."""
    if len(flags) < n:
        return np.empty(0, dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(flags)])
    return np.flatnonzero(sums[n:] - sums[:-n] == n)


def _holding(block: Block, width: int, least_lcs: float):
    """The quarters of a text at which passages of a width begin that have, with the quarter before and the one behind,
    `least_lcs` of the words of an item's passage, whatever their order. The longest common subsequence can't be longer, so
    no passage that reaches it is lost, however much else is in it."""
    first, n, passages, lengths = block.postings(width)
    need, size, quarter = np.maximum(1, np.ceil(least_lcs * lengths - 1e-9)), len(lengths), width // 4

    def starts(ids: np.ndarray) -> np.ndarray:
        if not size:
            return np.empty(0, dtype=np.int64)
        many = max(1, -(-len(ids) // quarter) - 3)  # passages of the text
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        at = np.arange(many)
        good = known[np.minimum((at + 5) * quarter, len(ids))] - known[np.maximum((at - 1) * quarter, 0)] >= need.min()
        for lo in range(0, many, QUARTERS):
            hi = min(lo + QUARTERS, many)
            if not good[lo:hi].any():
                continue
            before = min(1, lo)
            part = ids[(lo - before) * quarter : (hi + 4) * quarter]
            held = n[part]
            ends = np.cumsum(held)
            which = passages[np.repeat(first[part] - ends + held, held) + np.arange(ends[-1] if len(ends) else 0)]
            row = np.repeat(np.arange(len(part)) // quarter + 1 - before, held)
            counts = np.bincount(row * size + which, minlength=(hi - lo + 5) * size).reshape(-1, size)
            sums = np.concatenate([np.zeros((1, size), dtype=np.int64), np.cumsum(counts, axis=0)])
            good[lo:hi] &= (sums[6:] - sums[:-6] >= need).any(axis=1)[: hi - lo]
        return np.flatnonzero(good)

    return starts


def _scan(block: Block, least_lcs: float | None):
    """Rows (doc, width, ids, null) of what the corpus may hold of leaks and (null, null, ids, counts) of a task's document
    frequencies. Without `least_lcs` those are the stretches of item words (width 0) and of short items' words (width 1);
    otherwise passages of each width with the quarter before and the one behind."""
    number = block.vocabulary.get
    is_short = np.zeros(len(block.vocabulary) + 1, dtype=bool)
    is_short[block.short] = True
    holding = {} if least_lcs is None else {w: _holding(block, w, least_lcs) for w in WIDTHS if any(width_of(len(p)) == w for _, p in block.passages)}

    def stretches(flags: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
        return ((a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least)

    def found(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if least_lcs is None:
            yield from ((0, ids[a:b]) for a, b in stretches(ids >= 0, block.run))
            if block.shortest < block.run:
                yield from ((1, ids[a:b]) for a, b in stretches(is_short[ids], block.shortest))
            return
        for width, starts in holding.items():
            q = width // 4
            padded = np.concatenate([np.full(q, -1, dtype=np.int32), ids, np.full(6 * q, -1, dtype=np.int32)])
            yield from ((width, padded[at * q : (at + 6) * q]) for at in starts(ids).tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(block.vocabulary), dtype=np.int64)
        for b in batches:
            docs, widths, parts = [], [], []
            for doc, text in zip(b["i"], b["t"], strict=True):
                ids = np.fromiter((number(w, -1) for w in words_of(text)), dtype=np.int32)
                counts[np.unique(ids[ids >= 0])] += 1
                for width, part in found(ids):
                    docs.append(doc)
                    widths.append(width)
                    parts.append(part)
            if docs:
                yield pd.DataFrame({"i": pd.Series(docs, dtype=b["i"].dtype), "width": widths, "ids": parts, "n": [None] * len(docs)})
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pd.DataFrame({"i": [None], "width": [None], "ids": [seen.astype(np.int32)], "n": [counts[seen]]})

    return run


def _rows(parts: list[np.ndarray], weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The passages' weighted term vectors, of unit length, times the basis. Words beyond the vocabulary are left out."""
    out = np.zeros((len(parts), basis.shape[1]), dtype=np.float32)
    for lo in range(0, len(parts), 128):
        chunk = parts[lo : lo + 128]
        flat = np.concatenate(chunk)
        owner = np.repeat(np.arange(len(chunk)), [len(c) for c in chunk])
        owner, flat = owner[flat >= 0], flat[flat >= 0]
        if not len(flat):
            continue
        # Term frequency: a word met again in the passage adds its weight again.
        norm = np.zeros(len(chunk))
        pair, n = np.unique(owner * np.int64(len(weight)) + flat, return_counts=True)
        np.add.at(norm, pair // len(weight), (n * weight[pair % len(weight)]) ** 2)
        values = basis[flat] * weight[flat][:, None]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[lo + owner[first]] = np.add.reduceat(values, first, axis=0) / np.sqrt(norm[owner[first]])[:, None]
    return out


def _gram_product(passages: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis, A having a row for each passage: every task adds up its rows' products, slabs of words are
    added up across the tasks. `basis` is bounded by the block's vocabulary and the rank."""
    slab, size, width = 256, len(weight), basis.shape[1]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, width), dtype=np.float32)
        for b in batches:
            for lo in range(0, len(b), 256):
                rows = [x[x >= 0] for x in (np.asarray(y, dtype=np.int32) for y in b["ids"].iloc[lo : lo + 256])]
                if not (rows := [x for x in rows if len(x)]):
                    continue
                to = _rows(rows, weight, basis)
                flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
                pair, n = np.unique(owner * np.int64(size) + flat, return_counts=True)
                norm = np.sqrt(np.bincount(pair // size, weights=(n * weight[pair % size]) ** 2))
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                total[flat[first]] += np.add.reduceat(to[owner] * (weight[flat] / norm[owner]).astype(np.float32)[:, None], first, axis=0)
        yield pd.DataFrame([(k, total[lo : lo + slab].tobytes()) for k, lo in enumerate(range(0, size, slab))], columns=["k", "v"])

    def add(a: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": a["k"].iloc[:1], "v": [sum(np.frombuffer(v, dtype=np.float32) for v in a["v"]).astype(np.float32).tobytes()]})

    got = passages.mapInPandas(part, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect()
    return np.concatenate([np.frombuffer(r.v, dtype=np.float32).reshape(-1, width) for r in sorted(got, key=lambda r: r.k)])


def latent_space(passages: DataFrame, weight: np.ndarray, n_passages: int, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (vocabulary x rank) of the passages' TF-IDF matrix, by randomised subspace
    iteration with a fixed seed."""
    size = len(weight)
    rank = min(rank, size, n_passages)
    width = min(rank + OVERSAMPLE, size)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((size, width)))[0].astype(np.float32)
    basis = np.linalg.qr(_gram_product(passages, weight, basis))[0].astype(np.float32)
    values, vectors = np.linalg.eigh((lambda m: (m + m.T) / 2)(basis.T @ _gram_product(passages, weight, basis)))
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (b == x)))
    return int(row[-1])


def run_vectors(ids: np.ndarray, weight: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The latent vectors of runs (a row of words each) of unit length before projection. Words are taken in order of their
    number, so runs of the same words have the same vector."""
    ids = np.sort(ids, axis=1)
    w = weight[ids].astype(np.float32)
    norm = np.sqrt(((ids[:, :, None] == ids[:, None, :]) * (w**2)[:, :, None]).sum(axis=(1, 2)))
    return np.einsum("rn,rnk->rk", w / norm[:, None], space[ids])


def _coinciding(a: np.ndarray, order: np.ndarray, key: np.ndarray, axis: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of b, rows of a) of equal vectors, found by their place along an axis; key is a's, sorted by order."""
    lo, hi = np.searchsorted(key, b[:, axis] - SAME), np.searchsorted(key, b[:, axis] + SAME, side="right")
    n = hi - lo
    left = np.repeat(np.arange(len(b)), n)
    right = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    near = np.abs(a[right] - b[left]).max(axis=1, initial=0) <= SAME
    return left[near], right[near]


def _same_runs(block: Block, weight: np.ndarray, space: np.ndarray, to_block: np.ndarray):
    """Candidates whose vector coincides with that of a run of an item (cosine 1), checked word by word."""
    targets = {}
    for n, (ids, items) in block.runs().items():
        vectors = np.concatenate([run_vectors(ids[k : k + 4096], weight, space) for k in range(0, len(ids), 4096)])
        axis = int(vectors.var(axis=0).argmax())
        order = np.argsort(vectors[:, axis])
        targets[n] = (ids, items, vectors, order, vectors[order, axis], axis)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, (ids, items, vectors, order, key, axis) in targets.items():
                docs, runs = [], []
                for doc, width, part in zip(b["i"], b["width"], b["ids"], strict=True):
                    if len(part) < n or (width == 1) != (n < block.run):
                        continue
                    w = np.lib.stride_tricks.sliding_window_view(to_block[np.asarray(part, dtype=np.int32)], n)
                    w = w[(w >= 0).all(axis=1)]
                    docs += [doc] * len(w)
                    runs.append(w)
                held = np.concatenate(runs) if docs else np.empty((0, n), dtype=np.int32)
                for lo in range(0, len(held), 4096):
                    mine = held[lo : lo + 4096]
                    v = run_vectors(mine, weight, space)
                    left, right = _coinciding(vectors, order, key, axis, v)
                    equal = (mine[left] == ids[right]).all(axis=1)
                    out += {(docs[lo + a], i) for a, t in zip(left[equal].tolist(), right[equal].tolist(), strict=True) for i in items[t]}
            out = list(dict.fromkeys(out))
            yield pd.DataFrame({"doc": pd.Series([d for d, _ in out], dtype=b["i"].dtype), "item": pd.Series([i for _, i in out], dtype="int64"), "cosine": 1.0, "lcs": 1.0, "answered": None}).astype({"answered": "boolean"})

    return run


def _similar(block: Block, weight: np.ndarray, space: np.ndarray, to_block: np.ndarray, least: float, least_lcs: float):
    """Candidates by cosine with an item's passage, checked by the longest common subsequence and the answer."""
    targets = {}
    for w in WIDTHS:
        mine = [(i, p) for i, p in block.passages if width_of(len(p)) == w]
        if mine:
            targets[w] = (mine, _unit(_rows([p for _, p in mine], weight, space)).T.copy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[tuple, tuple] = {}
            for width, (mine, vectors) in targets.items():
                rows = b[b["width"] == width]
                docs, parts = rows["i"].tolist(), [to_block[np.asarray(x, dtype=np.int32)] for x in rows["ids"]]
                q = width // 4
                for lo in range(0, len(parts), 1024):
                    close = _unit(_rows([p[q : 5 * q] for p in parts[lo : lo + 1024]], weight, space)) @ vectors
                    for r, h in zip(*(x.tolist() for x in np.nonzero(close >= least)), strict=True):
                        (item, passage), part = mine[h], parts[lo + r]
                        lcs = common_subsequence(passage, part) / len(passage)
                        if lcs < least_lcs - 1e-9:
                            continue
                        answer = block.answers.get(item)
                        said = None if answer is None else any((part[k : k + len(answer)] == answer).all() for k in range(len(part) - len(answer) + 1))
                        c, best, seen = out.get((docs[lo + r], item), (0.0, 0.0, None))
                        out[docs[lo + r], item] = (max(c, float(close[r, h])), max(best, lcs), said if seen is None else seen or bool(said))
            yield pd.DataFrame([(d, i, *v) for (d, i), v in out.items()], columns=["doc", "item", "cosine", "lcs", "answered"]).astype({"item": "int64", "cosine": "float64", "lcs": "float64", "answered": "boolean"})

    return run


def _pieces(items: DataFrame, item_id: str, item_text: str, run: int) -> DataFrame:
    """(item, piece, run, words): items with a word in pieces of PIECE words, which overlap by what no passage or run exceeds."""
    step = PIECE - max(run, WINDOW)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["i"], b["t"], strict=True):
                ws = words_of(t)
                out += [(i, k, min(run, len(ws)), ws[at : at + PIECE]) for k, at in enumerate(range(0, max(1, len(ws) - max(run, WINDOW)), step)) if ws]
            yield pd.DataFrame(out, columns=["item", "piece", "run", "words"])

    rows = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t <> ''")
    return rows.mapInPandas(cut, "item bigint, piece int, run int, words array<string>")


def _parts(rows: DataFrame, salt: int, measure, most: int) -> tuple[DataFrame, int]:
    """`rows` with `part`, in as many parts by hash as it takes for none to exceed `most` by the measure."""
    n = 1
    while True:
        cut = rows.withColumn("part", F.pmod(F.xxhash64("item", "piece", F.lit(salt)), F.lit(n)).cast("int"))
        largest = measure(cut).agg(F.max("m").alias("m")).first().m or 0
        if largest <= most or n > 1 << 20:
            return cut, n if largest else 0
        n *= 2


def _words(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").agg(F.sum(F.size("words")).alias("m"))


def _distinct_words(rows: DataFrame) -> DataFrame:
    return rows.select("part", F.explode("words").alias("w")).groupBy("part").agg(F.countDistinct("w").alias("m"))


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, exact: bool = True, run: int = RUN,
                 least_cosine: float = 0.6, least_lcs: float = 0.6, rank: int | None = None, item_answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine[, lcs[, answered]]) of every document with a passage of an item.

    `exact`: document and item share `run` words in a row, or all words of a shorter item. Otherwise passages with a
    cosine of `least_cosine` and a longest common subsequence of `least_lcs` of the item's passage, counting a quarter of
    a passage before and behind: paraphrases, and leaks as they stand, of short items in other text, too; `cosine` and
    `lcs` are the largest of the passages found. With the column `item_answer` of the items, `answered` tells whether the
    answer's words stand in a row in such a passage (null for an item without an answer).

    Null and empty texts hold nothing, items without a word leak nowhere, ids must be unique and not null. Further
    columns are not read; empty tables give no rows. Whole texts are read, whatever their length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leakage")
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t <> ''")
    pieces = scratch.save(_pieces(items, item_id, item_text, run))
    said = scratch.save(_pieces(items, item_id, item_answer, run)) if item_answer and not exact else None
    # Passes over the corpus: stretches need the words only, paraphrases the words of every passage.
    pieces, groups = _parts(pieces, 1, _distinct_words if exact else _words, GROUP_WORDS)
    total, out = None, None
    for g in range(groups):
        mine = pieces.where(F.col("part") == g).drop("part")
        rows = mine.collect() if not exact else mine.select("run", F.array_distinct("words").alias("words")).groupBy("run").agg(F.array_distinct(F.flatten(F.collect_set("words"))).alias("words")).collect()
        answers = {} if said is None else {r.item: r.words for r in said.join(mine.select("item").distinct(), "item", "left_semi").where("piece = 0").collect()}
        group = Block([(0 if exact else r.item, r.run, r.words) for r in rows], answers, run)
        if not group.pieces:
            continue
        shared = spark.sparkContext.broadcast(group)  # bounded by GROUP_WORDS

        def scan(batches, shared=shared):
            return _scan(shared.value, None if exact else least_lcs)(batches)

        scanned = scratch.save(texts.mapInPandas(scan, f"i {kind}, width int, ids array<int>, n array<bigint>"))
        total = texts.count() if total is None else total
        counts = np.ones(len(group.vocabulary))
        for r in scanned.where("n is not null").select(F.explode(F.arrays_zip("ids", "n")).alias("z")).groupBy("z.ids").agg(F.sum("z.n").alias("n")).toLocalIterator():
            counts[r.ids] = r.n  # a row for each word of the group at most
        weights = (1 + (TOP_WEIGHT - 1) * np.log(max(total, 1) / counts) / np.log(max(total, 2))).astype(np.float32)
        kept = scanned.where("n is null").select("i", "width", "ids")
        cut, blocks = _parts(mine, 2, _words, BLOCK_WORDS)
        cut = scratch.save(cut)
        for k in range(blocks):
            held = cut.where(F.col("part") == k).collect()
            block = Block([(r.item, r.run, r.words) for r in held], {r.item: answers[r.item] for r in held if r.item in answers}, run)
            to_block = np.full(len(group.vocabulary) + 1, -1, dtype=np.int32)  # the last is any other word
            for w, n in block.vocabulary.items():
                to_block[group.vocabulary[w]] = n
            weight = np.empty(len(block.vocabulary), dtype=np.float32)
            weight[to_block[to_block >= 0]] = weights[np.flatnonzero(to_block >= 0)]
            lent = spark.sparkContext.broadcast(to_block)

            def passages(batches, lent=lent):
                for b in batches:
                    parts = [lent.value[np.asarray(x, dtype=np.int32)] for x in b["ids"]]
                    yield pd.DataFrame({"ids": [p for x in parts for p in windows(x)]})

            own = spark.createDataFrame(pd.DataFrame({"ids": [p.tolist() for _, p in block.passages]}), "ids array<int>")
            corpus = kept.mapInPandas(passages, "ids array<int>")
            r = rank or (RUN_RANK if exact else RANK)
            # More passages than the rank in any case, as far as it is the rank of their matrix that counts.
            space = latent_space(corpus.unionByName(own), weight, max(r, len(block.passages)), r)
            model = spark.sparkContext.broadcast((block, weight, space, to_block))  # bounded by BLOCK_WORDS and the rank

            def search(batches, model=model):
                return (_same_runs(*model.value) if exact else _similar(*model.value, least_cosine, least_lcs))(batches)

            found = kept.mapInPandas(search, f"doc {kind}, item bigint, cosine double, lcs double, answered boolean")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"doc {kind}, item bigint, cosine double, lcs double, answered boolean")
    best = out.groupBy("doc", "item").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answered").alias("answered"))
    cols = [F.col("doc").alias(doc_id), F.col("item").alias(item_id), "cosine"]
    return best.select(*cols, *([] if exact else ["lcs"]), *(["answered"] if item_answer and not exact else []))
