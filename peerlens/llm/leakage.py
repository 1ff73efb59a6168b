"""Evaluation texts inside a corpus (problem 9): latent semantic retrieval, then checks of runs and subsequences.

Passages are runs of ``WIDTH`` words. Words are weighted by TF-IDF over all passages
and all words of the corpus (words hash to ``COLUMNS`` columns, so no vocabulary is
built, broadcast or kept), a randomised singular value decomposition, computed in
distributed passes, gives every column a latent vector, and a passage is the sum of
its words' vectors. Vectors are whole numbers (fixed point), so equal passages have
equal latent vectors on any machine and in any order of summation. Candidates are
passages whose latent sign patterns agree and whose cosine is high; they are verified
by the common run of words. Paraphrases may miss two words, which no latent cosine
guarantees to find; they are met by the passage's rarest words, which does, and
verified by the longest common subsequence of words and the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.confusables import one_form, spread
from peerlens.runtime import durable

# Words of a passage: the shortest leak that counts.
WIDTH = 10
# Columns of the term space (a power of two), latent dimensions, extra dimensions of the random sketch, passes of power iteration.
COLUMNS, RANK, EXTRA, POWER = 1 << 13, 24, 8, 1
# Fixed-point scale of a latent coordinate.
SCALE = 1 << 16
# Words of the items in one block of queries; it bounds what is broadcast at once (some 60 MB).
BLOCK_WORDS = 400_000
# Cosine from which a candidate passage goes to verification.
EXACT_COSINE = 0.999
# A paraphrase shares this many words of an item passage, in order, with a run of SPAN words of the document.
NEED, SPAN = 8, 2 * WIDTH
# Words whose ids a worker keeps.
CACHE_WORDS = 500_000


# Runs of letters and digits: word characters without the underscore.
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits of the one form, ignoring case."""
    return _WORD.findall(one_form(text).lower()) if text else []


_IDS: dict[str, int] = {}


def word_ids(text: str | None) -> list[int]:
    """64-bit ids of the words of a text: their hashes, the same on any machine.

    Two of a billion different words share an id with a chance of 3 in 100, and such
    a pair matters only where nine neighbours agree too.
    """
    if len(_IDS) > CACHE_WORDS:
        _IDS.clear()
    out = []
    for w in words(text):
        if (i := _IDS.get(w)) is None:
            i = _IDS[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        out.append(i)
    return out


@dataclass
class Items:
    """A block of evaluation items as word ids."""

    item_ids: np.ndarray  # item of each passage
    starts: np.ndarray  # start of each passage in ``terms``
    terms: np.ndarray
    answers: dict[int, list[int]]


def blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about BLOCK_WORDS words; a longer item goes on in the next block."""
    ids, starts, terms, answers = [], [], [], {}

    def made() -> Items:
        return Items(np.array(ids, np.int64), np.array(starts, np.int64), np.array(terms, np.int64), answers)

    for row in items.orderBy("item_id").toLocalIterator():
        seq, answer = word_ids(row["item_text"]), word_ids(row["answer"])
        for at in range(0, max(1, len(seq) - WIDTH + 1), BLOCK_WORDS):
            part = seq[at : at + BLOCK_WORDS + WIDTH - 1]
            if len(part) < WIDTH:
                continue
            base = len(terms)
            terms += part
            ids += [row["item_id"]] * (len(part) - WIDTH + 1)
            starts += range(base, base + len(part) - WIDTH + 1)
            answers[row["item_id"]] = sorted(set(answer))
            if len(terms) >= BLOCK_WORDS:
                yield made()
                ids, starts, terms, answers = [], [], [], {}
    if starts:
        yield made()


def corpus_terms(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, terms): each text as word ids."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                seqs = [word_ids(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seqs, pa.list_(pa.int64()))], names=["doc", "terms"])

    slim = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_col)
    return durable(spread(slim).mapInArrow(number, "doc long, terms array<long>"), "terms")


def columns_of(terms: np.ndarray) -> np.ndarray:
    """Column of each word in the term space."""
    return terms & np.int64(COLUMNS - 1)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a batch and the document position of each."""
    lists = batch.column(batch.schema.get_field_index("terms"))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)


def _passages(terms: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Passage number of every word: each document in runs of WIDTH words."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    inside = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    return np.cumsum(np.r_[1, (doc[1:] != doc[:-1]) | (inside[1:] % WIDTH == 0)]) - 1 if len(doc) else inside


def document_frequencies(corpus: DataFrame) -> tuple[np.ndarray, int]:
    """Passages of the whole corpus that hold each column, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(COLUMNS, np.int64), 0
        for batch in batches:
            terms, doc = _flat(batch)
            if not len(terms):
                continue
            passage = _passages(terms, doc)
            n += int(passage[-1]) + 1
            pairs = np.unique(passage * np.int64(COLUMNS) + columns_of(terms))
            total += np.bincount(columns_of(pairs), minlength=COLUMNS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[total[at], n].astype(np.int64))], names=["term", "n"])

    # one row per column, however large the corpus
    rows = corpus.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(COLUMNS, np.int64), 0
    for r in rows:
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def gram_product(corpus: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) for the TF-IDF passage matrix A of the whole corpus.

    Each task sums over its own passages; one vector per column leaves a task,
    and those are added up in a shuffle by column.
    """
    width = basis.shape[1]
    shared = corpus.sparkSession.sparkContext.broadcast((weights, (basis * weights[:, None]).astype(np.float32)))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weighted = shared.value
        total = np.zeros((COLUMNS, width))
        for batch in batches:
            terms, doc = _flat(batch)
            if not len(terms):
                continue
            passage, terms = _passages(terms, doc), columns_of(terms)
            for at in range(0, len(terms), 200_000):
                # cut between passages
                lo = at if at == 0 else int(np.searchsorted(passage, passage[at], "left"))
                hi = len(terms) if at + 200_000 >= len(terms) else int(np.searchsorted(passage, passage[at + 200_000], "left"))
                if lo >= hi:
                    continue
                t, p = terms[lo:hi], passage[lo:hi] - passage[lo]
                y = np.add.reduceat(weighted[t], np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), axis=0)
                # columns fit 16 bits, whose stable sort is linear: the passages of each column lie together
                order = np.argsort(t.astype(np.int16), kind="stable")
                t = t[order]
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                total[t[first]] += np.add.reduceat(y[p[order]], first, axis=0)
        total *= idf[:, None]
        at = np.flatnonzero(np.any(total != 0, axis=1))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), vectors], names=["term", "v"])

    sums = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)]
    out = np.zeros((COLUMNS, width))
    for r in corpus.mapInArrow(product, "term int, v array<double>").groupBy("term").agg(*sums).collect():
        out[r["term"]] = r[1:]
    return out


def latent_terms(corpus: DataFrame, seed: int = 9) -> np.ndarray:
    """Fixed-point latent vector of every column, from all words of all corpus passages.

    Randomised SVD: a random sketch of the term space is driven through the
    corpus 1 + POWER times and orthonormalised, and the small Gram matrix in that
    basis is decomposed. A term's vector is its row of the right singular vectors,
    weighted by its TF-IDF weight and whitened by the singular values, as frequent
    directions would otherwise give all passages the same signs.
    """
    df, n = document_frequencies(corpus)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((COLUMNS, RANK + EXTRA)))[0]
    for _ in range(POWER):
        basis = np.linalg.qr(gram_product(corpus, idf, basis))[0]
    image = gram_product(corpus, idf, basis)
    values, rotation = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    vectors = (basis @ rotation[:, ::-1])[:, :RANK] * idf[:, None]
    strength = np.sqrt(np.maximum(values[::-1][:RANK], 0))
    vectors /= np.maximum(strength, max(strength[0], 1e-12) * 1e-6)
    # every coordinate on one scale of its own, so that each sign counts alike
    spread_of = np.maximum(np.abs(vectors).max(axis=0, keepdims=True), 1e-12)
    return np.rint(vectors / spread_of * SCALE).astype(np.int32)


def _window_vectors(terms: np.ndarray, starts: np.ndarray, latent: np.ndarray) -> np.ndarray:
    at = columns_of(terms)
    total = latent[at[starts]].copy()
    for k in range(1, WIDTH):
        total += latent[at[starts + k]]
    return total


def _codes(vectors: np.ndarray, bits: range) -> np.ndarray:
    code = np.zeros(len(vectors), np.int64)
    for b in bits:
        code = code << 1 | (vectors[:, b] > 0)
    return code


def numbered(terms: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position of each word among the ordered known ones, or -1: small numbers compare faster than ids."""
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    return np.where(known[at] == terms, at, -1).astype(np.int32)


def match_masks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row and column of ``b`` the columns of ``a`` (at most 30) that hold its value, as bits."""
    masks = np.zeros(b.shape, np.int32)
    for k in range(a.shape[1]):
        masks |= (b == a[:, k : k + 1]).astype(np.int32) << np.int32(k)
    return masks


def masked_subsequences(masks: np.ndarray, width: int) -> np.ndarray:
    """Lengths of the longest common subsequences that the masks of ``width`` columns allow.

    Bit-parallel: the columns of the first side are the bits of one number, which
    every mask updates for all rows at once.
    """
    ones = np.int32((1 << width) - 1)
    state = np.full(len(masks), ones, np.int32)
    for j in range(masks.shape[1]):
        used = state & masks[:, j]
        state = ((state + used) | (state - used)) & ones
    return width - np.bitwise_count(state).astype(np.int64)


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of two matrices; ``a`` has at most 30 columns."""
    return masked_subsequences(match_masks(a, b), a.shape[1])


def _exact_search(corpus: DataFrame, block: Items, latent: np.ndarray) -> DataFrame:
    """(doc_id, item_id) of documents with a whole passage of an item."""
    rank = latent.shape[1]
    vectors = _window_vectors(block.terms, block.starts, latent)
    codes = _codes(vectors, range(rank))
    order = np.argsort(codes, kind="stable")
    known = np.unique(block.terms)
    shared = corpus.sparkSession.sparkContext.broadcast((codes[order], vectors[order], block.starts[order], block.item_ids[order], numbered(block.terms, known), latent, known))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, items_v, items_at, items_id, items_t, lat, words_of_items = shared.value
        norms = np.linalg.norm(items_v.astype(np.float64), axis=1)
        for batch in batches:
            terms, doc = _flat(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if len(terms) < WIDTH:
                continue
            # starts of passages inside one document whose words all occur in items: a passage with
            # another word differs from every item passage
            words_at = numbered(terms, words_of_items)
            unknown = np.cumsum(np.r_[0, words_at < 0])
            starts = np.arange(len(terms) - WIDTH + 1)
            ok = (unknown[starts + WIDTH] == unknown[starts]) & (doc[starts] == doc[starts + WIDTH - 1])
            starts = starts[ok]
            docs_out, items_out = [], []
            for at in range(0, len(starts), 100_000):
                s = starts[at : at + 100_000]
                v = _window_vectors(terms, s, lat)
                c = _codes(v, range(rank))
                lo, hi = np.searchsorted(keys, c, "left"), np.searchsorted(keys, c, "right")
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                many = (hi - lo)[hit]
                pairs, cut = np.r_[0, np.cumsum(many)], 0
                while cut < len(hit):  # bounds the candidate pairs alive at once
                    upto = max(cut + 1, int(np.searchsorted(pairs, pairs[cut] + 200_000, "right")) - 1)
                    h, m, cut = hit[cut:upto], many[cut:upto], upto
                    q = np.repeat(h, m)
                    k = np.repeat(lo[h], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    vq = v[q].astype(np.float64)
                    cosine = np.einsum("ij,ij->i", vq, items_v[k]) / np.maximum(np.linalg.norm(vq, axis=1) * norms[k], 1e-9)
                    # equal vectors are near by definition, also where rounding left them nothing but zeros
                    near = (cosine >= EXACT_COSINE) | (v[q] == items_v[k]).all(axis=1)
                    q, k = q[near], k[near]
                    same = np.ones(len(q), bool)  # the common run must be the whole passage
                    for w in range(WIDTH):
                        same &= words_at[s[q] + w] == items_t[items_at[k] + w]
                    docs_out.append(ids[doc[s[q[same]]]])
                    items_out.append(items_id[k[same]])
            if docs_out:
                pairs = np.unique(np.stack([np.concatenate(docs_out), np.concatenate(items_out)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "item_id"])

    return corpus.mapInArrow(search, "doc_id long, item_id long").distinct()


def _best(doc: np.ndarray, item: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest length of every (doc, item)."""
    order = np.lexsort((-length, item, doc))
    doc, item, length = doc[order], item[order], length[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else order
    return doc[first], item[first], length[first]


def word_counts(corpus: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often each of the ordered known words, those of one block, stands in the whole corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            at = numbered(_flat(batch)[0], shared.value)
            total += np.bincount(at[at >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["word", "n"])

    out = np.zeros(len(known), np.int64)
    for r in corpus.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _near_search(corpus: DataFrame, block: Items, _: None) -> DataFrame:
    """Paraphrased passages: doc_id, item_id, score, answered.

    A passage that shares NEED of its words in order misses at most WIDTH - NEED of
    them, so one of its WIDTH - NEED + 1 rarest words is among the shared ones: every
    occurrence of such a word in a document is a candidate, and no pair is lost.
    """
    anchors = WIDTH - NEED + 1
    known = np.unique(block.terms)
    passages = numbered(block.terms, known)[block.starts[:, None] + np.arange(WIDTH)]
    rarest = np.argsort(word_counts(corpus, known)[passages], axis=1, kind="stable")[:, :anchors]
    keys = np.unique(np.stack([np.take_along_axis(passages, rarest, 1).ravel().astype(np.int64), np.repeat(np.arange(len(passages)), anchors)], axis=1), axis=0)
    bounds = np.searchsorted(keys[:, 0], np.arange(len(known) + 1))
    answers = {k: v for k, v in block.answers.items() if v}
    shared = corpus.sparkSession.sparkContext.broadcast((passages, block.item_ids, known, bounds, keys[:, 1].astype(np.int32), answers))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, items_id, known, bounds, listed, answers = shared.value
        many_of = np.diff(bounds)
        reach = np.arange(1 - SPAN, SPAN)
        for batch in batches:
            terms, doc = _flat(batch)
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(terms):
                continue
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            length = np.diff(np.r_[first, len(terms)])
            begin, end = np.repeat(first, length), np.repeat(first + length, length)
            words_at = numbered(terms, known)
            at = np.flatnonzero(words_at >= 0)
            at = at[many_of[words_at[at]] > 0]
            many = many_of[words_at[at]]
            ends = np.cumsum(many)
            total = int(ends[-1]) if len(ends) else 0
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for lo in range(0, total, 20_000):  # bounds the candidate pairs alive at once
                n = np.arange(lo, min(total, lo + 20_000))
                word = np.searchsorted(ends, n, "right")
                p = at[word]
                k = listed[bounds[words_at[p]] + n - (ends[word] - many[word])]
                where = p[:, None] + reach
                ok = (where >= begin[p][:, None]) & (where < end[p][:, None])
                masks = np.where(ok, match_masks(passages[k], words_at[np.clip(where, 0, len(terms) - 1)]), 0)
                # what the words allow in any order, then in order over all windows around the word, then in each window
                may = np.flatnonzero(np.bitwise_count(np.bitwise_or.reduce(masks, axis=1)) >= NEED)
                may = may[masked_subsequences(masks[may], WIDTH) >= NEED]
                if not len(may):
                    continue
                shares = np.zeros(len(may), np.int64)
                for o in range(SPAN):
                    shares = np.maximum(shares, masked_subsequences(masks[may, o : o + SPAN], WIDTH))
                good = shares >= NEED
                may = may[good]
                found = (doc[p[may]], items_id[k[may]], shares[good])
                best = _best(*(np.concatenate(x) for x in zip(best, found, strict=True)))
            if not len(best[0]):
                continue
            spans = dict(zip(doc[first].tolist(), zip(first.tolist(), (first + length).tolist(), strict=True), strict=True))
            answered = []
            for d, i in zip(best[0].tolist(), best[1].tolist(), strict=True):
                lo_, hi_ = spans[d]
                answered.append(i in answers and bool(np.isin(answers[i], terms[lo_:hi_]).all()))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[best[0]]), pa.array(best[1]), pa.array(best[2] / WIDTH), pa.array(answered, pa.bool_())], names=["doc_id", "item_id", "score", "answered"])

    found = corpus.mapInArrow(search, "doc_id long, item_id long, score double, answered boolean")
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.bool_or("answered").alias("answered"))


def _run(documents: DataFrame, items: DataFrame, statistics, search, schema: str, id_col: str, text_col: str) -> DataFrame:
    asked = items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "item_text", "answer")
    out: DataFrame | None = None
    # the stated query set, in blocks; corpus and statistics do not depend on them
    for block in blocks(asked):
        if out is None:
            corpus = corpus_terms(documents, id_col, text_col)
            known = statistics(corpus)
        found = search(corpus, block, known)
        out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id): documents that hold ten or more consecutive words of an item.

    Null and empty texts and items of fewer than ten words give nothing; repeated
    documents are reported each; repeated item ids are searched as one item.
    Empty tables give no rows. Extra columns are ignored.
    """
    return _run(documents, items, latent_terms, _exact_search, "doc_id long, item_id long", id_col, text_col).distinct()


def paraphrases(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, answered): passages that share most of an item passage in order.

    score is the largest share of a ten-word item passage that is a common
    subsequence with some run of SPAN words of the document (at least NEED of the
    ten words; the search is exact); answered tells whether the document holds all words of
    the item's answer. Rules for nulls and empty tables as in :func:`leaks`.
    """
    found = _run(documents, items, lambda corpus: None, _near_search, "doc_id long, item_id long, score double, answered boolean", id_col, text_col)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.bool_or("answered").alias("answered"))
