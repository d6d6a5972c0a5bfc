"""Language-model scores of whole texts from Elias-Fano n-gram tries.

Texts are gathered into blocks with dictionaries of their own, so that what
tasks exchange are each block's distinct words and n-grams, not its tokens.
Order by order the blocks send their distinct n-grams, with their counts in
training texts, to the shard of the context; a shard adds the counts up, builds
the trie of all its training n-grams with quantised smoothed probabilities, and
answers each block by successor search.  A context that is very frequent is
spread over several shards by the next word.  Nothing is capped or pruned.

Smoothing is interpolated absolute discounting: p(w|h) = alpha(h, w) +
gamma(h) p(w|h'), down to discounted word frequencies; what these leave is the
probability of the one unknown word.  A text's score is that of an even mixture
of two models of whole texts, the words alone and the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.elias_fano import Trie, quantise, restored
from telemill.llm.store import dropped, written
from telemill.llm.text import NONSPACE, mix, text_buffers, words_of

ORDER = 3
DISCOUNTS = {1: 0.5, 2: 0.75, 3: 0.5}  # the last holds for higher orders
BLOCK_BYTES = 4 << 20  # of text in a block
SHARD_NGRAMS = 800_000  # that a shard is meant to hold
HOT = 200_000  # occurrences of a context that one shard takes
_START, _END, _FIRST = 0, 1, 2  # word ids

_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, trained binary, seq binary, n_words long, n_tokens long, train_tokens long, train_docs long"


def pack(x: np.ndarray) -> bytes:
    """An array of small numbers: bytes of equal place side by side, compressed."""
    width = x.dtype.itemsize
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = zstandard.ZstdDecompressor().decompress(raw[1:])
    return np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T.copy().view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width]).reshape(-1)


def _u32(x) -> np.ndarray:
    x = np.asarray(x)
    if x.size and int(x.max()) > 0xFFFFFFFF:
        raise OverflowError("word ids and counts have 32 bits here; the corpus has more distinct words or n-grams than that")
    return x.astype(np.uint32)


def blocks(docs: DataFrame, held: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole texts with their dictionaries and the training counts of their words."""

    def row(block: int, batch: pa.RecordBatch) -> dict:
        words = words_of(*text_buffers(batch.column("text")), NONSPACE)
        out = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        n = words.counts()
        distinct, seq = np.unique(words.hashes, return_inverse=True)
        train = np.repeat(~out, n)
        return {
            "block": block, "doc_ids": batch.column("doc_id").to_pylist(), "held": out.tolist(), "lengths": pack(_u32(n)), "words": distinct.tobytes(),
            "trained": pack(_u32(np.bincount(seq[train], minlength=len(distinct)))), "seq": pack(_u32(seq)), "n_words": len(distinct), "n_tokens": int(n.sum()) + len(n),
            "train_tokens": int((n + 1)[~out].sum()), "train_docs": int((~out).sum()),
        }

    kinds = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("lengths", "words", "trained", "seq")), *((c, pa.int64()) for c in ("n_words", "n_tokens", "train_tokens", "train_docs"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, waiting, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            _, offsets = text_buffers(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max(1, block_bytes - size), side="right")) - 1)
                j = min(j, batch.num_rows)
                waiting.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                i = j
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([row(part << 32 | k, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])], schema=kinds)
                    waiting, size, k = [], 0, k + 1
        if waiting:
            yield pa.RecordBatch.from_pylist([row(part << 32 | k, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held")).mapInArrow(run, _BLOCKS)


def _rows(names: str, kinds: list):
    def make(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names.split())

    return make


def _word_exchange(table: DataFrame, shards: int) -> DataFrame:
    """(block, shard, counts, ids, v): training counts and ids of each block's words, shard by shard in the order of their hashes."""
    make = _rows("shard block words trained", [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, trained in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "trained"))):
                h, n = np.frombuffer(words, dtype=np.uint64), unpack(trained)
                at = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(at, np.arange(shards + 1))
                yield make([(s, block, h[a:b].tobytes(), pack(n[a:b])) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, dtype=np.uint64) for x in pdf["words"]]
        distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(where, np.concatenate([unpack(x) for x in pdf["trained"]]), len(distinct)).astype(np.int64)
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(distinct))
        ids = _FIRST + rank * shards + int(pdf["shard"].iloc[0])
        cut = np.cumsum([0, *map(len, hashes)])
        marked = _marked(counts, np.bincount(where, minlength=len(distinct)) == 1)
        out = [(b, int(pdf["shard"].iloc[0]), pack(marked[where[x:y]]), pack(_u32(ids[where[x:y]])), 0) for b, x, y in zip(pdf["block"], cut[:-1], cut[1:])]
        got = pd.DataFrame(out, columns=["block", "shard", "counts", "ids", "v"])
        got.loc[0, "v"] = int((counts > 0).sum())
        return got

    asked = table.select("block", "words", "trained").mapInArrow(ask, "shard int, block long, words binary, trained binary")
    return asked.groupBy("shard").applyInPandas(answer, "block long, shard int, counts binary, ids binary, v long")


class _Tokens:
    """The tokens of a block's texts, each text closed by its end, and what they follow."""

    def __init__(self, lengths: np.ndarray, held: np.ndarray, seq: np.ndarray, counts: np.ndarray, only: np.ndarray, ids: np.ndarray, train_docs: int):
        n = lengths.astype(np.int64) + 1
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        self.n, self.train_docs = int(self.bounds[-1]), train_docs
        word = np.ones(self.n, dtype=bool)
        word[self.bounds[1:] - 1] = False
        # words by rank, in the order of their ids; the end is the first of them
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(1, len(ids) + 1)
        self.ids = np.concatenate([[_END], ids[order]]).astype(np.int64)
        self.rank = np.zeros(self.n, dtype=np.int32)
        self.rank[word] = place[seq]
        self.c = np.full(self.n, train_docs, dtype=np.int64)
        self.c[word] = counts[seq]
        self.only = np.zeros(self.n, dtype=bool)
        self.only[word] = only[seq]
        self.train = np.repeat(~held, n)
        self.place = np.arange(self.n) - np.repeat(self.bounds[:-1], n)

    def of_contexts(self, last: np.ndarray, first) -> np.ndarray:
        """What ``last`` has for the n-gram that ends before each token; ``first`` at a text's start."""
        out = np.full(self.n, first, dtype=last.dtype)
        some = np.flatnonzero(self.place >= 1)
        out[some] = last[some - 1]
        return out


class _Request:
    """A block's distinct n-grams of one order, in the order in which shards get them.

    Contexts that no other block has at all come last: the block answers these
    itself, in the same way, and sends nothing.
    """

    def __init__(self, tokens: _Tokens, order: int, below: _Request | None, counts: np.ndarray, only: np.ndarray, shards: int):
        """below: the request of the order below, if any; counts, only: of its n-grams, by the token where they end."""
        context_counts = tokens.of_contexts(counts, tokens.train_docs)
        inner = np.flatnonzero(tokens.place >= 1)
        ctx = np.zeros(tokens.n, dtype=np.int32)  # 0: the start; then words, or n-grams below, in the order of their ids
        if below is None:
            ctx[inner] = tokens.rank[inner - 1]
            contexts = np.concatenate([[[_START]], tokens.ids[1:, None]])
        else:
            ctx[inner] = below.full[inner - 1] + 1
            contexts = np.concatenate([np.full((1, order - 1), _START), below.columns])
        seen = np.flatnonzero(context_counts > 0)  # of others nothing can be known
        used = np.zeros(len(contexts), dtype=bool)
        used[ctx[seen]] = True
        contexts = contexts[used]
        ctx = (np.cumsum(used, dtype=np.int32) - 1)[ctx[seen]]
        cc, alone = np.zeros(len(contexts), dtype=np.int64), np.zeros(len(contexts), dtype=bool)
        cc[ctx] = context_counts[seen]
        alone[ctx] = tokens.of_contexts(only, False)[seen]
        grams, gram_of = np.unique(ctx.astype(np.int64) << 32 | tokens.rank[seen], return_inverse=True)
        gram_of = gram_of.astype(np.int32)
        gram_ctx, gram_w = (grams >> 32).astype(np.int32), tokens.ids[grams & 0xFFFFFFFF]
        self.full = np.full(tokens.n, -1, dtype=np.int32)
        self.full[seen] = gram_of
        self.columns = np.concatenate([contexts[gram_ctx], gram_w[:, None]], axis=1)
        trained = np.bincount(gram_of[tokens.train[seen]], minlength=len(grams))
        parts = np.where(alone, 1, -(-cc // HOT))
        head_start = np.concatenate([[0], np.cumsum(parts)])
        split = bool((parts > 1).any())
        head_ctx = np.repeat(np.arange(len(cc)), parts) if split else np.arange(len(cc))
        h = np.zeros(len(cc), dtype=np.uint64)
        for j in range(contexts.shape[1]):
            h = mix(h * np.uint64(31) + contexts[:, j].astype(np.uint64) + np.uint64(1))
        head_part = (np.arange(len(head_ctx)) - head_start[head_ctx]).astype(np.uint64) if split else np.uint64(0)
        # the upper half of a hash, scaled to the number of shards
        head_shard = ((mix(h[head_ctx] + head_part) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
        head_shard[alone[head_ctx]] = shards
        gram_head = gram_ctx.astype(np.int64)
        if split:
            gram_head = head_start[gram_ctx]
            some = np.flatnonzero(parts[gram_ctx] > 1)
            gram_head[some] += (mix(gram_w[some].astype(np.uint64)) % parts[gram_ctx[some]].astype(np.uint64)).astype(np.int64)
        self.heads = np.argsort(head_shard.astype(np.uint16) if shards < 1 << 16 else head_shard, kind="stable")
        children = np.bincount(gram_head, minlength=len(self.heads))
        self.children = children[self.heads]
        ends = np.cumsum(self.children)
        if split:
            rank = np.empty(len(self.heads), dtype=np.int32)
            rank[self.heads] = np.arange(len(self.heads))
            self.grams = np.argsort(rank[gram_head], kind="stable")
        else:  # a head's n-grams follow each other, as they are sorted by context
            first = np.concatenate([[0], np.cumsum(children)])[self.heads]
            self.grams = np.arange(len(grams)) + np.repeat(first - (ends - self.children), self.children)
        self.head_cut = np.searchsorted(head_shard[self.heads], np.arange(shards + 2))
        self.gram_cut = np.concatenate([[0], ends])[self.head_cut]
        self.seen, self.gram_of, self.ctx, self.head_ctx, self.n_ctx = seen, gram_of, ctx, head_ctx, len(cc)
        self.contexts, self.cc = contexts[head_ctx[self.heads]], cc[head_ctx[self.heads]]
        self.w, self.counts = gram_w[self.grams], trained[self.grams]

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        """(shard, message) for every shard that has any of the contexts."""
        for s in range(len(self.head_cut) - 2):
            if self.head_cut[s + 1] > self.head_cut[s]:
                yield s, self._message(s)

    def _message(self, s: int) -> bytes:
        a, b, x, y = self.head_cut[s], self.head_cut[s + 1], self.gram_cut[s], self.gram_cut[s + 1]
        columns = self.contexts[a:b]
        lead = np.diff(columns[:, 0], prepend=0)
        return _bundle([pack(_u32(lead)), *(pack(_u32(columns[:, j])) for j in range(1, columns.shape[1])), pack(_u32(self.cc[a:b])), pack(_u32(self.children[a:b])), pack(_gaps(self.w[x:y], self.children[a:b])), pack(_u32(self.counts[x:y]))])

    def forget(self) -> None:
        """Keep only what the order above needs."""
        for name in [x for x in vars(self) if x not in ("full", "columns")]:
            delattr(self, name)

    def own_answer(self, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(alpha, counts, gamma) of what no shard was asked: these contexts are of this block alone."""
        a, x = self.head_cut[-2], self.gram_cut[-2]
        cc, children, counts = self.cc[a:], self.children[a:], self.counts[x:]
        head = np.repeat(np.arange(len(cc)), children)
        known = counts > 0
        alpha = np.zeros(len(counts), dtype=np.uint16)
        alpha[known] = quantise((counts[known] - discount) / cc[head[known]])
        return alpha, _marked(counts, np.ones(len(counts), dtype=bool)), quantise(discount * np.bincount(head[known], minlength=len(cc)) / cc)

    def spread(self, alpha: np.ndarray, counts: np.ndarray, gamma: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(alpha, gamma, count of the n-gram, whether only this block has it) of each of n tokens, from the answers in a row."""
        a, c = np.zeros(len(self.grams)), np.zeros(len(self.grams), dtype=np.uint64)
        a[self.grams], c[self.grams] = restored(alpha), counts
        left = np.zeros(len(self.heads))
        left[self.heads] = restored(gamma)
        left = np.bincount(self.head_ctx, left, self.n_ctx)
        out = np.zeros(n), np.ones(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for x, y in zip(out, (a[self.gram_of], left[self.ctx], *_split(c[self.gram_of]))):
            x[self.seen] = y
        return out


def _marked(counts: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Counts, and in the lowest bit whether a single block has the word or n-gram."""
    return counts.astype(np.uint64) << np.uint64(1) | only.astype(np.uint64)


def _split(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (marked >> np.uint64(1)).astype(np.int64), (marked & np.uint64(1)).astype(bool)


def _gaps(w: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Each word id less the one before it of the same context."""
    out = np.diff(w, prepend=0)
    first = np.concatenate([[0], np.cumsum(children)])[:-1][children > 0]
    out[first] = w[first]
    return _u32(out)


def _from_gaps(gaps: np.ndarray, children: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps.astype(np.int64))
    first = np.concatenate([[0], np.cumsum(children)])[:-1]
    base = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else np.zeros(len(children), dtype=np.int64)
    return total - np.repeat(base, children)


def _bundle(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes() + b"".join(parts)


def _parts(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    cut = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], dtype=np.int64))])
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _answer(messages: list[bytes], order: int, discount: float) -> list[tuple[bytes, bytes, bytes]]:
    """A shard's answers (alpha, counts, gamma): a trie of all training n-grams of its contexts is built, then searched for each block's n-grams."""
    heads, given, kids, words, trained = [], [], [], [], []
    for raw in messages:
        parts = [unpack(x) for x in _parts(raw)]
        columns = [np.cumsum(parts[0].view(np.int32).astype(np.int64)), *(x.astype(np.int64) for x in parts[1 : order - 1])]
        heads.append(np.stack(columns, axis=1))
        cc, children, gaps, counts = parts[order - 1 :]
        given.append(cc)
        kids.append(children.astype(np.int64))
        words.append(_from_gaps(gaps, kids[-1]))
        trained.append(counts)
    contexts, total, children = np.concatenate(heads), np.concatenate(given).astype(np.int64), np.concatenate(kids)
    sizes = [len(h) for h in heads]
    del heads
    key = contexts[:, 0].astype(np.uint64)
    for j in range(1, contexts.shape[1]):
        _, key = np.unique(key, return_inverse=True)
        key = key.astype(np.uint64) << np.uint64(32) | contexts[:, j].astype(np.uint64)
    _, first, ctx = np.unique(key, return_index=True, return_inverse=True)
    contexts, total = contexts[first], total[first]
    grams = np.repeat(ctx, children).astype(np.uint64) << np.uint64(32) | np.concatenate(words).astype(np.uint64)
    by = np.argsort(grams)
    grams = grams[by]
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, dtype=np.int64)
    grams, counts = grams[new], np.add.reduceat(np.concatenate(trained)[by].astype(np.int64), new) if len(new) else np.zeros(0, dtype=np.int64)
    marked = _marked(counts, np.diff(np.append(new, len(by))) == 1)[counts > 0]  # each block sends an n-gram once
    grams, counts = grams[counts > 0], counts[counts > 0]
    at = (grams >> np.uint64(32)).astype(np.int64)
    trie = Trie(np.concatenate([contexts[at], (grams & np.uint64(0xFFFFFFFF)).astype(np.int64)[:, None]], axis=1))
    alpha, gamma = quantise((counts - discount) / total[at]), quantise(discount * np.bincount(at, minlength=len(first)) / total)
    del grams, counts, at, by, new
    base, _, end = trie.find(contexts)
    out, level, a = [], trie.ids[-1], 0
    for n, k, w in zip(sizes, kids, words):
        own = ctx[a : a + n]
        node, same = level.successor(np.repeat(base[own], k) + w)
        same &= node < np.repeat(end[own], k)
        node = node[same]
        codes, known = np.zeros(len(w), dtype=np.uint16), np.zeros(len(w), dtype=np.uint64)
        codes[same], known[same] = alpha[node], marked[node]
        out.append((pack(codes), pack(known), pack(gamma[own])))
        a += n
    return out


def _gram_exchange(requests: DataFrame, order: int, discount: float) -> DataFrame:
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        alpha, counts, gamma = zip(*_answer(pdf["message"].tolist(), order, discount))
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "alpha": alpha, "counts": counts, "gamma": gamma})

    return requests.groupBy("shard").applyInPandas(answer, "block long, shard int, alpha binary, counts binary, gamma binary")


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one in memory at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _joined(table: DataFrame, answers: DataFrame, name: str, *columns: str) -> DataFrame:
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("shard", *columns)).alias(name))  # one for each shard
    return table.join(lists, "block", "left")


def _by_shard(answers: list[dict] | None, column: str) -> list[bytes]:
    return [x[column] for x in sorted(answers or [], key=lambda x: x["shard"])]


def _concat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


_STATE = "block long, doc_ids array<long>, held array<boolean>, lengths binary, seq binary, counts binary, ids binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held: str, order: int = ORDER, discounts: dict[int, float] = DISCOUNTS, block_bytes: int = BLOCK_BYTES, shard_ngrams: int = SHARD_NGRAMS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id (a number), text and a boolean column named by ``held`` (null: false);
    documents where it is true are scored but not learned from.  Words are runs
    of other bytes than white space, A-Z lower-cased; an end closes every text
    and counts as a token, so a null or empty text has one.  base_score sums
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability.
    Without training texts both are 0 for every text.  Rows with the same
    doc_id are texts of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    table = written(blocks(docs, held, block_bytes), "lm-blocks")
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "train_tokens", "train_docs"))).first()
    n_tokens, n_train, n_docs = sums
    shards = max(4, -(-n_tokens // shard_ngrams))
    words = written(_word_exchange(table, shards), "lm-words")
    v = (words.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]) + (n_docs > 0)
    state_row = _rows(" ".join(x.split()[0] for x in _STATE.split(", ")), [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4])
    d1 = discounts[1]

    def first_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts, ids = (_concat([unpack(x) for x in _by_shard(r["words"], c)], np.uint32) for c in ("counts", "ids"))
                counts = counts.astype(np.uint64)
                yield state_row([(r["block"], r["doc_ids"], r["held"], r["lengths"], r["seq"], pack(counts), pack(ids))])

    def words_alone(c: np.ndarray) -> np.ndarray:
        """Discounted frequency of a word, or what the discounts leave to the unknown one."""
        return np.where(c > 0, c - d1, d1 * v) / n_train if n_train else np.ones(len(c))

    def discount_of(k: int) -> float:
        return discounts.get(k, discounts[max(discounts)])

    def followed(r: dict, upto: int) -> tuple[_Tokens, np.ndarray, np.ndarray, np.ndarray, _Request | None]:
        """(tokens, probability of each under order ``upto``, count of its n-gram, whether only this block has it, the last request), from the answers of all orders so far."""
        t = _Tokens(unpack(r["lengths"]), np.array(r["held"], dtype=bool), unpack(r["seq"]).astype(np.int64), *_split(unpack(r["counts"])), unpack(r["ids"]).astype(np.int64), n_docs)
        p, count, only, request = words_alone(t.c), t.c, t.only, None
        for k in range(2, upto + 1):
            request = _Request(t, k, request, count, only, shards)
            parts = [(x.get("alpha"), x["counts"], x.get("gamma")) for x in sorted(r[f"answers{k}"] or [], key=lambda x: x["shard"])]
            alpha, known, gamma = ([unpack(x[i]) if x[i] is not None else None for x in parts] for i in (0, 1, 2))
            for got, own in zip((alpha, known, gamma), request.own_answer(discount_of(k))):
                got.append(own)
            n_grams, n_heads = len(request.grams), len(request.heads)
            if any(x is None for x in alpha):  # only counts were asked for
                alpha, gamma = [np.zeros(n_grams, np.uint16)], [np.zeros(n_heads, np.uint16)]
            a, g, count, only = request.spread(_concat(alpha, np.uint16), _concat(known, np.uint64), _concat(gamma, np.uint16), t.n)
            p = a + g * p
            request.forget()
        return t, p, count, only, request

    def asker(k: int):
        make = _rows("shard block message", [pa.int32(), pa.int64(), pa.binary()])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in _one_by_one(batch):
                    t, _, count, only, below = followed(r, k - 1)
                    rows = [(s, r["block"], m) for s, m in _Request(t, k, below, count, only, shards).payloads()]
                    if rows:
                        yield make(rows)

        return ask

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _one_by_one(batch):
                t, p, *_ = followed(r, order)
                base = np.log10((t.c + 1.0) / (n_train + v + 1.0))
                both = [np.add.reduceat(np.log10(x), t.bounds[:-1]) for x in (words_alone(t.c), p)]
                top = np.maximum(*both)
                total = top + np.log10(0.5 * 10 ** (both[0] - top) + 0.5 * 10 ** (both[1] - top))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(np.diff(t.bounds)), pa.array(np.add.reduceat((t.c > 0).astype(np.int64), t.bounds[:-1])),
                        pa.array(np.full(len(t.bounds) - 1, n_train, dtype=np.int64)), pa.array(np.add.reduceat(base, t.bounds[:-1])), pa.array(total),
                    ],
                    names=[x.split()[0] for x in _SCORES.split(", ")],
                )

    kept = table.select("block", "doc_ids", "held", "lengths", "seq")
    state = written(_joined(kept, words, "words", "counts", "ids").mapInArrow(first_state, _STATE), "lm-state")
    dropped(table)
    dropped(words)
    answers: dict[int, DataFrame] = {}
    for k in range(2, order + 1):
        seen = state
        for j, rows in answers.items():
            seen = _joined(seen, rows, f"answers{j}", "counts")
        answers[k] = written(_gram_exchange(seen.mapInArrow(asker(k), "shard int, block long, message binary"), k, discount_of(k)), "lm-answers")
    full = state
    for j, rows in answers.items():
        full = _joined(full, rows, f"answers{j}", "alpha", "counts", "gamma")
    return full.mapInArrow(scores, _SCORES)
