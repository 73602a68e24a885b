"""Byte-level BPE: segment trees over the ranks of adjacent pairs, for many pieces of text at once.

A piece's tree holds the rank of every adjacent pair at its leaves; the root is the lowest rank, leftmost on ties.
Merging it changes three leaves, so three paths to the root are mended, until no root can merge. The trees of all new
pieces of a batch stand side by side in one array, and each step merges once in every piece that still can, so a
step costs a few numpy calls for thousands of pieces. Pieces already seen by the worker come from a bounded memo.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from culvert.llm.common import added, append, arrow_map, table

MODEL = "byte_bpe_50k.json"
MEMO_PIECES = 300_000
#: characters whose pieces are held at a time, and cells of the trees that stand side by side
CHUNK_CHARS, CELLS = 1 << 20, 1 << 20
#: longer pieces are merged one by one
LONG = 256
NONE = np.int64(2**62)

# fixed values: the split pattern and the byte alphabet of byte-level BPE vocabularies
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Vocabulary:
    """A tokenizers file as arrays: sorted pair keys with rank and result, bytes of every id, added strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        hidden = [b for b in range(256) if b not in set(SHOWN)]
        byte_of = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.span = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * self.span
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.start = np.zeros(256, np.int64)
        for shown, b in byte_of.items():
            self.start[b] = ids[shown]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.span + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)[order]
        self.rule = {(ids[a], ids[b]): (k, ids[a + b]) for k, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.split = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it can't merge) and where it stands."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(public_tokenizers.path(name))


def merge_all(vocab: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Token ids of each non-empty piece."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    sizes = np.array([len(p) for p in pieces])
    widths = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
    for width in np.unique(widths).tolist():
        of = np.flatnonzero(widths == width)
        if width > LONG:
            for k in of.tolist():
                out[k] = merge_long(vocab, pieces[k])
            continue
        for at in range(0, len(of), max(1, CELLS // width)):
            part = of[at : at + max(1, CELLS // width)]
            for k, ids in zip(part.tolist(), _merge(vocab, [pieces[k] for k in part], width), strict=True):
                out[k] = ids
    return out


def _merge(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[np.ndarray]:
    n, row = len(pieces), width + 1  # one cell behind the last: nothing
    sizes = np.array([len(p) for p in pieces])
    cells = np.frombuffer(b"".join(p.ljust(row, b"\0") for p in pieces), np.uint8).reshape(n, row)
    place = np.arange(row)
    grid = np.where(place < sizes[:, None], vocab.start[cells], -1)
    # a leaf is rank * width + place, so that the least leaf is the leftmost lowest rank
    tree = np.full((n, 2 * width), NONE)
    rank, _ = vocab.pair(grid[:, :-1], grid[:, 1:])
    tree[:, width:] = np.where(rank < NONE, rank * width + place[:-1], NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    symbols, tree = grid.ravel(), tree.ravel()
    after, before = np.tile(np.minimum(place + 1, width), n), np.tile(place - 1, n)  # linked lists of what is left
    live = np.arange(n)
    while True:
        root = tree.take(live * (2 * width) + 1)
        live, root = live[root < NONE], root[root < NONE]
        if not len(live):
            return [r[r >= 0].astype("<u4") for r in grid]
        base, leaf = live * row, live * (2 * width)
        left = root % width
        right = after.take(base + left)
        _, found = vocab.pair(symbols.take(base + left), symbols.take(base + right))
        made, then, prior = vocab.made.take(found), after.take(base + right), before.take(base + left)
        symbols[base + left], symbols[base + right] = made, -1
        after[base + left], before[base + then] = then, left
        ahead, _ = vocab.pair(made, symbols.take(base + then))
        behind, _ = vocab.pair(np.where(prior >= 0, symbols.take(base + np.maximum(prior, 0)), -1), made)
        first = prior < 0  # no neighbour on the left: its update repeats that of the merged pair
        ahead = np.where(ahead < NONE, ahead * width + left, NONE)
        tree[leaf + width + left], tree[leaf + width + right] = ahead, NONE
        node = np.concatenate((right, left, np.where(first, left, prior))) + width
        tree[leaf + node[-len(live) :]] = np.where(first, ahead, np.where(behind < NONE, behind * width + prior, NONE))
        leaf = np.tile(leaf, 3)
        for _ in range(width.bit_length() - 1):  # the paths from the three leaves to the root
            node >>= 1
            child = leaf + 2 * node
            tree[leaf + node] = np.minimum(tree.take(child), tree.take(child + 1))


def merge_long(vocab: Vocabulary, piece: bytes) -> np.ndarray:
    """The same tree for one long piece, in plain lists."""
    symbols = vocab.start[np.frombuffer(piece, np.uint8)].tolist()
    n, width = len(symbols), 1 << (len(symbols) - 1).bit_length()
    rule, none = vocab.rule, int(NONE)
    tree = [none] * (2 * width)

    def leaf(at: int, to: int) -> int:
        found = rule.get((symbols[at], symbols[to])) if to < n else None
        return none if found is None else found[0] * width + at

    for k in range(n - 1):
        tree[width + k] = leaf(k, k + 1)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] < none:
        left = tree[1] % width
        right = after[left]
        symbols[left], symbols[right] = rule[symbols[left], symbols[right]][1], -1
        then = after[left] = after[right]
        if then < n:
            before[then] = left
        for at, value in ((left, leaf(left, then)), (right, none), *([(before[left], leaf(before[left], left))] if before[left] >= 0 else [])):
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
    return np.array([s for s in symbols if s >= 0], "<u4")


def split_text(vocab: Vocabulary, text: str) -> list[str]:
    """Pieces in order; added strings stand alone."""
    if vocab.split is None or not any(c in text for c in vocab.added):
        return PIECES.findall(text)
    out = []
    for k, part in enumerate(vocab.split.split(text)):
        out.extend([part] if k % 2 else PIECES.findall(part))
    return out


def encode(vocab: Vocabulary, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    memo, at = vocab.memo, 0
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and (chars == 0 or chars + len(texts[upto]) <= CHUNK_CHARS):
            chars += len(texts[upto])
            upto += 1
        split = [split_text(vocab, t) for t in texts[at:upto]]
        if len(memo) > MEMO_PIECES:
            memo.clear()
        if not memo:
            memo.update((c, np.array([i], "<u4").tobytes()) for c, i in vocab.added.items())
        new = [p for p in set().union(*split) if p not in memo]
        memo.update(zip(new, (ids.tobytes() for ids in merge_all(vocab, [p.encode() for p in new])), strict=True))
        for pieces in split:
            yield b"".join(map(memo.__getitem__, pieces))
        at = upto


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    return b"".join(map(vocab.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _encoded(batches: Iterator[pa.RecordBatch], text_at: int, model: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(model)
    for batch in batches:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        count, ids_sha, text_sha, kept = [], [], [], []
        for packed in encode(vocab, texts):
            ids = np.frombuffer(packed, "<u4")
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            text_sha.append(hashlib.sha256(decode(vocab, ids).encode()).hexdigest())
            if keep_ids:
                kept.append(ids)
        more = {}
        if keep_ids:
            flat = np.concatenate([np.empty(0, "<u4"), *kept]).astype(np.int32)
            more["token_ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.array(flat, pa.int32()))
        yield append(batch, n_tokens=pa.array(count, pa.int64()), ids_sha256=pa.array(ids_sha, pa.string()), decoded_sha256=pa.array(text_sha, pa.string()), **more)


def encode_decode(docs: DataFrame, text_col: str = "text", model: str = MODEL, keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 (and token_ids, if kept) of every whole text.

    Null counts as empty: no tokens, digests of nothing. Added strings such as an end-of-text mark become their own
    id. Rows are independent, so repeats, ties and empty tables need no rule; columns of the added names are replaced.
    """
    base = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if keep_ids else []))
    schema = added(base, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else ""))
    return arrow_map(base, partial(_encoded, text_at=base.columns.index(text_col), model=model, keep_ids=keep_ids), schema)


def _decoded(batches: Iterator[pa.RecordBatch], ids_at: int, model: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(model)
    for batch in batches:
        yield append(batch, decoded=pa.array([None if ids is None else decode(vocab, np.array(ids, np.int64)) for ids in batch.column(ids_at).to_pylist()], pa.string()))


def decode_ids(tokens: DataFrame, ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """Adds the decoded text of a column of id lists; null stays null."""
    base = tokens.drop("decoded")
    return arrow_map(base, partial(_decoded, ids_at=base.columns.index(ids_col), model=model), added(base, "decoded string"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
