"""Exact token counts of every prefix, by dynamic programming over the vocabulary.

For BPE whose merges are ordered by rank alone, the tokens of a prefix end in exactly one token, and dropping it
leaves the tokens of a shorter prefix. So ``count[i] = count[i - len(t)] + 1`` for the one piece ``t`` that ends at
``i`` and is compatible with the last token before it: encoding both together gives back both. Truncation and budget
questions are look-ups in these counts; no text is encoded again.

No piece spans a word start (white space is written before a word) or a line feed, so counts are made for such
units, kept in a bounded memo, and added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.llm.common import Memo, added, append, arrow_map, table

MODEL, LIMIT = "piece_bpe_32k.model", 4096
SPACE, SPAN = "▁", 1 << 20
UNITS = re.compile("▁+[^▁\n]*|\n|[^▁\n]+")
#: units of up to 60 characters are kept, with counts below 256; longer ones are counted each time
MEMO_UNITS, MEMO_CHARS = 500_000, 60


class Prefixes:
    """Token counts of the prefixes of a text under one model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        reserved = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
        self.score = {model.id_to_piece(k): model.get_score(k) for k in range(model.vocab_size()) if not any(r(k) for r in reserved)}
        self.longest = max(map(len, self.score))
        single = {p for p in self.score if len(p) == 1}
        if any(c not in single for p in self.score for c in p):
            raise ValueError("a piece holds a character that is no piece: counts by character would not be exact")
        spans = [p for p in self.score if "\n" in p and len(p) > 1 or SPACE in p.lstrip(SPACE)]
        if spans:
            raise ValueError(f"pieces span words or lines: {spans[:3]}")
        self.names = ["", *self.score]
        self.ends = ahocorasick.Automaton()
        for k, piece in enumerate(self.names[1:], 1):
            self.ends.add_word(piece, (len(piece), k))
        self.ends.make_automaton()
        self.fits = Memo(self._fits, 400_000)
        self.memo = Memo(lambda unit: bytes(self._unit(unit)), MEMO_UNITS)

    def _merge(self, text: str) -> list[str]:
        """Plain merging of two pieces' text: best score first, leftmost on ties."""
        parts, score = list(text), self.score
        while True:
            best = max(((score[p], -k) for k, p in enumerate(map(str.__add__, parts, parts[1:])) if p in score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fits(self, pair: int) -> bool:
        """Do both pieces stay as they are side by side; 0 stands for nothing before."""
        names = [self.names[k] for k in divmod(pair, SPAN) if k]
        return self._merge("".join(names)) == names

    def _unit(self, unit: str) -> list[int]:
        fits, last, counts = self.fits, [0], [0]

        def outside(upto: int) -> None:  # characters outside the vocabulary never merge: one token for each byte
            for k in range(len(last), upto):
                last.append(0)
                counts.append(counts[-1] + len(unit[k - 1].encode()))

        for end, (size, piece) in self.ends.iter(unit):  # by end, every piece of the vocabulary that ends there
            i = end + 1
            if i >= len(last):
                if i > len(last):
                    outside(i)
                begin = i - size
                if fits[last[begin] * SPAN + piece]:
                    last.append(piece)
                    counts.append(counts[begin] + 1)
        outside(len(unit) + 1)
        return counts[1:]

    def of_unit(self, unit: str) -> bytes | list[int]:
        return self.memo[unit] if len(unit) <= MEMO_CHARS else self._unit(unit)

    def units(self, text: str) -> list[str]:
        return UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def total(self, text: str) -> int:
        memo = self.memo
        return sum([memo[u][-1] if len(u) <= MEMO_CHARS else self._unit(u)[-1] for u in self.units(text)])

    def counts(self, text: str) -> list[int]:
        """Tokens of each prefix of 1, 2, ... characters."""
        out, base = [], 0
        for unit in self.units(text):
            own = self.of_unit(unit)
            out.extend([base + c for c in own])
            base += own[-1]
        return out[1:]  # the first character is the space that the model puts before a text

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix within a budget of tokens."""
        at, base, best = 0, 0, 0
        for unit in self.units(text):
            own = self.of_unit(unit)
            if base + own[-1] <= budget:
                best = at + len(unit)
            else:
                best = max([best, *(at + k + 1 for k, c in enumerate(own) if base + c <= budget)])
            at, base = at + len(unit), base + own[-1]
            if base - len(own) > budget + self.longest:  # one more character never saves more than one piece's tokens
                break
        return max(0, best - 1)


@lru_cache(maxsize=4)
def prefixes(name: str) -> Prefixes:
    return Prefixes(public_tokenizers.path(name))


def _counted(batches: Iterator[pa.RecordBatch], text_at: int, model: str, limit: int) -> Iterator[pa.RecordBatch]:
    table = prefixes(model)
    for batch in batches:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        tokens = [table.total(t) for t in texts]
        yield append(
            batch,
            n_bytes=pa.array([len(t.encode()) for t in texts], pa.int64()), n_tokens=pa.array(tokens, pa.int64()),
            over_limit=pa.array([n > limit for n in tokens], pa.bool_()),
            fit_chars=pa.array([len(t) if n <= limit else table.fit(t, limit) for t, n in zip(texts, tokens, strict=True)], pa.int64()),
        )


def count_tokens(docs: DataFrame, text_col: str = "text", limit: int = LIMIT, model: str = MODEL) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit and fit_chars (the longest prefix within ``limit`` tokens) to each row.

    Null counts as empty: zero bytes and tokens. Rows are independent, so repeats, ties and empty tables need no
    rule; columns of the added names are replaced.
    """
    base = docs.drop("n_bytes", "n_tokens", "over_limit", "fit_chars")
    schema = added(base, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return arrow_map(base, partial(_counted, text_at=base.columns.index(text_col), model=model, limit=limit), schema)


def _listed(batches: Iterator[pa.RecordBatch], text_at: int, model: str) -> Iterator[pa.RecordBatch]:
    table = prefixes(model)
    for batch in batches:
        yield append(batch, prefix_tokens=pa.array([table.counts(t or "") for t in batch.column(text_at).to_pylist()], pa.list_(pa.int32())))


def with_prefix_counts(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Adds prefix_tokens: the token count of the first 1, 2, ... characters of each text, to be stored."""
    base = docs.drop("prefix_tokens")
    return arrow_map(base, partial(_listed, text_at=base.columns.index(text_col), model=model), added(base, "prefix_tokens array<int>"))


def chars_within(prefix_tokens: Column, budget: int | Column) -> Column:
    """Characters of the longest prefix within a budget, from stored counts."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.size(prefix_tokens) - F.coalesce(F.nullif(F.array_position(F.reverse(F.transform(prefix_tokens, lambda c: c <= limit)), True), F.lit(0)), F.size(prefix_tokens) + 1) + 1


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
