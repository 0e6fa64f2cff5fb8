"""Token counts of whole texts by a byte-level BPE vocabulary.

Two tiers, both on the map side, so that no pre-token is ever shuffled: a compact table with
the lengths of frequent pre-tokens is broadcast; what it misses is encoded by the library and
remembered in a cache of the worker. The table and the cache only save time: every length in
them comes from the library, so neither can change a result.
"""

from __future__ import annotations

import functools
import heapq
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level vocabularies, with white space as Unicode has it.
_S = r"\t-\r\x20\x85\xa0  -     　"
_PRE_TOKEN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

#: Texts above this many characters are matched one pre-token at a time, to hold no long list.
_LONG = 4_000_000


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def _pattern():
    return regex.compile(_PRE_TOKEN)


class _Lengths(dict):
    """Pre-token to its number of tokens. A miss is encoded once; a full cache is emptied."""

    def __init__(self, path: str, frequent: dict[str, int], most: int):
        super().__init__(frequent)
        self.path, self.frequent, self.most = path, frequent, most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        n = len(_tokenizer(self.path).encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = n
        return n


_caches: dict[tuple, _Lengths] = {}


def _special(path: str):
    """Matches the added special strings, which the library takes out of a text first."""
    added = [x.content for x in _tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None


def _count(text: str, lengths: _Lengths, special) -> int:
    n = 0
    parts = [text]
    if special is not None and (found := special.findall(text)):
        n, parts = len(found), special.split(text)
    for part in parts:
        if len(part) < _LONG:
            n += sum(map(lengths.__getitem__, _pattern().findall(part)))
        else:
            n += sum(lengths[m.group()] for m in _pattern().finditer(part))
    return n


def _frequent(docs: DataFrame, text: str, path: str, table_size: int, sample_rows: int) -> dict[str, int]:
    """Lengths of the pre-tokens that are frequent in a bounded sample of the rows.

    At most ``table_size`` rows reach the driver: eight tasks each send their most frequent eighth."""
    total = docs.count()
    if not total:
        return {}
    share = table_size // 8

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(_pattern().findall(t) if t else ())
        best = heapq.nlargest(share, ((n, p) for p, n in seen.items() if n > 1 and len(p) <= 64))
        yield pa.RecordBatch.from_arrays([pa.array([p for _, p in best], pa.string())], ["piece"])

    drawn = docs.select(text).sample(min(1.0, sample_rows / total), seed=17).repartition(8)
    pieces = sorted({r.piece for r in drawn.mapInArrow(top, "piece string").collect()})
    tok = _tokenizer(path)
    return {p: len(e.ids) for p, e in zip(pieces, tok.encode_batch(pieces, add_special_tokens=False), strict=True)}


def token_count(docs: DataFrame, tokenizer_path: str, text: str = "text", table_size: int = 65_536, sample_rows: int = 8_192, cache_size: int = 400_000) -> Column:
    """A column expression with the number of tokens of ``text`` for rows of ``docs``.

    ``sample_rows`` bounds the rows looked at for the table of frequent pre-tokens; every text is counted
    whole. Keys aren't looked at, so null and repeated ones are harmless. A null or empty text has 0 tokens. The vocabulary file must be readable at
    ``tokenizer_path`` on every machine. Two equal rows give equal counts; other columns don't matter."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text, tokenizer_path, table_size, sample_rows))
    key = (tokenizer_path, uuid.uuid4().hex)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        if key not in _caches:
            _caches.clear()
            _caches[key] = _Lengths(tokenizer_path, frequent.value, max(cache_size, 2 * len(frequent.value)))
        lengths, special = _caches[key], _special(tokenizer_path)
        return pa.array([_count(t.as_py(), lengths, special) if t.is_valid else 0 for t in texts], pa.int64())

    return count(F.col(text))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", **kind) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); columns of these names are replaced."""
    n = token_count(docs, tokenizer_path, text, **kind)
    return docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "n_tokens": n}).withColumn("over_limit", F.col("n_tokens") > limit)
