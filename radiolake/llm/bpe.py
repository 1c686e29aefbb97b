"""Byte-pair encoding of whole corpora, by merge rounds over many words at once.

The words of a batch lie in one flat array of symbols. A round looks up the rank of
every neighbouring pair by binary search in the sorted pair keys, finds each word's
lowest rank and merges there; words without a mergeable pair leave the array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies on every machine of the cluster.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHIFT = 20
_NONE = np.iinfo(np.int64).max
#: Words kept in a worker's memory between batches; only speed depends on it.
KNOWN_WORDS = 300_000


class Bpe:
    def __init__(self, path: str) -> None:
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                word, rank = line.split()
                ranks[base64.b64decode(word)] = int(rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << _SHIFT | b)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.values = np.array(values, dtype=np.int64)[order]
        # A symbol that can take part in a pair of a lower rank than its own: after such
        # a merge the next one may have to come first, so only the first place merges.
        self.early = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for side in (self.keys >> _SHIFT, self.keys & ((1 << _SHIFT) - 1)):
            self.early[side[self.values < side]] = True
        self.known: dict[str, np.ndarray] = {}
        self.split = regex.compile(PATTERN).findall

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(sym):
            # Ranks of each symbol with its right neighbour in the same word.
            rank = np.full(len(sym), _NONE)
            same = word[:-1] == word[1:]
            rank[:-1][same] = self.pair_ranks(sym[:-1][same], sym[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            ended = lowest == _NONE
            if ended.any():
                for s, n in zip(starts[ended].tolist(), lengths[ended].tolist()):
                    out[word[s]] = sym[s : s + n].astype(np.int32)
                stay = np.repeat(~ended, lengths)
                sym, word, rank = sym[stay], word[stay], rank[stay]
                lowest, lengths = lowest[~ended], lengths[~ended]
                if not len(sym):
                    break
            low = np.repeat(lowest, lengths)
            hit = np.flatnonzero(rank == low)
            # In a run of overlapping places every other one merges, from the left; where
            # a lower rank may come up, only the first place of the word.
            run = np.cumsum(np.r_[True, np.diff(hit) > 1]) - 1
            first = np.flatnonzero(np.r_[True, np.diff(run) > 0])
            odd = (np.arange(len(hit)) - first[run]) % 2 == 1
            again = np.r_[False, word[hit][1:] == word[hit][:-1]] & self.early[low[hit]]
            hit = hit[~(odd | again)]
            sym[hit] = low[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
            new = list({w for words in split for w in words})
        self.known.update(zip(new, self.encode_words([w.encode() for w in new])))
        none = np.empty(0, np.int32)
        return [np.concatenate([self.known[w] for w in words]) if words else none for words in split]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its files make fewer tasks than three a core; other inputs keep
    their splits. Only the plan depends on it: the rows are the same."""
    wanted = 3 * df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()  # of the scan: nothing runs
    return df.repartition(wanted, key) if tasks < wanted else df


def encode(df: DataFrame, key: str, text: str, keep: list[str] | None = None, tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """key, the columns to keep and ids (array of int), one row per row of df.

    Special tokens are not added and their strings are ordinary text. Null and empty
    texts have the empty list. Whole texts are encoded, whatever their length.
    """
    cols = [key, *(keep or [])]
    path = f"{tokenizers}/{ranks}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            out = batch[cols].copy()
            out["ids"] = bpe.encode_batch([t if isinstance(t, str) else None for t in batch["_text"].tolist()])
            yield out

    source = df.select(*cols, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", ids array<int>"
    return spread(source, key).mapInPandas(run, schema)
