"""Token counts under a unigram vocabulary: pre-tokens in a trie, one forward score for each shared prefix."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.llm.texts import byte_texts

#: A run of other bytes than ASCII white space, with one space before it if there is one; else one white-space byte.
PRE_TOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")
LONG = 256


def rank_scores(path: str) -> dict[bytes, float]:
    """Log-probabilities of a rank file's tokens by Zipf's law: the token of rank r has a share of 1 / (r + 1)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: -math.log(r + 1) - total for t, r in ranks.items()}


class Trie:
    """Forward scores of prefixes: per node the best log-probability of a split of its prefix, and the tokens of that split.

    A node's score needs only those of its ancestors, so a prefix that many pre-tokens share is scored
    once. Of equal scores the split with fewer tokens counts; a byte that no token covers counts as one token of
    the least score. Past ``max_nodes``, or ``max_bytes`` of remembered pre-tokens, the trie starts anew, and a pre-token of more
    than 256 bytes is scored without nodes; neither changes a result.
    """

    def __init__(self, scores: dict[bytes, float], max_nodes: int = 1_000_000, max_bytes: int = 64 << 20):
        self.scores, self.max_nodes, self.max_bytes = scores, max_nodes, max_bytes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 1.0
        self._start_anew()

    def _start_anew(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[bytes, int] = {}
        self.kept_bytes = 0

    def _forward(self, word: bytes, end: int, before: list[tuple[float, int]]) -> tuple[float, int]:
        """The best of ``word[:end]``, given those of all shorter prefixes; (score, minus the tokens)."""
        found = None
        for begin in range(max(0, end - self.longest), end):
            step = self.scores.get(word[begin:end])
            if step is None:
                if begin < end - 1:
                    continue
                step = self.unknown
            score, tokens = before[begin]
            if found is None or (score + step, tokens - 1) > found:
                found = (score + step, tokens - 1)
        return found

    def __getitem__(self, word: bytes) -> int:
        """Tokens of a pre-token."""
        tokens = self.terminal.get(word)
        if tokens is None:
            tokens = self._insert(word)
            if len(word) <= self.max_bytes:
                self.terminal[word] = tokens
                self.kept_bytes += len(word)
        return tokens

    def _insert(self, word: bytes) -> int:
        if max(len(self.best), len(self.terminal)) > self.max_nodes or self.kept_bytes + len(word) > self.max_bytes:
            self._start_anew()
        path = [(0.0, 0)]
        if len(word) > LONG:
            for end in range(1, len(word) + 1):
                path.append(self._forward(word, end, path))
            return -path[-1][1]
        node = 0
        for end, octet in enumerate(word, 1):
            key = node << 8 | octet
            node = self.child.get(key, 0)
            if not node:
                node = self.child[key] = len(self.best)
                self.best.append(self._forward(word, end, path))
            path.append(self.best[node])
        return -path[-1][1]


_TRIES: dict[str, Trie] = {}


def trie_of(vocabulary: str) -> Trie:
    """This Python worker's trie for a rank file."""
    if vocabulary not in _TRIES:
        _TRIES[vocabulary] = Trie(rank_scores(vocabulary))
    return _TRIES[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` for every row, over its whole text.

    ``vocabulary`` is a rank file. Each Python worker keeps one trie for its tasks, so there is no shuffle. A
    null or empty text has none of either; repeated rows keep their rows; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(vocabulary)
        for batch in batches:
            words, tokens = [], []
            for text in byte_texts(batch):
                cut = PRE_TOKEN.findall(text)
                words.append(len(cut))
                tokens.append(sum(map(trie.__getitem__, cut)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
