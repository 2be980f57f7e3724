"""Operator 10: token counts by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files, described by its README.
VOCAB_DIR = os.environ.get("WAKELINE_TOKENIZERS", "/opt/tokenizers")
VOCAB_FILE = "piece_bpe_32k.model"
#: Mark that stands for the space before a word in the vocabulary.
SPACE = "▁"
UNKNOWN = -25.0


def load_pieces(path: str) -> dict[str, float]:
    """Unigram scores of the pieces: log frequencies by Zipf's law over the vocabulary's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(usable) + 1)))
    return {p: -math.log(rank) - total for rank, p in enumerate(usable, 1)}


class TrieCounter:
    """Best segmentation of words under unigram scores, shared by all words with a common prefix.

    Each trie node holds the best score of the prefix it ends and how many tokens that takes, so a
    prefix is scored once for all words. A character no piece covers costs one byte token for each of
    its UTF-8 bytes. Equal scores prefer fewer tokens. Past `max_nodes` the trie starts anew, which
    costs time and changes no count. Words of over `LONG` characters share no prefix worth keeping: they are scored
    with the last few prefixes only, so memory is bounded however long a word is.
    """

    LONG = 64

    def __init__(self, pieces: dict[str, float], max_nodes: int = 600_000):
        self.max_nodes = max_nodes
        #: Every ending of a piece, with the score of those that are pieces: a longer ending than these is none.
        self.endings: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))}
        self.endings.update(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node << 21 | code point
        self.best = [0.0]
        self.tokens = [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(self.best) > self.max_nodes:
            self.clear()
        marked = SPACE + word
        if len(marked) > self.LONG:
            return self.count_long(marked)
        node, path, child, endings = 0, [0], self.child, self.endings
        for depth, char in enumerate(marked, 1):
            edge = node << 21 | ord(char)
            at = child.get(edge)
            if at is None:
                n = len(char.encode("utf-8", "replace"))
                top, least = self.best[node] + UNKNOWN * n, self.tokens[node] + n
                for start in range(depth - 1, -1, -1):
                    score = endings.get(marked[start:depth], 0.0)
                    if score is None:
                        continue
                    if score == 0.0:
                        break
                    from_node = path[start]
                    score += self.best[from_node]
                    if score > top or score == top and self.tokens[from_node] + 1 < least:
                        top, least = score, self.tokens[from_node] + 1
                at = child[edge] = len(self.best)
                self.best.append(top)
                self.tokens.append(least)
            path.append(at)
            node = at
        self.terminal[word] = self.tokens[node]
        return self.tokens[node]

    def count_long(self, marked: str) -> int:
        """The same recurrence; a ring holds the prefixes that a piece may still start at."""
        room, endings = self.longest + 1, self.endings
        best, tokens = [0.0] * room, [0] * room
        for depth, char in enumerate(marked, 1):
            n = len(char.encode("utf-8", "replace"))
            top, least = best[(depth - 1) % room] + UNKNOWN * n, tokens[(depth - 1) % room] + n
            for start in range(depth - 1, -1, -1):
                score = endings.get(marked[start:depth], 0.0)
                if score is None:
                    continue
                if score == 0.0:
                    break
                at = start % room
                score += best[at]
                if score > top or score == top and tokens[at] + 1 < least:
                    top, least = score, tokens[at] + 1
            best[depth % room], tokens[depth % room] = top, least
        return tokens[len(marked) % room]


def count_tokens(docs: DataFrame, vocab: str = f"{VOCAB_DIR}/{VOCAB_FILE}") -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text; words are split at white space.

    Null and empty texts have none; repeated rows are counted one by one; an empty table gives none;
    other columns are ignored. The vocabulary file must exist at the same path on every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieCounter(load_pieces(vocab))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                own = (text or "").split()
                known = list(map(trie.terminal.get, own, repeat(-1)))
                if -1 in known:
                    known = [n if n >= 0 else trie.count(w) for w, n in zip(own, known)]
                words.append(len(own))
                tokens.append(sum(known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_tokens bigint")
