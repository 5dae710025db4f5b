"""Token counts by greedy longest match in linear time: a vocabulary trie with failure links and precomputed pop counts.

Each trie node knows how many tokens greedy matching has certainly ended when no child fits the next character (pops), and
the node that stands for what is left of the text read since (fail). A word is read once, adding pops, and no piece is ever
built. Characters that no token starts with fall back to one token for each UTF-8 byte.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from .common import map_batches, whole, words

START = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.pops, self.fail = [0], [0]
        token = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                if (to := self.children[at].get(c)) is None:
                    to = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.pops.append(0), self.fail.append(0), token.append(False)
                at = to
            token[at] = at > 0
        queue = deque((0, c, v) for c, v in self.children[0].items())
        while queue:  # breadth first: a node's parent and its shorter remainders are done before it
            parent, c, v = queue.popleft()
            queue.extend((v, x, w) for x, w in self.children[v].items())
            if token[v] or parent == 0:
                self.pops[v] = 1 if token[v] else len(c.encode())
                continue
            pops, at = self.pops[parent], self.fail[parent]
            while c not in self.children[at]:
                if at == 0:
                    pops += len(c.encode())
                    break
                pops, at = pops + self.pops[at], self.fail[at]
            self.pops[v], self.fail[v] = pops, self.children[at].get(c, 0)

    def count(self, word: str) -> int:
        children, pops, fail = self.children, self.pops, self.fail
        at = n = 0
        for c in word:
            while (to := children[at].get(c)) is None:
                if at == 0:
                    n += len(c.encode())
                    to = 0
                    break
                n += pops[at]
                at = fail[at]
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n


_BUILT: dict[int, Automaton] = {}


def count_tokens(df: DataFrame, vocabulary: list[str], text_col: str = "text", start: str = START) -> DataFrame:
    """``df`` with long columns n_words and n_tokens: each ASCII-white-space word, with ``start`` before it, by greedy longest match.

    A null or empty text has 0 of both. Old columns of these names are replaced. The vocabulary, of a tokenizer file's size,
    goes to the tasks with the function.
    """
    base = df.drop("n_words", "n_tokens")
    names = base.columns
    schema = StructType([*base.schema.fields]).add("n_words", LongType()).add("n_tokens", LongType())
    mark = hash((tuple(vocabulary), start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _BUILT:
            _BUILT.clear()
            _BUILT[mark] = Automaton(vocabulary)
        count, known = _BUILT[mark].count, {}
        for b in batches:
            distinct, index, offsets = words(whole(b.column(names.index(text_col))))
            if len(known) > 500_000:
                known.clear()
            lengths = []
            for w in distinct.to_pylist():
                if (n := known.get(w)) is None:
                    n = known[w] = count(start + w)
                lengths.append(n)
            sums = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64)[index])]) if len(index) else np.zeros(1, np.int64)
            tokens = sums[offsets[1:]] - sums[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(offsets)), pa.array(tokens)], [*names, "n_words", "n_tokens"])

    return map_batches(base, run, schema)


def op4_longest_match(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Greedy token counts of all documents in a public 32,000-piece vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, read_pieces(vocabulary)).select("doc_id", "n_words", "n_tokens")
