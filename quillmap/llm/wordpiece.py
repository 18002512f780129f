"""Token counts by a linear longest-match automaton over a vocabulary trie.

A node of the trie stands for a string that starts a piece. When no child fits the next
character, the failure link leads to the node for what remains after the longest pieces
are taken off the front; how many pieces that takes off is counted once, when the
automaton is built. A word's count then takes time linear in its length and builds none
of its pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmap.llm.common import map_portions

#: Marks the start of a word in the vocabulary's pieces.
WORD_START = "▁"
#: Words whose counts a task remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model; those of a word's start carry WORD_START."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class LongestMatch:
    """Counts the pieces of greedy longest match. 0 stands for a word that has none."""

    ROOT = 0  # of the pieces that go on within a word

    def __init__(self, pieces: Iterable[str], start: str = WORD_START):
        self.start = start
        self.children: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            if not piece:
                continue
            node = self.ROOT
            for c in piece:
                child = self.children[node].get(c)
                if child is None:
                    child = self.children[node][c] = len(self.children)
                    self.children.append({})
                    ends.append(False)
                node = child
            ends[node] = True
        self.fail = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = deque([(self.ROOT, c, child) for c, child in self.children[self.ROOT].items()])
        while queue:
            parent, c, node = queue.popleft()
            if ends[node]:
                self.fail[node], self.popped[node] = self.ROOT, 1
            else:
                link, count = self.fail[parent], self.popped[parent]
                while link >= 0 and c not in self.children[link]:
                    count += self.popped[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[node], self.popped[node] = self.children[link][c], count
            queue.extend((node, c, child) for c, child in self.children[node].items())

    def count(self, word: str) -> int:
        children, fail, popped = self.children, self.fail, self.popped
        node = count = 0
        for c in self.start + word:
            while (child := children[node].get(c)) is None:
                link = fail[node]
                if link < 0:
                    return 0
                count += popped[node]
                node = link
            node = child
        while node:
            link = fail[node]
            if link < 0:
                return 0
            count += popped[node]
            node = link
        return count


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown_words of every whole text.

    Words stand between white space bytes; a word that the vocabulary cannot spell counts
    as one (unknown) token. Null and empty texts have no tokens. Rows are counted by
    themselves; other columns are not read.
    """

    def work():
        automaton = LongestMatch(pieces)
        known: dict[bytes, int] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(known) > REMEMBERED:
                known.clear()
            rows = []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                for word in set(words).difference(known):
                    known[word] = automaton.count(word.decode("utf-8", "replace"))
                counts = [known[word] for word in words]
                unknown = counts.count(0)
                rows.append((len(words), sum(counts) + unknown, unknown))
            columns = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns)], schema.names)

        return each

    narrow = docs.select("doc_id", "text")
    counts = ("n_words", "n_tokens", "n_unknown_words")
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in counts)])
    return map_portions(narrow, work, schema)
