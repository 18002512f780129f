"""Byte-level BPE through sentencepiece: a model written from a rank file, no training.

A rank file's tokens are byte strings. Each byte is written as one printable character,
so that a token is a piece; a piece's score is its negative rank, which makes
sentencepiece merge the pair of lowest rank first, the leftmost of equals, as byte-level
BPE does. The normaliser leaves texts as they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quillmap.llm.common import map_portions

#: Pre-tokens whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks must run from 0 without a gap")
    return [token for _, token in ranked]


def byte_characters() -> str:
    """A printable character for each byte, none of them white space to sentencepiece."""
    return "".join(chr(0x100 + b) for b in range(256))


def bpe_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model; a piece's id is its token's rank, unknown comes last."""
    shown = byte_characters()
    model = model_pb2.ModelProto()
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece = "".join(shown[b] for b in token)
        piece.score = -float(rank)
        piece.type = model_pb2.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()
    unknown.piece, unknown.score = "<unk>", 0.0
    unknown.type = model_pb2.ModelProto.SentencePiece.UNKNOWN
    trainer = model.trainer_spec
    trainer.model_type = model_pb2.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(tokens), -1, -1, -1
    normalizer = model.normalizer_spec
    normalizer.name = "identity"
    normalizer.precompiled_charsmap = b""
    normalizer.add_dummy_prefix = False
    normalizer.remove_extra_whitespaces = False
    normalizer.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encodes pre-tokens and decodes ids. Ids of pre-tokens seen before are remembered."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.whole = {token: str(rank) for rank, token in enumerate(tokens)}
        self.shown = byte_characters()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(tokens))
        self.known: dict[str, str] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Encode pre-tokens that are not known yet; a whole token keeps its own id."""
        shown, new, pieces = self.shown, [], []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if (rank := self.whole.get(data)) is not None:
                self.known[word] = rank
            else:
                new.append(word)
                pieces.append("".join([shown[b] for b in data]))
        for word, ids in zip(new, self.processor.encode(pieces, num_threads=1)):
            self.known[word] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimal numbers joined by commas."""
        split = [self.pattern.findall(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn({word for words in split for word in words if word not in self.known})
        return [",".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, map(int, ids.split(",")))) if ids else b""


def encode_documents(docs: DataFrame, tokens: list[bytes], pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, and `token_ids` when asked for.

    A null text counts as empty: no ids. Rows are encoded by themselves; repeated rows
    repeat. The pattern must match every character, so that no text is lost.
    """

    def work():
        bpe = ByteBpe(tokens, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            encoded = bpe.encode([text or "" for text in batch["text"].to_pylist()])
            counts = [row.count(",") + 1 if row else 0 for row in encoded]
            columns = [
                batch["doc_id"],
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(row.encode()).hexdigest() for row in encoded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(row)).hexdigest() for row in encoded], pa.string()),
            ]
            if ids:
                columns.append(
                    pa.array([list(map(int, row.split(","))) if row else [] for row in encoded], pa.list_(pa.int32()))
                )
            return pa.RecordBatch.from_arrays(columns, schema.names)

        return each

    narrow = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *([T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if ids else []),
        ]
    )
    return map_portions(narrow, work, schema)
