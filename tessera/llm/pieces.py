"""SentencePiece encoding and decoding (operator 9).

An Aho-Corasick automaton over the pieces runs once over a text; at each
position its output links name all pieces that end there, and each relaxes the
best score of that position (Viterbi). No piece holds a space or a line break
after another character, so the best path of a text is made of those of its
parts between such places, and each distinct part of a slice is run once.

Scores are those in the model file, and the path is the one whose scores add up to
most. In a BPE model the scores are ranks of merges and no log probabilities, so the
ids are in general not those that the library's merges give (the README has figures);
in a unigram model they are. A character that is no piece costs
``UNKNOWN_COST`` more than the lowest-scored piece and becomes its UTF-8 byte
pieces. Pieces are held with real spaces in place of the model's mark, so a
mark that stands in a text is such a character too, and decoding gives back
exactly what was encoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, documents, strings, table, text_slices, worker_memo

#: The model's mark for a space.
MARK = "▁"
#: By how much an unknown character scores below the lowest piece.
UNKNOWN_COST = 10.0
#: Parts that no piece reaches across.
PART = re.compile("\n| *[^ \n]+| +")

COLUMNS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()),
           ("score", pa.float64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]


class PieceCoder:
    """Encoder and decoder over the pieces of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = [0] * n
        for i in self.byte:
            self.is_byte[i] = 1
        self.unknown = min(m.get_score(i) for i in normal) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton()
        self.text = [b""] * n
        for i in normal:
            piece = m.id_to_piece(i).replace(MARK, " ")
            if len(PART.findall(piece)) > 1:
                raise ValueError(f"piece {i} reaches across the places where texts are split")
            self.automaton.add_word(piece, (len(piece), i, m.get_score(i)))
            self.text[i] = piece.encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.single = {m.id_to_piece(i).replace(MARK, " ") for i in normal if len(m.id_to_piece(i)) == 1}
        self.automaton.make_automaton()

    def best(self, part: str) -> tuple[list[int], float]:
        """Ids of the best path over one part, and its score. Of equal paths, the
        one whose last piece is the longer is taken."""
        score, back = [0.0], [(0, 0)]
        ends = self.automaton.iter(part)
        match = next(ends, None)
        for end, char in enumerate(part, 1):
            top, step = -np.inf, (1, -1)
            if char not in self.single:
                top = score[end - 1] + self.unknown
            while match is not None and match[0] + 1 == end:
                size, i, own = match[1]
                if (s := score[end - size] + own) > top or s == top and size > step[0]:
                    top, step = s, (size, i)
                match = next(ends, None)
            score.append(top)
            back.append(step)
        ids, end = [], len(part)
        while end:
            size, i = back[end]
            ids.extend([i] if i >= 0 else [self.byte[b] for b in reversed(part[end - 1].encode())])
            end -= size
        return ids[::-1], score[-1]

    @staticmethod
    def parts(text: str) -> list[str]:
        """The parts of a text, one leading space added as the model does."""
        return PART.findall(" " + text) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.best(p)[0]]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the ids, without the added leading space."""
        return b"".join(map(self.text.__getitem__, ids))[1:]


class PartMemo(Memo):
    """What each part encodes to: ids as bytes, score, number of byte pieces, and
    what the ids decode to; ``added`` lists the parts new since the last slice."""

    def __init__(self, path: str):
        super().__init__()
        self.coder, self.added = PieceCoder(path), []

    def __missing__(self, part: str) -> tuple[bytes, float, int, bytes]:
        ids, score = self.coder.best(part)
        text = self.coder.text
        self.added.append(part)
        own = self[part] = (np.array(ids, "<u4").tobytes(), score, sum(map(self.coder.is_byte.__getitem__, ids)),
                            b"".join([text[i] for i in ids]))
        return own


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode the texts of ``docs`` (doc_id, text).

    Per row: doc_id, n_bytes, n_pieces, n_byte_pieces, score (sum over the best
    path), ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 of the
    decoded bytes, round_trip (they equal the text) and, if asked for, ids. A
    null or empty text has no pieces and score 0; a null id stays null; repeated
    rows give repeated results; an empty table gives none. Other columns are not
    read.
    """
    columns = COLUMNS + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        known = worker_memo(("parts", path), lambda: PartMemo(path))
        for part in text_slices(batches):
            out = [[] for _ in columns]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part)):
                best = list(map(known.__getitem__, known.coder.parts(text)))
                packed, raw = b"".join([x[0] for x in best]), text.encode()
                decoded = b"".join([x[3] for x in best])[1:]  # without the added space
                row = [doc_id, len(raw), len(packed) // 4, sum([x[2] for x in best]), float(sum([x[1] for x in best])),
                       zlib.crc32(packed), hashlib.sha256(decoded).hexdigest(), decoded == raw]
                for c, v in zip(out, row + [np.frombuffer(packed, "<u4").tolist()] * with_ids):
                    c.append(v)
            known.settle(known.added)
            known.added = []
            yield table(columns, out)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, "
             "decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
