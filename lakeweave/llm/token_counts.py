"""Operator 8: token counts under a unigram model, by a trie of pre-tokens.

The forward score of a prefix is the best log-probability of any way to cut it
into vocabulary pieces; it depends on the prefix alone, so pre-tokens that begin
alike share it. The distinct new pre-tokens of a run of texts are walked in
sorted order, which visits their trie in preorder: the stack holds the forward
scores and piece counts of the path to the current node, each computed once, and
every pre-token's terminal node stores its count, score and bytes left over.
Texts then only look up terminals.

The vocabulary is that of a public sentencepiece file, as it is. Piece number i
(from 1, in the file's order, which is by decreasing frequency) gets the
probability of Zipf's law, 1 / (i * H). A character in no piece is spelled in
its UTF-8 bytes, each at the least piece score less ``BYTE_PENALTY``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.text import chunks, table

BYTE_PENALTY = 10.0
SPACE = "▁"  # the vocabulary's mark of a word's beginning


def zipf_scores(model_path: str) -> dict[str, float]:
    """Natural log-probability of each ordinary piece of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1.0 / i for i in range(1, len(pieces) + 1)))
    return {p: -math.log(i) - norm for i, p in enumerate(pieces, 1)}


class ForwardTrie:
    """Terminal (tokens, byte tokens, score) of every pre-token met so far."""

    def __init__(self, scores: dict[str, float], max_terminals: int = 400_000):
        self.floor = min(scores.values()) - BYTE_PENALTY
        self.max_terminals = max_terminals
        # pieces from their last character backwards; key "" holds the score
        self.ends: dict = {}
        for piece, score in scores.items():
            node = self.ends
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = score
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.tokens: list[int] = []
        self.bytes: list[int] = []
        self.scores: list[float] = []

    def insert(self, pretokens) -> None:
        """Add pre-tokens not met yet. Of equal scores the cut with fewer tokens
        wins, then the one with the longer last piece."""
        best, count, nbytes = [0.0], [0], [0]
        last, ends, floor = "", self.ends, self.floor
        for word in sorted(pretokens):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], count[shared + 1:], nbytes[shared + 1:]
            for i in range(shared, len(word)):
                spelled = len(word[i].encode("utf-8", "surrogatepass"))
                top, n, b = best[i] + spelled * floor, count[i] + spelled, nbytes[i] + spelled
                node, j = ends, i
                while j >= 0 and (node := node.get(word[j])) is not None:
                    score = node.get("")
                    if score is not None:
                        s = best[j] + score
                        if s > top or (s == top and count[j] + 1 <= n):
                            top, n, b = s, count[j] + 1, nbytes[j]
                    j -= 1
                best.append(top)
                count.append(n)
                nbytes.append(b)
            last = word
            self.place[word] = len(self.tokens)
            self.tokens.append(count[-1])
            self.bytes.append(nbytes[-1])
            self.scores.append(best[-1])

    def count(self, texts: list[str]) -> list[tuple[int, int, int, float]]:
        """(pre-tokens, tokens, byte tokens, score) of each text."""
        if len(self.place) > self.max_terminals:
            self.clear()
        words = [[SPACE + w for w in t.split()] for t in texts]
        place = self.place
        self.insert({w for ws in words for w in ws if w not in place})
        tokens, nbytes, scores = np.array(self.tokens, np.int64), np.array(self.bytes, np.int64), np.array(self.scores)
        out = []
        for ws in words:
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            out.append((len(ws), int(tokens[at].sum()), int(nbytes[at].sum()), math.fsum(scores[at])))
        return out


def unigram_token_counts(docs: DataFrame, scores: dict[str, float], text: str = "text",
                         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``n_pretokens``, ``n_tokens``, ``n_byte_tokens`` and
    ``log_score`` (natural log of the best cut) of every whole text.

    One pass, no shuffle. A null or blank text has no tokens and score 0. The
    trie's terminals are dropped and started anew when they exceed a size; that
    changes no result."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(scores)  # one vocabulary, about 1 MB
    names = ("n_pretokens", "n_tokens", "n_byte_tokens")
    schema = docs.select(*keep).schema
    for c in names:
        schema = schema.add(c, "long")
    schema = schema.add("log_score", "double")

    def run(batches):
        trie = ForwardTrie(vocabulary.value)
        for batch in batches:
            rows = [r for part in chunks(batch.column(len(keep)).to_pylist(), len, 1 << 22) for r in trie.count(part)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())],
                names=schema.names)

    return docs.select(*keep, F.coalesce(docs[text], F.lit(""))).mapInArrow(run, schema)


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unigram_token_counts(table(spark, sf_dir, "documents"),
                                zipf_scores(public_tokenizers.path("piece_bpe_32k.model")))
