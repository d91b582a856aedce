"""Token counts of a unigram tokenizer without tokens: Aho-Corasick matches feed a Viterbi count.

The vocabulary's matches in a word come from one automaton pass. The dynamic program carries,
for each position, the best score and how many pieces the best path has, and no path. Positions
further back than the longest piece are forgotten, so a long word takes no memory but for its text. Ties are
those of the tokenizer: positions in order, earlier starts first, only a strictly better score
replaces; a character that no piece is costs the least score less ten, and a run of such
characters is one piece. The scores derive from the public vocabulary's rank (log of rank plus
two); nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_of

UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words that a worker remembers; the memory is emptied when full.
REMEMBERED = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a public piece model, by rank; special and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0)] + [(model.id_to_piece(i), -math.log(rank + 2.0)) for rank, i in enumerate(plain)]


class Counter:
    """Counts pieces of texts for a vocabulary whose first entry is the unknown piece."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        self.longest = max((len(piece) for piece, _ in pieces[1:]), default=1)
        self.single = set()
        for piece, score in pieces[1:]:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memory: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        """(pieces, unknown pieces) of one word."""
        n, ring = len(word), self.longest + 1
        best, count, unknown, last = [0.0] * ring, [0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(word)
        at, match = next(matches, (n, None))
        single, odd = self.single, self.unknown
        for end in range(1, n + 1):
            here: list = []
            while at < end:
                here.append(match)
                at, match = next(matches, (n, None))
            top, start, known = None, end - 1, True
            if len(here) > 1:
                here.sort(reverse=True)
            for size, score in here:
                total = best[(end - size) % ring] + score
                if top is None or total > top:
                    top, start = total, end - size
            if word[end - 1] not in single:
                total = best[(end - 1) % ring] + odd
                if top is None or total > top:
                    top, start, known = total, end - 1, False
            start, now = start % ring, end % ring
            fused = not known and last[start]
            best[now], last[now] = top, not known
            count[now], unknown[now] = count[start] + (not fused), unknown[start] + (not known and not fused)
        return count[n % ring], unknown[n % ring]

    def text(self, text: str) -> tuple[int, int]:
        """(pieces, unknown pieces); words end before each space, which becomes a mark in front."""
        if not text:
            return 0, 0
        memory, total, odd = self.memory, 0, 0
        parts = text.replace(SPACE, " ").split(" ")
        if parts[0] == "" and len(parts) > 1:
            parts = parts[1:]
        for part in parts:
            found = memory.get(part)
            if found is None:
                found = self.word(SPACE + part)
                if len(part) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[part] = found
            total += found[0]
            odd += found[1]
        return total, odd


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_unknown and n_chars of every row.

    Null and empty texts have no tokens; repeated rows each get a row; other columns are ignored;
    an empty table gives an empty result; ids may be of any simple type.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for batch in batches:
            rows = [(*counter.text(t), len(t)) for t in batch.column(1).to_pylist()]
            made = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(made[:, i].copy()) for i in range(3)]], names=["id", "n_tokens", "n_unknown", "n_chars"])

    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return base.mapInArrow(run, f"id {id_type}, n_tokens long, n_unknown long, n_chars long").withColumnRenamed("id", id_col)
