"""Token counts of a sentencepiece BPE model by the whole-token shortcut.

Before any text is read, the vocabulary is checked: which of its strings does the library encode
alone as one token? Those are counted by lookup. The text is cut where no piece of the vocabulary
reaches across: before a run of blanks (the model's blank sign stands only at the start of a piece,
or in pieces of nothing else) and around characters that no piece holds at all. Only the pre-tokens
without a proof are merged by the library, each once while it stays in the task's memo.

``check_model`` verifies these properties and raises for a model that lacks them.

Empty and null texts have no bytes and no tokens. Rows with the same id are counted each on its own;
other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MEMO_WORDS = 400_000
MEMO_LENGTH = 64
ROWS = 500


class PieceCounter:
    """Counts the tokens of whole texts as the library's ``encode`` would give them."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.check_model(pieces)
        candidates = [p[1:] for p in pieces if p[0] == BLANK and p[1:].strip(BLANK) and not re.search(r"\s", p)]
        found = self.model.encode(candidates, num_threads=1)
        self.proven = {w: 1 for w, ids in zip(candidates, found, strict=True) if len(ids) == 1}
        inner = [p for p in pieces if not p.startswith(BLANK) and not re.fullmatch(r"<0x..>|</?s>|<unk>", p)]
        alone = self.model.encode(["\n" + p for p in inner], num_threads=1)
        self.proven_inside = {w: 1 for w, ids in zip(inner, alone, strict=True) if len(ids) == 3}
        self.after_blank = Memo(self.proven, self._after_blank)
        self.inside = Memo(self.proven_inside, self._inside)

    def check_model(self, pieces: list[str]) -> None:
        m = self.model
        probe = "a  \ufb01 \n b"
        if m.encode("") or not m.encode("a", out_type=str)[0].startswith(BLANK) or m.decode(m.encode(probe)) != probe:
            raise ValueError("the model does not put a blank before the text, or normalizes it")
        for p in pieces:
            if "\n" in p or (BLANK in p[1:] and p.strip(BLANK)):
                raise ValueError(f"piece {p!r} reaches over a cut")

    def _after_blank(self, word: str) -> int:
        return len(self.model.encode(word))

    def _inside(self, word: str) -> int:
        # Blank sign and line feed are two tokens of their own: neither is in a piece with a letter.
        return len(self.model.encode("\n" + word)) - 2

    def _line(self, line: str, memo: Memo, first: bool) -> int:
        """Tokens of the text between two line feeds; ``first``: a blank sign stands before it."""
        parts = line.split(" ")
        total = 0
        if not first:
            total = self.inside[parts[0]] if parts[0] else 0
            parts = parts[1:]
            if not parts:
                return total
        if "" not in parts:
            return total + sum(map(memo.__getitem__, parts))
        run = 0
        for p in parts:
            if p == "":
                run += 1
            elif run:
                total += len(self.model.encode(" " * run + p))
                run = 0
            else:
                total += memo[p]
        if run:
            total += len(self.model.encode(" " * (run - 1))) if run > 1 else 1
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        """Counts of many texts; pre-tokens not met before are merged in one call."""
        known = self.after_blank
        fresh = set().union(*(t.split() for t in texts if t)).difference(known)
        fresh = [w for w in fresh if len(w) <= MEMO_LENGTH and BLANK not in w]
        if len(known) + len(fresh) > len(known.proven) + MEMO_WORDS:
            known.clear()
            known.update(known.proven)
        known.update(zip(fresh, map(len, self.model.encode(fresh, num_threads=1)), strict=True))
        return [self.count(t) if t else 0 for t in texts]

    def count(self, text: str) -> int:
        if not text:
            return 0
        lines = text.replace(BLANK, " ").split("\n")
        total = len(lines) - 1 + self._line(lines[0], self.after_blank, True)
        for line in lines[1:]:
            if line:
                total += self._line(line, self.after_blank, False)
        return total


class Memo(dict):
    """Proven counts and those of pre-tokens merged so far; starts anew when it is full."""

    def __init__(self, proven: dict[str, int], merge):
        super().__init__(proven)
        self.proven, self.merge = proven, merge

    def __missing__(self, word: str) -> int:
        n = self.merge(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) > len(self.proven) + MEMO_WORDS:
                self.clear()
                self.update(self.proven)
            self[word] = n
        return n


def token_counts(
    docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``model`` is a path all tasks can read,
    by default that of the public vocabulary."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = PieceCounter(model or public_tokenizers.path(MODEL))
        for batch in batches:
            texts = batch.column(1)
            n: list[int] = []
            for k in range(0, len(texts), ROWS):
                n += counter.counts(texts.slice(k, ROWS).to_pylist())
            n = pa.array(n, pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
