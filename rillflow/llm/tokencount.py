"""Token counts by heap-and-linked-list byte-pair merging.

`count_tokens` counts what a sentencepiece BPE model would emit for a text, without making
identifiers: count = initial symbols - merges (+ the further bytes of characters outside the
vocabulary, which byte fallback spells out).

Text is first cut where no merge can pass: before a run of word marks, and around line feeds.
`PieceCounter` checks at load that no piece of the vocabulary spans such a cut. Counts of the
resulting segments are memoised within a bounded table per worker.

Defined results: a null or empty text has 0 tokens; rows are independent, so ties, repeated rows
and clashing extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import Memo, small_batches, texts_of

MARK = "▁"


class PieceCounter:
    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(sp.vocab_size())
        normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: Lower is merged first.
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        self.fallback = any(sp.is_byte(i) for i in ids)
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.rank):
            raise ValueError("a piece spans a word boundary or a line feed; segments would not be independent")
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.memo = Memo(self.merge, 130_000_000)

    def merge(self, segment: str) -> int:
        """Tokens of a segment: symbols in a linked list, adjacent pairs in a heap by (rank, position)."""
        rank = self.rank
        symbol = list(segment)
        n = len(symbol)
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] + symbol[i + 1])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, j, size = heapq.heappop(heap)
            a, b = symbol[i], symbol[j]
            if not a or not b or len(a) + len(b) != size:
                continue  # one side has merged since
            symbol[i], symbol[j] = a + b, ""
            count -= 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = rank.get(symbol[i] + symbol[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, k, size + len(symbol[k])))
            h = left[i]
            if h >= 0:
                r = rank.get(symbol[h] + symbol[i])
                if r is not None:
                    heapq.heappush(heap, (r, h, i, size + len(symbol[h])))
        if self.fallback:
            count += sum(len(s.encode()) - 1 for s in symbol if len(s) == 1 and s not in rank)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.cut.findall(MARK + text.replace(" ", MARK))))


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text of `df`; one scan, no shuffle."""
    small_batches(df.sparkSession)

    def run(batches):
        own = counter(model_path)
        for b in batches:
            texts = texts_of(b.column(1))
            n = [own.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
