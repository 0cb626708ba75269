"""Token counts: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies, and summed.

No token id is made for a document. A first scan gathers the distinct pre-tokens of the whole corpus with
their frequencies; the pieces of each are counted once. A second scan reduces each document to pre-token
frequencies. The `head` most frequent pre-tokens (a fixed number, so the broadcast is bounded) are joined in
the scan itself; all others are joined by a shuffle on the pre-token.

Pre-tokens: no piece of the vocabulary has its space mark after another character, nor holds a character of
`hard`, so merges never cross those places and counts add up exactly. Both facts are checked on loading.

Nulls and empty texts have 0 bytes and 0 tokens; repeated rows and repeated or null ids each keep their row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import common_words, pick, small_batches, written

MARK = "▁"
HEAD = 300_000
FLUSH = 200_000


class PieceCounter:
    """Splits texts into pre-tokens and counts the pieces of one pre-token."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross spaces; its pre-tokens can't be counted apart")
        used = set("".join(pieces))
        hard = "".join(c for c in "\n\r\t" if c not in used)
        self.newline = "\n" in hard
        self.pattern = re.compile(rf" *[^ {re.escape(hard)}]+| +|[{re.escape(hard)}]" if hard else r" *[^ ]+| +")
        self.hard = set(hard)

    def split(self, text: str | None) -> list[str]:
        """A leading space stands for the mark that the library puts before a text."""
        return self.pattern.findall(" " + text.replace(MARK, " ")) if text else []

    def pieces(self, token: str) -> int:
        if token in self.hard or token == " ":
            return 1
        if token[0] == " ":
            return len(self.sp.encode(token[1:]))
        if not self.newline:
            raise ValueError("a pre-token without a leading space can only follow a hard character")
        return len(self.sp.encode("\n" + token)) - 2


def pretoken_table(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(pretoken, freq, pieces): every distinct pre-token of the corpus, its pieces counted once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = PieceCounter(model), Counter()
        for batch in small_batches(batches, "text"):
            for x in batch.column(0).to_pylist():
                seen.update(counter.split(x))
            if len(seen) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "freq"])
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "freq"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            n = [counter.pieces(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["pretoken", "freq", "pieces"])

    distinct = pick(docs, text).toDF("text").mapInArrow(gather, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return distinct.mapInArrow(count, "pretoken string, freq long, pieces long")


def token_counts(docs: DataFrame, model: str, limit: int = 4096, head: int = HEAD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs."""
    spark = docs.sparkSession
    table = written(pretoken_table(docs, model, text), "pretokens")
    # `head` short strings at most, and the few longer ones that are hot
    top = {r.pretoken: r.pieces for r in common_words(table, "pretoken", "freq", head).select("pretoken", "pieces").collect()}
    shared = spark.sparkContext.broadcast(top)

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = PieceCounter(model), shared.value
        for batch in small_batches(batches, "text"):
            sums, rest = [], []
            for x in batch.column(2).to_pylist():
                freq = Counter(counter.split(x))
                late, total = [], 0
                for token, n in freq.items():
                    if (k := known.get(token)) is None:
                        late.append({"pretoken": token, "n": n})
                    else:
                        total += k * n
                sums.append(total)
                rest.append(late)
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column(2)), pa.int64()), 0)
            kind = pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array(sums, pa.int64()), pa.array(rest, kind)], ["row", "doc_id", "n_bytes", "known", "rest"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    reduced = written(rows.mapInArrow(per_document, f"row long, doc_id {kind}, n_bytes long, known long, rest array<struct<pretoken: string, n: long>>"), "frequencies")
    late = reduced.select("row", F.explode("rest").alias("r")).select("row", "r.pretoken", "r.n")
    parts = late.join(table.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("late"))
    counted = reduced.select("row", "doc_id", "n_bytes", "known").join(parts, "row", "left")
    total = F.col("known") + F.coalesce(F.col("late"), F.lit(0))
    return counted.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
