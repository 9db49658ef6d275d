"""Problem 2: exact longest-match token counts in linear time, and totals by slice.

The vocabulary is a trie whose nodes have failure links: from a node that no child continues, the link leads to the
node of what remains after the longest tokens are taken off its front, and the number of those tokens is stored with
it. Each character of a text is therefore read once, however often a greedy match would have to start again.

Results: null and empty texts count zero tokens. Spellings of data set, language and host are brought together; a
missing one is "unknown". Where a crawl row comes twice, the one that came last counts. `tokens` is the budget: the
tokens that the tokenizer itself makes. `longest_match_tokens` is what longest match over its vocabulary would make.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import MEMORY, ByteBPE, distinct, pre_tokens, tokenizer
from .text_batch import TextBlock, blocks


class SubwordTrie:
    """Longest-match counts over a vocabulary that holds every single character it may meet."""

    def __init__(self, vocabulary: Sequence[str]):
        edges: list[dict[str, int]] = [{}]
        ends, parent, char = [False], [0], [""]
        for token in vocabulary:
            node = 0
            for c in token:
                nxt = edges[node].get(c)
                if nxt is None:
                    nxt = edges[node][c] = len(edges)
                    edges.append({})
                    ends.append(False)
                    parent.append(node)
                    char.append(c)
                node = nxt
            ends[node] = node != 0
        link, taken = [-1] * len(edges), [0] * len(edges)
        queue = deque(edges[0].values())
        while queue:
            node = queue.popleft()
            if ends[node]:
                link[node], taken[node] = 0, 1
            else:
                up, count = link[parent[node]], taken[parent[node]]
                while up >= 0 and char[node] not in edges[up]:
                    count += taken[up]
                    up = link[up]
                if up >= 0:
                    link[node], taken[node] = edges[up][char[node]], count
            queue.extend(edges[node].values())
        self.edges, self.link, self.taken = edges, link, taken

    def count(self, text: str) -> int:
        """Number of longest-match tokens; a character outside the vocabulary counts as one."""
        edges, link, taken = self.edges, self.link, self.taken
        node = total = 0
        for c in text:
            while (nxt := edges[node].get(c)) is None and node and link[node] >= 0:
                total += taken[node]
                node = link[node]
            if nxt is None:
                total += 1
                node = 0
            else:
                node = nxt
        while node and link[node] >= 0:
            total += taken[node]
            node = link[node]
        return total


@functools.cache
def _trie(path: str) -> tuple[ByteBPE, SubwordTrie, dict[str, tuple[int, int]]]:
    bpe = tokenizer(path)
    return bpe, SubwordTrie(list(bpe.rank)), {}


def both_counts(path: str, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Longest-match tokens and merge (BPE) tokens of each text. Each distinct pre-token is counted once."""
    bpe, trie, memory = _trie(path)
    start, end = pre_tokens(block)
    if not len(start):
        return np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    names, inverse = distinct(block, start, end)
    counts = []
    for name in names:
        found = memory.get(name)
        if found is None:
            if len(memory) >= MEMORY:
                memory.clear()
            latin = name.encode("utf-8", "surrogatepass").decode("latin-1")
            found = memory[name] = (trie.count(latin), len(bpe.encode_token(name)))
        counts.append(found)
    each = np.array(counts, np.int64)[inverse]
    at = np.searchsorted(start, block.text_end, side="left")
    total = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(each, 0)))[np.concatenate(([0], at))]
    return tuple(np.diff(total, axis=0).T)


def data_set_name(column: Column) -> Column:
    """One spelling of a data set: lower case, letters and digits only."""
    name = F.regexp_replace(F.lower(column), "[^a-z0-9]", "")
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(name)


def language_code(column: Column) -> Column:
    """Two letters: en for EN, en-GB, eng_Latn."""
    code = F.regexp_extract(F.lower(F.trim(column)), "^[a-z]+", 0)
    #: Three-letter codes whose first two letters are not the two-letter code.
    odd = {"deu": "de", "ger": "de", "spa": "es", "por": "pt", "zho": "zh", "jpn": "ja", "pol": "pl", "swe": "sv", "tur": "tr", "nld": "nl", "ces": "cs"}
    code = F.coalesce(F.create_map(*[F.lit(x) for pair in odd.items() for x in pair])[code], code)
    return F.when(code.isNull() | (code == ""), "unknown").otherwise(F.substring(code, 1, 2))


def web_domain(column: Column) -> Column:
    """Registered domain of a URL: its host's last two labels."""
    host = F.regexp_extract(F.lower(F.trim(column)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)
    domain = F.regexp_extract(F.regexp_replace(host, r"\.+$", ""), r"([^.]+\.[^.]+)$", 1)
    return F.when(domain.isNull() | (domain == ""), "unknown").otherwise(domain)


def token_budget(chunks: DataFrame, crawl: DataFrame, path: str) -> DataFrame:
    """Rows, characters and tokens of the texts by data set, language and web domain.

    Counts are summed by source row before anything is shuffled, so the join moves one small row for each source row
    whatever a source's size, and the key of the join is the source row and not the (skewed) source.
    """
    keys = ["source_parquet", "source_row_index", "dataset_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for begin, part in blocks(texts):
                block = TextBlock(part)
                longest, merged = both_counts(path, block)
                columns = [batch.column(i).slice(begin, len(part)) for i in range(3)]
                chars = block.text_end - block.text_start
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chars), pa.array(merged), pa.array(longest)], [*keys, "chars", "tokens", "longest_match_tokens"])

    counted = chunks.select(chunks["source_parquet"], chunks["source_row_index"], data_set_name(chunks["dataset_type"]).alias("dataset_type"), chunks["chunk_body"]).mapInArrow(
        run, "source_parquet string, source_row_index bigint, dataset_type string, chars bigint, tokens bigint, longest_match_tokens bigint"
    )
    sums = [F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.sum("longest_match_tokens").alias("longest_match_tokens")]
    by_row = counted.groupBy(*keys).agg(F.count("*").alias("chunks"), *sums)
    places = crawl.groupBy("source_parquet", "source_row_index").agg(F.max_by(F.struct("language", "url"), F.struct("ingested_at", "language_score", "id")).alias("last"))
    places = places.select("source_parquet", "source_row_index", language_code(F.col("last.language")).alias("language"), web_domain(F.col("last.url")).alias("domain"))
    joined = by_row.join(places, ["source_parquet", "source_row_index"], "left").na.fill("unknown", ["language", "domain"])
    return joined.groupBy("dataset_type", "language", "domain").agg(F.sum("chunks").alias("chunks"), *sums)
