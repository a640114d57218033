"""Token counts without ids: pieces are counted once per distinct pre-token and joined to frequencies.

Pre-tokens of all documents are counted first. Those seen most often (a bounded number of short ones) go to all
workers as a table; the rest meet their counts in a shuffle join of (document, pre-token, frequency).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField
from tokenizers import Tokenizer, pre_tokenizers

from modelwatch.llm.common import append_columns, held, small_batches, stored

#: The broadcast table: at most so many pre-tokens of at most so many characters (about 6 MB).
COMMON_ROWS, COMMON_CHARS = 200_000, 32
#: Distinct words that a worker gathers before it hands their counts on, and that it keeps split.
GATHERED = 300_000
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-˿]")
_BYTES = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)


class Splitter:
    """Words and pre-tokens of texts, as the tokenizer file defines them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def words(self, text: str) -> tuple[list[str], int]:
        """Words between white space (of usual texts not yet in lower case) and the number of special strings.

        Below U+0300 normalising leaves every character in place, so only other texts are normalised whole.
        """
        special = 0
        if "<" in text and self.specials is not None:
            special = len(self.specials.findall(text))
            if special:
                return list(chain.from_iterable(self.words(t)[0] for t in self.specials.split(text))), special
        if _UNUSUAL.search(text):
            return [w for w in self.tokenizer.normalizer.normalize_str(text).split(" ") if w], special
        return text.split(), special

    def pretokens(self, word: str) -> list[str]:
        """Pre-tokens of a word, in lower case."""
        if not _UNUSUAL.search(word):
            word = word.lower()
            if word.isalpha():
                return [word]
        return [word[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]

    def pieces(self, pretoken: str) -> int:
        return sum(len(self.tokenizer.model.tokenize(t)) for t, _ in _BYTES.pre_tokenize_str(pretoken))


def splitter(path: str) -> Splitter:
    return held(("splitter", path), lambda: Splitter(path))


def _gather(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split, seen = splitter(path), Counter()

    def flush() -> pa.RecordBatch:
        found: Counter = Counter()
        for word, n in seen.items():
            for p in split.pretokens(word):
                found[p] += n
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                          ["pretoken", "freq"])

    for batch in batches:
        for text in batch.column(0):
            seen.update(split.words(text.as_py() or "")[0])
            if len(seen) > GATHERED:
                yield flush()
    if seen:
        yield flush()


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split = splitter(path)
    for batch in batches:
        counts = [split.pieces(p) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["pretoken", "freq", "pieces"])


class _Words(dict):
    """Pieces of a word's common pre-tokens; words with others are listed in ``rare``."""

    def __init__(self, path: str, common: dict[str, int]):
        self.split, self.common, self.rare = splitter(path), common, {}

    def __missing__(self, word: str) -> int:
        if len(self) > GATHERED:
            self.clear()
            self.rare.clear()
        known, other = 0, []
        for p in self.split.pretokens(word):
            n = self.common.get(p)
            if n is None:
                other.append(p)
            else:
                known += n
        if other:
            self.rare[word] = other
        self[word] = known
        return known


def _count(path: str, common):
    table = _Words(path, dict(zip(*common.value)))

    def work(texts: list[str]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for text in texts:
            words, tokens = table.split.words(text)
            rest: Counter = Counter()
            for at in range(0, len(words), 50_000):
                some = words[at:at + 50_000]
                tokens += sum(map(table.__getitem__, some))
                rare = table.rare
                for w in some:
                    if w in rare:
                        rest.update(rare[w])
                    elif w not in table:  # the table was emptied meanwhile
                        rest.update(p for p in table.split.pretokens(w) if p not in table.common)
            for column, value in zip(out, (len(text.encode()), tokens, list(rest), list(rest.values()))):
                column.append(value)
        return out

    return work


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text.

    Counts are those of the tokenizer file without added begin or end; special strings in a text count as one token each.
    Null texts are empty (0 tokens); repeated rows and null doc_ids stay rows of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = docs.select(F.col("text").cast("string")).mapInArrow(partial(_gather, path=path), "pretoken string, freq long")
    vocabulary = stored(found.groupBy("pretoken").agg(F.sum("freq").alias("freq"))
                        .mapInArrow(partial(_pieces, path=path), "pretoken string, freq long, pieces long"), "pretokens")
    # the frequency from which pre-tokens are common: counts by power-of-two class reach the driver
    short = F.length("pretoken") <= COMMON_CHARS
    classes = (vocabulary.where(short).groupBy(F.floor(F.log2("freq") * 4).alias("c")).count()
               .orderBy(F.desc("c")).collect())
    room, least = COMMON_ROWS, None
    for row in classes:
        room -= row["count"]
        if room < 0:
            break
        least = row["c"]
    is_common = short & (F.floor(F.log2("freq") * 4) >= (least if least is not None else 1 << 20))
    rows = vocabulary.where(is_common).select("pretoken", "pieces").toArrow()
    common = spark.sparkContext.broadcast((rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    fields = [StructField("n_bytes", LongType()), StructField("known", LongType()),
              StructField("rest", ArrayType(StringType())), StructField("times", ArrayType(IntegerType()))]
    counted = append_columns(docs, partial(_count, path, common), fields, keep=["doc_id"], as_bytes=False)
    per_doc = stored(counted.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    pairs = per_doc.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", "x.rest", "x.times")
    tail = (pairs.join(vocabulary.where(~is_common).select(F.col("pretoken").alias("rest"), "pieces"), "rest")
            .groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more")))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return (per_doc.select("doc_id", "n_bytes", "known", "row").join(tail, "row", "left")
            .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))
